"""Main text of web pages by a site style tree.

All pages of a host are merged into one style tree: an element node stands for
all elements at one place (the chain of tags and classes from the root), and
counts how many of the host's pages show which sequence of children
(presentation) and which text (content).  The normalised entropies of the two
counts give a node its importance, between 0 (every page shows the same) and 1
(every page shows its own).

A place is kept or removed by the sum of two weights: that of its declaration
(tag, role, class) and that of its importance.  Declarations are a prior.  Low
importance overrules any of them, an article included; high importance of long
unlinked text overrules doubtful class words.  Tags and roles that the standard
reserves for other things than main text, and class words without a second
meaning (adverts, comments ...), weigh more than importance can: adverts and
menus that change from page to page are as important to the entropies as
articles.  Hosts with few pages give no evidence, and the declaration decides.

The tree exists only as grouped counts, so a host with a third of all pages is
as parallel as any other.
"""

from __future__ import annotations

import hashlib
import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import batches, materialize, spread_join, with_row_id

#: Weight of a node's content against its own presentation.
CONTENT_WEIGHT = 0.9
#: Places whose verdict differs from their declaration are broadcast up to this many (8 bytes each).
BROADCAST_PLACES = 1 << 20

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video map head title textarea select datalist button".split())
#: Elements whose content is no markup.
UNPARSED = frozenset("script style iframe noembed noframes textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html caption dd dt legend li optgroup option summary tbody td tfoot th thead tr".split())
#: A start tag of the key closes open elements of the values, up to a container.
IMPLIED = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",),
}
CONTAINERS = frozenset("ul ol dl table body html article section div main".split())
#: Declared not to be main text, by tag, by ARIA role and by a class or id without a second meaning.
BOILER_TAGS = frozenset("nav aside footer form dialog menu search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside recommended"
    " recommendations promo promotion promoted sponsor sponsored ad ads adv advert adverts advertisement advertising adsense adslot"
    " cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription"
    " signup login sharing comment comments disqus respond pagination pager toolbar searchbox teaser teasers".split()
)
#: Classes that often name other things than main text, and sometimes main text.
DOUBTFUL_WORDS = frozenset("header top banner alert share social related widget widgets search discussion reply replies copyright skip card cards".split())
#: What a name says nothing by: "comment-list" is comments, "post-body" is a post.
PLACE_WORDS = frozenset("area block body box column container content group inner item items left links list outer panel right section text wrap wrapper".split())
NEGATIONS = frozenset("has hide no non not with without".split())
MAIN_ROLES = frozenset(("main", "article"))
CONTENT_WORDS = frozenset("article content post entry story main".split())

#: Declarations: certainly no main text, doubtful, none, class speaks of content, main element.
CERTAIN, DOUBTFUL, NONE, CONTENT, MAIN = range(5)
#: Their weights; importance weighs from -4 (0) over 0 (1/2) to 2 (1).
PRIOR = {DOUBTFUL: -1.4, NONE: 1.6, CONTENT: 2.4, MAIN: 3.2}
#: Characters a doubtful place must have on a page, on average, to be main text.
DOUBTFUL_CHARS = 200

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")


def declared(names: str) -> int:
    """What the class and id tokens declare: by each token's head noun, not by parts of it.

    Words that only name a place ("area", "list") are no head; a token with a
    negation ("no-sidebar", "with-sidebar") declares nothing.
    """
    found = NONE
    for token in names.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or NEGATIONS & set(words[:-1]):
            continue
        while len(words) > 1 and words[-1] in PLACE_WORDS:
            words.pop()
        head = words[-1]
        if head in BOILER_WORDS:
            return CERTAIN
        if head in DOUBTFUL_WORDS:
            found = DOUBTFUL
        elif head in CONTENT_WORDS and found != DOUBTFUL:
            found = CONTENT
    return found


def tokens(text: str):
    """(kind, name or text, attributes) of a page: kinds "<", "</" and "".  Linear in the page, whatever it holds.

    Unclosed comments end with the page, unclosed tags at its end are dropped.
    """
    ahead: dict[str, int] = {}
    size = len(text)

    def find(what: str, at: int) -> int:
        """The next place of ``what``; pointers only move forward, so all searches together read the page once."""
        known = ahead.get(what, -1)
        if known < at:
            known = text.find(what, at)
            ahead[what] = known = size if known < 0 else known
        return known

    at = 0
    while at < size:
        here = find("<", at)
        if here > at:
            yield "", references.unescape(text[at:here]) if find("&", at) < here else text[at:here], None
        if here >= size:
            return
        mark = text[here + 1 : here + 2]
        if mark.isascii() and mark.isalpha() or (mark == "/" and text[here + 2 : here + 3].isascii() and text[here + 2 : here + 3].isalpha()):
            name = _NAME.match(text, here + (2 if mark == "/" else 1))
            tag, at = name.group().lower(), name.end()
            close = find(">", at)
            attributes: dict[str, str] = {}
            if close == at:
                at += 1
            elif close >= size:
                return
            else:
                while True:
                    got = _ATTRIBUTE.match(text, at)
                    if not got:
                        close = find(">", at)
                        at = close + 1
                        break
                    key, at = got.group(1).lower(), got.end()
                    value = ""
                    if got.group(2):
                        quote = text[at : at + 1]
                        if quote in ('"', "'") and quote:
                            end = find(quote, at + 1)
                            value, at = text[at + 1 : end], end + 1
                        else:
                            plain = _UNQUOTED.match(text, at)
                            value, at = plain.group(), plain.end()
                    if key not in attributes:
                        attributes[key] = references.unescape(value) if "&" in value else value
                    if at >= size:
                        break
                if at > size or (at == size and text[size - 1] != ">"):
                    return
            if mark == "/":
                yield "</", tag, None
                continue
            yield "<", tag, attributes
            if tag in UNPARSED:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
                at = end.start() if end else size
        elif text.startswith("<!--", here):
            if text.startswith(("<!-->", "<!--->"), here):
                at = find(">", here) + 1
            else:
                at = find("-->", here + 4) + 3
        elif mark in ("!", "?", "/"):
            at = find(">", here) + 1
        else:
            yield "", "<", None
            at = here + 1


class _Frame:
    __slots__ = ("tag", "place", "level", "root", "noisy", "kids", "digest", "tracked", "chars", "linked", "linking", "kind")

    def __init__(self, tag, place, level, root, noisy, tracked, linking, kind):
        self.tag, self.place, self.level, self.root, self.noisy, self.tracked, self.linking, self.kind = tag, place, level, root, noisy, tracked, linking, kind
        self.kids: list[str] = []
        self.digest: list[bytes] = []
        self.chars = self.linked = 0


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


class PageReader:
    """Reads one page: its text pieces with what surrounds them, and its style nodes.

    overruled: places of this host whose declaration the tree overrules.
    pieces: (level, noisy, root, heading, text); a text of None is a block edge.
    Level 0 is undeclared or main text, 1 inside a form, 2 declared otherwise;
    root numbers the outermost main or content element around, 0 is none.
    nodes: place to (presentation, content, characters, linked characters, declaration) of its elements.
    """

    def __init__(self, host: str = "", overruled: frozenset[int] = frozenset()):
        self.overruled = overruled
        self.stack = [_Frame("", _hash(host.encode("utf-8", "replace")), 0, 0, False, False, False, NONE)]
        self.pieces: list[tuple[int, bool, int, bool, str | None]] = []
        self.nodes: dict[int, list[tuple[str, bytes, int, int, int]]] = {}
        self.roots = [0]  # the place of each root
        self.raw = 0
        self.open: dict[str, list[int]] = {}  # tag: where it is open in the stack
        self.containers = [0]

    def read(self, page: str) -> PageReader:
        for kind, name, attributes in tokens(page):
            if kind == "":
                self._text(name)
            elif kind == "<":
                self._start(name, attributes)
            else:
                self._end(name)
        self._pop_to(1)
        return self

    def _start(self, tag: str, a: dict[str, str]) -> None:
        if tag in BLOCK:
            self._edge()
        if tag == "body" or (tag in BLOCK and self.stack[-1].tag == "head"):
            self._close(("head",))
        if tag in CLOSES_P:
            self._close(("p",))
        if tag in IMPLIED:
            self._close(IMPLIED[tag])
        top = self.stack[-1]
        if tag in VOID:
            top.kids.append(tag)
            return
        names = f"{a.get('class', '')} {a.get('id', '')}" if a else ""
        role = a.get("role", "").lower() if a else ""
        kind, level = NONE, 0
        if a and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()):
            level = 2
        elif tag == "form":
            level = 1
        elif tag in RAW or tag in BOILER_TAGS or role in BOILER_ROLES or (tag == "header" and not top.root):
            level = 2
        elif tag in ("html", "body"):
            pass
        else:
            kind = declared(names) if names.strip() else NONE
            if tag in ("article", "main") or role in MAIN_ROLES or a.get("itemprop", "").lower() == "articlebody":
                kind = MAIN if kind not in (CERTAIN, DOUBTFUL) else kind
            if kind == CERTAIN:
                level = 2
        # An article inside an unclosed advert is still an article; scripts and the like are not.
        inherited = 0 if kind == MAIN and tag in ("article", "main") and not self.raw else top.level
        block = tag in BLOCK
        key = f"{tag}.{'.'.join(sorted(names.split()))}" if block else tag
        place = _hash(b"%d/%s" % (top.place, key.encode("utf-8", "replace")))
        top.kids.append(tag)
        told = place in self.overruled
        if kind == DOUBTFUL and not told:
            level = 2
        level = max(level, inherited)
        tracked = block and (level < 2 or (kind == DOUBTFUL and inherited < 2))
        root = top.root
        if not root and level == 0 and kind in (CONTENT, MAIN):
            root = len(self.roots)
            self.roots.append(place)
        if tag in RAW:
            self.raw += 1
        at = len(self.stack)
        self.open.setdefault(tag, []).append(at)
        if tag in CONTAINERS:
            self.containers.append(at)
        noisy = top.noisy or (told and kind != DOUBTFUL)
        self.stack.append(_Frame(tag, place, level, root, noisy, tracked, top.linking or tag == "a", kind))

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._edge()
        where = self.open.get(tag)
        if where and tag not in VOID:
            self._pop_to(where[-1])

    def _text(self, data: str) -> None:
        top = self.stack[-1]
        self.pieces.append((top.level, top.noisy, top.root, top.tag == "h1", data))
        if not self.raw and (stripped := data.strip()):
            top.digest.append(stripped.encode("utf-8", "replace"))
            top.chars += len(stripped)
            if top.linking:
                top.linked += len(stripped)

    def _edge(self) -> None:
        self.pieces.append((0, False, 0, False, None))

    def _close(self, tags: tuple[str, ...]) -> None:
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if at > self.containers[-1]:
            self._pop_to(at)

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            frame = self.stack.pop()
            self.open[frame.tag].pop()
            if self.containers[-1] == len(self.stack):
                self.containers.pop()
            if frame.tag in RAW:
                self.raw -= 1
                continue
            above = self.stack[-1]
            above.chars += frame.chars
            above.linked += frame.linked
            content = hashlib.blake2b(b"\0".join(frame.digest), digest_size=8).digest() if frame.digest else b""
            if frame.level < 2 or frame.kind == DOUBTFUL:
                above.digest.append(content)
            if frame.tracked:
                kids = [k for i, k in enumerate(frame.kids) if not i or k != frame.kids[i - 1]]
                self.nodes.setdefault(frame.place, []).append((" ".join(kids), content, frame.chars, frame.linked, frame.kind))

    def text(self) -> str:
        """Main text: kept blocks joined by one space.

        If the roots of one kind hold half of the kept text, they and roots
        with a quarter of theirs are the main text, with the page's headings of
        first rank; otherwise all kept blocks are.  Low importance never takes
        more than half of the text in declared main elements, nor all of a
        page: copies of one article on a host are still articles.
        """
        best = self._chosen(True)
        rest = self._chosen(False) if any(noisy for _, noisy, *_ in self.pieces) else best
        if rest is not best and (not best or (any(root for *_, root, _, t in self.pieces if t) and 2 * len(best) < len(rest))):
            best = rest
        if not best and any(level == 1 for level, *_ in self.pieces):
            # A page that is one form around everything.
            self.pieces = [(0 if level == 1 else level, *more) for level, *more in self.pieces]
            return self.text()
        return best

    def _chosen(self, strict: bool) -> str:
        kept = [(root, heading, t) for level, noisy, root, heading, t in self.pieces if t is None or (level == 0 and not (strict and noisy))]
        size: dict[int, int] = {}
        for root, _, t in kept:
            if t and root:
                size[self.roots[root]] = size.get(self.roots[root], 0) + len(t.strip())
        total = sum(len(t.strip()) for _, _, t in kept if t)
        most = max(size.values(), default=0)
        if most and 2 * most >= total:
            kept = [(root, h, t) for root, h, t in kept if t is None or h or (root and 4 * size[self.roots[root]] >= most)]
        blocks: list[str] = []
        held: list[str] = []
        for _, _, t in [*kept, (0, False, None)]:
            if t is not None:
                held.append(t)
            elif held:
                block = _SPACE.sub(" ", "".join(held)).strip(" ")
                if block:
                    blocks.append(block)
                held = []
        return " ".join(blocks)


def read_page(page: str | None, host: str = "", overruled: frozenset[int] = frozenset()) -> PageReader:
    return PageReader(host, overruled).read(page or "")


_NODES = ["host", "place", "shape", "content", "chars", "linked", "kind"]


def _style_nodes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(host, html) to one row per page and place."""
    out: list[tuple[int, ...]] = []
    for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        name = _hash((host or "").encode("utf-8", "replace"))
        for place, seen in read_page(page, host or "").nodes.items():
            shape, content = _hash("|".join(x[0] for x in seen).encode()), _hash(b"".join(x[1] for x in seen))
            out.append((name, place, shape, content, sum(x[2] for x in seen), sum(x[3] for x in seen), seen[0][4]))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], _NODES)


def style_tree(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """(host, place, pages, importance, chars, links, kind) of every node of every host's tree, from (host, html).

    host is a hash of its name; places of different hosts differ.  chars: the
    average on a page; links: the linked share of them; kind: the declaration.
    """
    nodes = pages.mapInArrow(batches(_style_nodes), ", ".join(f"{c} long" for c in _NODES))
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "linked")]
    counted = nodes.withColumn("n", F.lit(1)).groupBy("host", "place", "kind", "shape", "content").agg(*sums)
    counted = materialize(counted, "style-nodes", rows)

    def total(column: str) -> DataFrame:
        per = counted.groupBy("host", "place", "kind", column).agg(*sums)
        return per.groupBy("host", "place", "kind").agg(F.sum(F.col("n") * F.log("n")).alias(f"{column}_sum"), *sums)

    tree = total("content").join(total("shape").select("place", "shape_sum"), "place")

    def spread(column: str):
        return F.when(F.col("n") > 1, 1 - F.col(column) / (F.col("n") * F.log("n"))).otherwise(1.0)

    importance = (1 - CONTENT_WEIGHT) * spread("shape_sum") + CONTENT_WEIGHT * spread("content_sum")
    links = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    return tree.select(
        "host", "place", F.col("n").alias("pages"), importance.alias("importance"), (F.col("chars") / F.col("n")).alias("chars"), links.alias("links"), "kind"
    )


def overruled_places(tree: DataFrame, min_pages: int) -> DataFrame:
    """(host, place) whose importance outweighs the declaration: unimportant ones that would stay, important ones that would go."""
    weight = F.when(F.col("importance") < 0.5, 8 * (F.col("importance") - 0.5)).otherwise(4 * (F.col("importance") - 0.5) * (1 - 2 * F.col("links")))
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in PRIOR.items() for x in kv]), F.col("kind").cast("int"))
    keep = prior + weight > 0
    wrong = F.when(F.col("kind") == DOUBTFUL, keep & (F.col("chars") >= DOUBTFUL_CHARS)).otherwise(~keep)
    return tree.filter((F.col("pages") >= min_pages) & wrong).select("host", "place")


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 5,
    broadcast_places: int = BROADCAST_PLACES,
) -> DataFrame:
    """Main text of every page.

    White space inside a block becomes one space, blocks are trimmed and joined
    in page order by one space; nothing is cut.  Null or empty html gives an
    empty text.  A null or odd url belongs to the host ''.  Places on fewer than
    ``min_pages`` pages of a host are judged by their declaration alone.
    Repeated rows count as pages of their own.  Very long and broken pages take
    time in proportion to their length.  An empty table gives an empty result.

    The overruled places of all hosts are broadcast up to ``broadcast_places``;
    beyond that they come to the pages by a join on the host, hot hosts salted.

    Returns per row: _rid, id, url, host, text, n_chars.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = with_row_id(pages).select(
        F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html")
    )
    kind = dict(rows.dtypes)["id"]
    n_pages = rows.count()
    places = materialize(overruled_places(style_tree(rows.select("host", "html"), 20 * n_pages), min_pages), "style-tree", n_pages)
    names = ["rid", "id", "url", "host", "text", "n_chars"]
    schema = f"rid long, id {kind}, url string, host string, text string, n_chars long"

    def result(batch: pa.RecordBatch, told) -> pa.RecordBatch:
        rid, ids, url, own_host, *_, page = batch.columns
        text = [read_page(h, n or "", t).text() for h, n, t in zip(page.to_pylist(), own_host.to_pylist(), told, strict=True)]
        return pa.RecordBatch.from_arrays([rid, ids, url, own_host, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names)

    if places.count() <= broadcast_places:
        sent = rows.sparkSession.sparkContext.broadcast(places.select("place").toArrow()["place"].to_numpy())
        held: list[frozenset[int]] = []

        def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not held:
                held.append(frozenset(np.asarray(sent.value).tolist()))
            return result(batch, held * batch.num_rows)

        found = rows.mapInArrow(batches(extract), schema)
    else:

        def extract_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
            return result(batch, [frozenset(x or ()) for x in batch.column(4).to_pylist()])

        named = rows.select("rid", "host").mapInArrow(_host_keys, "rid long, host_key long")
        weights = materialize(named.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages")), "hosts")
        lists = places.groupBy(F.col("host").alias("list_key")).agg(F.collect_list("place").alias("told"))
        lists = lists.join(weights, F.col("list_key") == F.col("host_key")).drop("list_key")
        n = weights.agg(F.sum("host_pages")).first()[0] or 0
        keyed = rows.mapInArrow(_with_host_key, f"rid long, id {kind}, url string, host string, host_key long, html string")
        wide = spread_join(keyed, lists, "host_key", "host_pages", n, "left").select("rid", "id", "url", "host", "told", "html")
        found = wide.mapInArrow(batches(extract_joined), schema)
    return found.withColumnRenamed("rid", "_rid")


def _key_of(hosts: pa.Array) -> pa.Array:
    return pa.array([_hash((h or "").encode("utf-8", "replace")) for h in hosts.to_pylist()], pa.int64())


def _host_keys(stream):
    for b in stream:
        yield pa.RecordBatch.from_arrays([b.column(0), _key_of(b.column(1))], ["rid", "host_key"])


def _with_host_key(stream):
    for b in stream:
        rid, ids, url, host, page = b.columns
        yield pa.RecordBatch.from_arrays([rid, ids, url, host, _key_of(host), page], ["rid", "id", "url", "host", "host_key", "html"])
