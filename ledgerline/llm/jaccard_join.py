"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric, so pivots cut the documents into Voronoi regions
and the triangle inequality bounds what can cross: with radius r, documents x
and y link only if |d(x, p) - d(y, p)| <= r for every pivot p.

1. Copies fall together by a digest of their shingle sets.
2. Coarse regions.  Random pivots lie at a distance of almost 1 from almost
   every document, where the windows cut nothing.  So a document's first
   pivots are the parts of its own set: hashing deals the shingles to m parts,
   with m above the number of shingles in which two linked sets of that size
   can differ, so at least one part is the same in both.  Documents that share
   a part form a cell, cells that share a document form a region, and every
   linked pair lies inside one region.  Parts without any but very common
   shingles are left out where a document has enough others (see
   :func:`part_signatures`); which shingles are common changes the work, not
   the result.
3. Inside a region, a pivot's distances to all members are exact.  Members
   within r are linked to it.  The rest, and the boundary documents its window
   lets in, join again with the next pivot, until no candidates are left.
4. A region above ``max_region`` is first cut by the rarest shingles of its
   members (see :func:`rare_signatures`): two linked sets share one of them, so
   members that share none, as those that only have common lines in common, part.
   Among very many members single shingles meet by chance, so what stays above
   the limit is cut again by its members' rarest parts (see :func:`rare_parts`),
   of several deals.  What even then stays is cut into tiles: its pivot's inner
   documents are linked to it, and outer documents meet all members tile by
   tile, a few columns of tiles at once, so that disk does not grow with the
   square of a region.

Region members move as Zstandard frames of their texts, a quarter of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import connected_components
from ledgerline.llm.rows import (
    ascii_lower,
    filter_place,
    free_shuffles,
    joined,
    materialize,
    mix64,
    packed_texts,
    passes,
    prefix_hash,
    range_hash,
    row_filter,
    runs_of_key,
    sequence_hash,
    slices,
    spread_join,
    text_of,
    unpacked,
    with_row_id,
    word_spans,
)

#: Signatures in a bucket of cells, about.
BUCKET_ITEMS = 2_000_000
#: Shingles that are looked up as very common, at most, and the documents that count together for it.
COMMON_SHINGLES = 1 << 17
COUNT_SHINGLES = 6_000_000
COMMON_DOCS = 4
#: Hashes by which a set can be dealt into parts before its empty parts are named.
DEALS = 5
#: Region memberships up to this many (16 bytes each) are broadcast to fetch the texts.
BROADCAST_NODES = 200_000
#: Cuts of what is above the limit: by the rarest shingles, then by the rarest parts of so many deals less one.
CUTS = 5
#: Columns of tiles that are written at once, at most.
TILE_COLUMNS = 4


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    start, end, at = word_spans(data, bounds)
    words = range_hash(prefix_hash(ascii_lower(data)), start, end)
    prefix, owner, n = sequence_hash(words), text_of(at), np.diff(at)
    first = np.flatnonzero(owner[width - 1 :] == owner[: len(owner) - width + 1]) if len(owner) >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    h = np.r_[range_hash(prefix, first, first + width), range_hash(prefix, at[short], at[short + 1])]
    by = np.r_[owner[first] if len(first) else first, short]
    order = np.lexsort((h, by))
    h, by = h[order], by[order]
    fresh = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (by[1:] != by[:-1])]) if len(h) else np.zeros(0, np.int64)
    h, by = h[fresh], by[fresh]
    return h, np.searchsorted(by, np.arange(len(n) + 1))


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


class SizeClasses:
    """Classes of set sizes in which linked sets are the same or neighbours, and the parts of each.

    percent: the similarity in hundredths.  Linked sets of at most s shingles
    differ in at most K = (100 - percent) * 2s / (100 + percent) shingles.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.start = [1]

    def up_to(self, size: int) -> np.ndarray:
        while self.start[-1] <= size:
            self.start.append(max(self.start[-1] + 1, 100 * (self.start[-1]) // self.percent + 1))
        return np.array(self.start)

    def of(self, n: np.ndarray) -> np.ndarray:
        starts = self.up_to(int(n.max(initial=1)))
        return np.searchsorted(starts, n, side="right") - 1

    def parts(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(differences that linked sets of the class can have, number of parts)."""
        while len(self.start) < int(k.max(initial=0)) + 2:
            self.up_to(self.start[-1])
        top = np.array(self.start)[k + 1] - 1
        most = (100 - self.percent) * 2 * top // (100 + self.percent)
        # A few parts more than needed, so that the parts with shingles are enough on their own.
        return most, most + 3 + (most + 1) // 12


class Common:
    """A sorted list of very common shingles with a quick look-up."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = np.sort(shingles)
        self.flag = np.zeros(1 << 22, bool)
        self.flag[(self.shingles >> np.uint64(42)).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.flag[(h >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            where = np.minimum(np.searchsorted(self.shingles, h[maybe]), len(self.shingles) - 1)
            out[maybe] = self.shingles[where] == h[maybe]
        return out


def part_signatures(h: np.ndarray, at: np.ndarray, classes: SizeClasses, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of the parts of each set, in its own size class and the next.

    A part with a shingle that is not common is good.  With more good parts
    than linked sets can have differing parts, one good part is shared with
    every linked set, and that set names it too, for it always names its good
    parts.  A set with too few good parts is dealt again by another hash, where
    every part with a shingle is good; so is its partner if neither has found
    the other.  What is short of good parts under every hash names its empty
    parts as well.
    """
    n = np.diff(at)
    own = classes.of(np.maximum(n, 1))
    common_h, mixed = common.has(h), mix64(h)
    out, by = [], []
    for step in (0, 1):
        k = own + step
        most, parts = classes.parts(k)
        # Linked sets that cannot differ are equal, and equal sets are one already.
        left = np.flatnonzero((n > 0) & (most > 0))
        for deal in range(DEALS):
            if not len(left):
                break
            item = _items(at, left)
            count = parts[left]
            base = np.r_[0, np.cumsum(count)]
            local = np.repeat(np.arange(len(left)), n[left])
            code = h[item] >> np.uint64(33) if not deal else mix64(h[item] + np.uint64(deal)) >> np.uint64(33)
            slot = base[:-1][local] + (code % count[local].astype(np.uint64)).astype(np.int64)
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, slot, mixed[item])
            good = np.zeros(base[-1], bool)
            good[slot if deal else slot[~common_h[item]]] = True
            text = np.repeat(np.arange(len(left)), count)
            place = np.arange(base[-1]) - base[:-1][text]
            enough = np.bincount(text, good, len(left)) > most[left]
            keep = good | ~enough[text] if deal == DEALS - 1 else good
            name = mix64((k[left][text].astype(np.uint64) << np.uint64(40)) | (place.astype(np.uint64) << np.uint64(8)) | np.uint64(deal))
            out.append(mix64(total ^ name)[keep])
            by.append(left[text[keep]])
            left = left[~enough]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(by)


def rare_signatures(
    h: np.ndarray, at: np.ndarray, region: np.ndarray, classes: SizeClasses, listed: np.ndarray, texts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the rarest shingles of each set, in its own size class and the next.

    Linked sets of at most n shingles share at least percent * n / 100, so in any
    order of the shingles, the same for all sets, they share one of the first
    n - percent * n / 100 + 1 (rounded down).  ``listed`` (sorted) and ``texts``
    tell how many sets have a shingle; what is not listed comes first.  The
    list changes the work, not the result.
    """
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    seen = np.zeros(len(h), np.int64)
    if len(listed):
        where = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        seen = np.where(listed[where] == h, texts[where], 0)
    order = np.lexsort((h, seen, owner))
    place = np.arange(len(h)) - at[:-1][owner]
    keep = place < (n - (classes.percent * n + 99) // 100 + 1)[owner]
    h, owner = h[order[keep]], owner[keep]
    own = classes.of(np.maximum(n, 1))
    out = []
    for step in (0, 1):
        name = mix64(mix64(region.astype(np.uint64)) ^ (own + step).astype(np.uint64))
        out.append(mix64(mix64(h) ^ name[owner]))
    return np.concatenate(out), np.r_[owner, owner]


def rare_parts(
    h: np.ndarray, at: np.ndarray, region: np.ndarray, classes: SizeClasses, listed: np.ndarray, texts: np.ndarray, deal: int
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the rarest parts of each set, in its own size class and the next.

    Linked sets that differ in at most K shingles, dealt to m > K parts, differ in
    at most K of them, so in any order of parts by what they hold they share one of
    the first K + 1.  Parts with more shingles that are not listed come first: that
    two sets share those by chance is far less likely than that they share one.
    ``deal`` chooses the hash, and m as twice or four times K in turn.
    """
    n = np.diff(at)
    own = classes.of(np.maximum(n, 1))
    seen = np.zeros(len(h), np.int64)
    if len(listed):
        where = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        seen = np.where(listed[where] == h, texts[where], 0)
    code, mixed = mix64(h + np.uint64(DEALS + deal)) >> np.uint64(33), mix64(h)
    out, by = [], []
    for step in (0, 1):
        k = own + step
        most, _ = classes.parts(k)
        left = np.flatnonzero((n > 0) & (most > 0))
        if not len(left):
            continue
        item = _items(at, left)
        count = most[left] * (2 if deal % 2 else 4) + 2
        base = np.r_[0, np.cumsum(count)]
        local = np.repeat(np.arange(len(left)), n[left])
        slot = base[:-1][local] + (code[item] % count[local].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, mixed[item])
        rare = np.minimum(np.bincount(slot, seen[item] == 0, base[-1]).astype(np.int64), 3)
        least = np.full(base[-1], np.iinfo(np.int64).max)
        np.minimum.at(least, slot, np.where(seen[item] > 0, seen[item], np.iinfo(np.int64).max - 1))
        text = np.repeat(np.arange(len(left)), count)
        place = (np.arange(base[-1]) - base[:-1][text]).astype(np.uint64)
        name = mix64((k[left][text].astype(np.uint64) << np.uint64(40)) | (place << np.uint64(8)) | np.uint64(DEALS + deal))
        sig = mix64(mix64(total ^ name) ^ mix64(region[left][text].astype(np.uint64)))
        order = np.lexsort((sig, least, -rare, text))
        keep = order[np.arange(base[-1]) - base[:-1][text] <= most[left][text]]
        out.append(sig[keep])
        by.append(left[text[keep]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(by)


def _items(at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the items of the chosen sets, set after set."""
    n = at[chosen + 1] - at[chosen]
    first = np.r_[0, np.cumsum(n)]
    return np.repeat(at[chosen] - first[:-1], n) + np.arange(first[-1])


def _most_common(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of sets) of a stretch of sets; one stretch cannot fill the list alone, so its most common ones are enough."""
    shingle, count = np.unique(np.concatenate(held), return_counts=True)
    pick = np.flatnonzero(count >= least)
    pick = pick[np.argsort(-count[pick], kind="stable")[:COMMON_SHINGLES]]
    return shingle[pick], count[pick]


def _sets(width: int):
    """One row per text, and rows without rid for shingles that many texts of a stretch have."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "id", "n", "key", "shingle", "texts"]

        def often(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
            shingle, count = _most_common(held, COMMON_DOCS)
            empty = [pa.nulls(len(shingle), t) for t in (pa.int64(), kind, pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, pa.array(shingle.view(np.int64)), pa.array(count)], names)

        held, size, kind = [], 0, pa.int64()
        for whole in stream:
            for batch in slices(whole, 4 << 20):
                rid, ids, text = batch.columns
                kind = ids.type
                h, at = shingle_sets(*joined(text), width)
                key = [_digest(h[a:b]) if b > a else None for a, b in zip(at, at[1:], strict=False)]
                empty = [pa.nulls(len(rid), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [rid, ids, pa.array(np.diff(at), pa.int64()), pa.array(key, pa.binary()), *empty], names
                )
                held.append(h)
                size += len(h)
                if size >= COUNT_SHINGLES:
                    yield often(held, kind)
                    held, size = [], 0
        if size:
            yield often(held, kind)

    return run


def _cell_blobs(width: int, percent: int, buckets: int, sent):
    """Per bucket and slice of texts: packed signatures with the texts they come from; copies in a task send once."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, common, done = SizeClasses(percent), Common(sent.value), set()
        for whole in stream:
            for batch in slices(whole, 4 << 20):
                rid = batch.column(0).to_numpy()
                h, at = shingle_sets(*joined(batch.column(1)), width)
                fresh = np.zeros(len(rid), bool)
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    if b > a and (d := _digest(h[a:b])[:12]) not in done:
                        done.add(d)
                        fresh[i] = True
                keep = np.repeat(fresh, np.diff(at))
                h, rid = h[keep], rid[fresh]
                if not len(h):
                    continue
                sig, text = part_signatures(h, np.r_[0, np.cumsum(np.diff(at)[fresh])], classes, common)
                if len(sig):
                    yield _dealt(rid, sig, text, buckets)

    return run


def _dealt(rid: np.ndarray, sig: np.ndarray, text: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, blob): signatures and their texts by bucket; there are some."""
    bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, text, bucket = sig[order], text[order], bucket[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    names, blobs = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        texts, local = np.unique(text[a:b], return_inverse=True)
        names.append(int(bucket[a]))
        blobs.append(_pack(rid[texts], sig[a:b], local))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _pack(rid: np.ndarray, sig: np.ndarray, local: np.ndarray) -> bytes:
    """Signatures (40 bits of each; the bucket tells the rest) and the numbers of their texts, in two bytes where that is enough."""
    head = np.array([len(rid), len(sig), rid[0]], np.int64)
    kind = np.uint16 if len(rid) <= 1 << 16 else np.uint32
    return b"".join(
        x.tobytes()
        for x in (head, rid - rid[0], sig.astype(np.uint32), local.astype(kind), (sig >> np.uint64(32)).astype(np.uint8))
    )


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    texts, n, base = np.frombuffer(blob, np.int64, 3)
    at = 24
    kind = np.dtype(np.uint16 if texts <= 1 << 16 else np.uint32)
    rid = np.frombuffer(blob, np.int64, texts, at) + base
    low = np.frombuffer(blob, np.uint32, n, at := at + 8 * texts)
    local = np.frombuffer(blob, kind, n, at := at + 4 * n)
    high = np.frombuffer(blob, np.uint8, n, at + kind.itemsize * n)
    return rid[local], low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


class Forest:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt

    def join(self, x: int, others: np.ndarray) -> None:
        for y in np.unique(self.up[others]):
            a, b = self.find(x), self.find(int(y))
            if a != b:
                self.up[max(a, b)] = min(a, b)


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) of every component of the links (a, b), one link for each other node."""
    nodes, local = np.unique(np.r_[a, b], return_inverse=True)
    x, y = local[: len(a)], local[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _cells(_, pdf):
    """Links that hold the bucket's cells together, as few as will do."""
    import pandas as pd

    parts = [_unpack(x) for x in pdf["blob"]]
    rid, sig = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((rid, sig))
    rid, sig = rid[order], sig[order]
    head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    first = np.repeat(rid[head], np.diff(np.r_[head, len(sig)]))
    use = first != rid
    a, b = spanning_stars(first[use], rid[use])
    return pd.DataFrame({"a": a, "b": b})


class Region:
    """Sets of one region as positions in a common vocabulary; distances come as counts."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        self.at = np.r_[0, np.cumsum(self.n)]
        kinds, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(kinds), np.int64)

    def similarity(self, p: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Jaccard similarity, linked) of p to others."""
        own = self.ids[self.at[p] : self.at[p + 1]]
        self.mark[own] = 1
        n = self.n[others]
        at = np.r_[0, np.cumsum(n)]
        where = np.repeat(self.at[others] - at[:-1], n) + np.arange(at[-1])
        both = np.add.reduceat(self.mark[self.ids[where]], at[:-1])
        self.mark[own] = 0
        union = self.n[p] + n - both
        return both / union, 100 * both >= self.percent * union

    def join(self, forest: Forest, candidates: np.ndarray, members: np.ndarray) -> None:
        """Link every candidate with every member within the radius, unless both are in one component already."""
        radius = 1 - self.percent / 100 + 1e-9
        todo = [(candidates, members)]
        while todo:
            cand, memb = todo.pop()
            while len(cand) and len(memb):
                roots = forest.roots()
                if (roots[cand] == roots[cand[0]]).all() and (roots[memb] == roots[cand[0]]).all():
                    break
                p, cand = int(cand[0]), cand[1:]
                similar, linked = self.similarity(p, memb)
                forest.join(p, memb[linked])
                d = np.ones(len(forest.up))
                d[memb] = 1 - similar
                rest = np.zeros(len(forest.up), bool)
                rest[cand] = True
                inside = np.zeros(len(forest.up), bool)
                inside[memb[linked]] = True
                # Candidates linked to the pivot still meet members outside its ball that are no candidates.
                inner = cand[inside[cand]]
                cand = cand[~inside[cand]]
                outside = memb[~inside[memb] & ~rest[memb]]
                if len(inner) and len(outside):
                    outside = outside[d[outside] <= d[inner].max() + radius]
                    if len(outside):
                        todo.append((inner, outside))
                # Window: members too near to the pivot, or too far, for every candidate that is left.
                if len(cand):
                    known = np.isin(cand, memb)
                    if known.all():
                        lo, hi = d[cand].min() - radius, d[cand].max() + radius
                        memb = memb[(d[memb] >= lo) & (d[memb] <= hi)]


def _read_sets(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(column)]


def _unpacked_sets(column: pa.ChunkedArray | pa.Array, width: int) -> list[np.ndarray]:
    """The set of each packed text."""
    out, held, size = [], [], 0

    def found() -> list[np.ndarray]:
        h, at = shingle_sets(np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(x) for x in held])], width)
        return [h[a:b].copy() for a, b in zip(at, at[1:], strict=False)]

    for text in unpacked(column):
        held.append(text)
        size += len(text)
        if size >= 4 << 20:
            out += found()
            held, size = [], 0
    return out + (found() if held else [])


def _join_regions(percent: int, width: int = 0):
    """(region, rid, set) sorted by region to (rid, root); with a width (region, rid, packed)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs_of_key(stream):
            rid = table.column("rid").to_numpy()
            order = np.argsort(rid)
            sets = _unpacked_sets(table.column("packed"), width) if width else _read_sets(table, "set")
            region = Region([sets[i] for i in order], percent)
            forest = Forest(len(rid))
            every = np.arange(len(rid))
            region.join(forest, every, every)
            rid = rid[order]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid[forest.roots()])], ["a", "b"])

    return run


def _pivot_links(percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            linked = []
            for own, pivot in zip(batch.column("set"), batch.column("pivot_set"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, pivot))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            names = ["region", "rid", "pivot", "set"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(linked, pa.bool_())], [*names, "inner"])

    return run


def _join_tiles(percent: int):
    """(tile, rid, outer, set) sorted by tile to links."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs_of_key(stream):
            rid, outer = table.column("rid").to_numpy(), table.column("outer").to_numpy(zero_copy_only=False).astype(bool)
            cand, memb = np.flatnonzero(outer), np.flatnonzero(~outer)
            if not len(cand) or not len(memb):
                continue
            forest = Forest(len(rid))
            Region(_read_sets(table, "set"), percent).join(forest, cand, memb)
            root = forest.roots()
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rid[root])], ["a", "b"])

    return run


def _sets_of(width: int):
    """(region, rid, packed) to (region, rid, set)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 1 << 20):
                region, rid, packed = batch.columns
                blobs = pa.array([x.tobytes() for x in _unpacked_sets(packed, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([region, rid, blobs], ["region", "rid", "set"])

    return run


def _region_texts(rows: DataFrame, regions: DataFrame, n: int, broadcast_nodes: int) -> DataFrame:
    """(region, rid, packed) of the n members of regions; a filter keeps all other texts out of the exchange."""
    if n <= broadcast_nodes:
        wanted = rows.join(F.broadcast(regions.select("node")), F.col("rid") == F.col("node"), "left_semi")
        return packed_texts(wanted).join(F.broadcast(regions), F.col("rid") == F.col("node")).select("region", "rid", "packed")
    sent = rows.sparkSession.sparkContext.broadcast(row_filter(regions, n, lambda size: filter_place("node", size)))

    def members(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(passes(sent.value[0], batch.column("at").to_numpy())))

    placed = rows.select("rid", "text", filter_place("rid", sent.value[1]).alias("at"))
    met = packed_texts(placed.mapInArrow(members, "rid long, text string, at long"))
    return met.join(regions, F.col("rid") == F.col("node")).select("region", "rid", "packed")


def _shingle_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that more than one set of a stretch has."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        shingle, count = _most_common(held, 2)
        return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(count, pa.int64())], ["shingle", "texts"])

    for batch in stream:
        sets = _read_sets(batch, "set")
        held += [x.copy() for x in sets]
        size += sum(map(len, sets))
        if size >= COUNT_SHINGLES:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def _rare_blobs(percent: int, buckets: int, sent, deal: int):
    """(region, rid, set) to packed signatures of their rarest shingles, or (deal above 0) parts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (listed, texts) = SizeClasses(percent), sent.value
        for batch in stream:
            sets = _read_sets(batch, "set")
            if sets:
                at = np.r_[0, np.cumsum([len(s) for s in sets])]
                region, rid = batch.column("region").to_numpy(), batch.column("rid").to_numpy()
                told = np.concatenate(sets), at, region, classes, listed, texts
                sig, of = rare_parts(*told, deal) if deal else rare_signatures(*told)
                if len(sig):
                    yield _dealt(rid, sig, of, buckets)

    return run


def _finer_regions(sets: DataFrame, percent: int, rows: int, deal: int = 0) -> DataFrame:
    """(region, rid, set) cut into regions of members that share a rare shingle, or part, directly or by others; members alone are left out."""
    spark = sets.sparkSession
    counts = sets.select("set").mapInArrow(_shingle_counts, "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    top = counts.orderBy(F.desc("texts"), "shingle").limit(COMMON_SHINGLES).toArrow()
    listed, texts = top["shingle"].to_numpy().view(np.uint64), top["texts"].to_numpy()
    order = np.argsort(listed)
    sent = spark.sparkContext.broadcast((listed[order], texts[order]))
    shingles = (sets.agg(F.sum(F.length("set"))).first()[0] or 0) // 8
    buckets = max(8, shingles * 2 * (100 - percent) // 100 // BUCKET_ITEMS + 1)
    blobs = sets.select("region", "rid", "set").mapInArrow(_rare_blobs(percent, buckets, sent, deal), "bucket long, blob binary")
    links = materialize(blobs.groupBy("bucket").applyInPandas(_cells, "a long, b long").distinct(), "rare-cells", 4 * rows)
    finer = connected_components(links, rows=4 * rows)
    return materialize(sets.drop("region").join(finer, F.col("rid") == F.col("node")).select(F.col("root").alias("region"), "rid", "set"), "finer-sets")


def _hot_links(sets: DataFrame, sizes: DataFrame, degrees: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links of the regions above the limit, by one pivot each and tiles of outer documents against all members."""
    pivots = (
        sets.select("region", "rid").join(degrees, sets["rid"] == degrees["node"])
        .groupBy("region").agg(F.max(F.struct("degree", (-F.col("rid")).alias("r"))).alias("x"))
        .select(F.col("region").alias("pivot_region"), (-F.col("x.r")).alias("pivot"))
    )
    texts = sets.select(F.col("rid").alias("pivot_rid"), F.col("set").alias("pivot_set"))
    pivots = pivots.join(texts, F.col("pivot") == F.col("pivot_rid")).drop("pivot_rid")
    judged = sets.join(pivots, F.col("region") == F.col("pivot_region")).select("region", "rid", "pivot", "set", "pivot_set")
    judged = materialize(judged.mapInArrow(_pivot_links(percent), "region long, rid long, pivot long, set binary, inner boolean"), "pivot-distances")
    outer = judged.filter("NOT inner").groupBy(F.col("region").alias("r")).agg(F.count(F.lit(1)).alias("outers"))
    parts = sizes.join(outer, sizes["size_region"] == outer["r"]).select(
        "r", F.ceil(F.col("size") / chunk).cast("int").alias("mc"), F.ceil(F.col("outers") / chunk).cast("int").alias("oc")
    )
    parts = materialize(parts, "tiles", 1 << 16)
    spread = judged.join(parts, judged["region"] == parts["r"])
    code = F.xxhash64(F.lit("tile"), "rid")
    links = judged.filter("inner").select(F.col("rid").alias("a"), F.col("pivot").alias("b")).filter("a != b")
    for first in range(0, parts.agg(F.max("oc")).first()[0] or 0, TILE_COLUMNS):
        stop = first + TILE_COLUMNS
        columns = F.sequence(F.lit(first), F.least(F.col("oc"), F.lit(stop)) - 1)
        members = spread.filter(F.col("oc") > first).select(
            "region", "rid", "set", F.pmod(code, F.col("mc")).cast("int").alias("m"), F.explode(columns).alias("o"), F.lit(False).alias("outer")
        )
        outers = spread.filter("NOT inner").withColumn("o", F.pmod(code, F.col("oc")).cast("int")).filter((F.col("o") >= first) & (F.col("o") < stop)).select(
            "region", "rid", "set", F.explode(F.sequence(F.lit(0), F.col("mc") - 1)).alias("m"), "o", F.lit(True).alias("outer")
        )
        tiles = members.unionByName(outers).select(F.xxhash64("region", "m", "o").alias("tile"), "rid", "outer", "set")
        found = tiles.repartition("tile").sortWithinPartitions("tile", "rid", "outer").mapInArrow(_join_tiles(percent), "a long, b long")
        links = links.union(materialize(found.filter("a != b"), "tile-links"))
        free_shuffles(judged.sparkSession)
    return links


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    max_region: int = 2048,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    A set holds the distinct runs of ``width`` words (ASCII lower case) of the
    whole text; a shorter text is one run.  Null, empty and blank texts have an
    empty set and link with nothing, also not with each other.  Repeated rows
    are copies.  Texts of any length give their whole set.  An empty table gives
    an empty result.  Components wider than 2**60 links are an error.

    Returns per row: _rid, id, n_shingles, component_id (smallest identifier of
    the component, null only if all are), component_rid (its smallest row).
    """
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = materialize(rows.mapInArrow(_sets(width), f"rid long, id {kind}, n long, key binary, shingle long, texts long"), "shingle-sets")
    seen = found.filter("rid IS NOT NULL").select("rid", "id", "n", "key")
    common = found.filter("rid IS NULL").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    listed = common.orderBy(F.desc("texts"), "shingle").limit(COMMON_SHINGLES).select("shingle").toArrow()["shingle"]
    sent = rows.sparkSession.sparkContext.broadcast(listed.to_numpy().view(np.uint64))
    rows_n = seen.count()
    reps = materialize(seen.filter("n > 0").groupBy("key").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "representatives", rows_n)
    some = seen.agg(F.sum((F.col("n") > 0).cast("long")).alias("texts"), F.sum("n").alias("n")).first()
    met = spread_join(seen.filter("n > 0"), reps, "key", "copies", some["texts"] or 0).select("rid", "id", "n", "rep")
    named = materialize(met.unionByName(seen.filter("n = 0").select("rid", "id", "n", F.lit(None).cast("long").alias("rep"))), "named", rows_n)
    shingles = some["n"] or 0
    buckets = max(8, int(shingles * 0.36) // BUCKET_ITEMS + 1)
    blobs = rows.select("rid", "text").mapInArrow(_cell_blobs(width, percent, buckets, sent), "bucket long, blob binary")
    stars = blobs.groupBy("bucket").applyInPandas(_cells, "a long, b long").distinct()
    for end in ("a", "b"):
        name = named.select(F.col("rid").alias(f"{end}_rid"), F.col("rep").alias(f"{end}_rep"))
        stars = stars.join(name, F.col(end) == F.col(f"{end}_rid"))
    stars = materialize(stars.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).filter("a != b").distinct(), "cells", 4 * rows_n)

    regions = materialize(connected_components(stars, rows=4 * rows_n).select(F.col("node"), F.col("root").alias("region")), "regions", rows_n)
    free_shuffles(rows.sparkSession)
    members = regions.count()
    texts = _region_texts(rows, regions, members, broadcast_nodes)
    sizes = regions.groupBy(F.col("region").alias("size_region")).agg(F.count(F.lit(1)).alias("size"))
    hot = materialize(sizes.filter(F.col("size") > max_region), "hot-regions", rows_n)
    above = lambda df, how: df.join(hot, F.col("region") == F.col("size_region"), how)
    cold, parted, extra = texts, [], None
    if hot.limit(1).count():
        texts = materialize(texts, "region-texts")
        free_shuffles(rows.sparkSession)
        cold = above(texts, "left_anti")
        large = materialize(above(texts, "left_semi").mapInArrow(_sets_of(width), "region long, rid long, set binary"), "hot-sets")
        left = 0
        for deal in range(CUTS):
            finer = _finer_regions(large, percent, rows_n, deal)
            sizes = finer.groupBy(F.col("region").alias("size_region")).agg(F.count(F.lit(1)).alias("size"))
            hot = materialize(sizes.filter(F.col("size") > max_region), "hot-parts", rows_n)
            parted.append(above(finer, "left_anti"))
            large = above(finer, "left_semi")
            free_shuffles(rows.sparkSession)
            was, left = left, hot.agg(F.sum("size")).first()[0] or 0
            if not left or deal > 1 and left > 0.99 * was:
                break
        if left:
            degrees = stars.select(F.col("a").alias("node")).union(stars.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
            links = _hot_links(large, hot, degrees, percent, max_region // 2)
            extra = connected_components(links, rows=4 * rows_n)
    # Frames are small for the work they hold, so their bytes do not decide on the tasks.
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + members // 500)
    roots = (
        cold.repartition(tasks, "region").sortWithinPartitions("region")
        .mapInArrow(_join_regions(percent, width), "a long, b long").toDF("node", "root")
    )
    for finer in parted:
        roots = roots.union(finer.repartition("region").sortWithinPartitions("region").mapInArrow(_join_regions(percent), "a long, b long"))
    roots = materialize((roots.union(extra) if extra is not None else roots).filter("node != root"), "components", rows_n)
    free_shuffles(rows.sparkSession)
    # Texts are joined to their components by representative, which few share, or many: then in salted parts.
    of = reps.select("rep", "copies").join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "copies")
    of = materialize(of, "component-of", rows_n)
    rooted = spread_join(named.filter("rep IS NOT NULL"), of, "rep", "copies", some["texts"] or 0)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.min("rid").alias("component_rid"), F.count(F.lit(1)).alias("members"))
    alone = named.filter("rep IS NULL").select("rid", "id", "n", F.col("id").alias("component_id"), F.col("rid").alias("component_rid"))
    found = spread_join(rooted.drop("rep"), least, "root", "members", some["texts"] or 0)
    return found.select("rid", "id", "n", "component_id", "component_rid").unionByName(alone).withColumnsRenamed({"rid": "_rid", "n": "n_shingles"})


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with the document of the smallest identifier (null last, then the first row) of each component."""
    found = materialize(jaccard_components(docs, id_col, text_col, **options).select("_rid", "id", "component_rid"), "near")
    free_shuffles(docs.sparkSession)
    first = found.groupBy("component_rid").agg(F.min(F.struct(F.col("id").isNull(), "id", "_rid")).alias("x"))
    kept = first.select(F.col("x._rid").alias("_kept_rid"))
    dropped = materialize(found.join(kept, F.col("_rid") == F.col("_kept_rid"), "left_anti").select(F.col("_rid").alias("_dropped_rid")), "near-dropped")
    # Few documents go, so only those that may be among them are exchanged.
    sent = docs.sparkSession.sparkContext.broadcast(row_filter(dropped, dropped.count(), lambda size: filter_place("_dropped_rid", size)))

    def passing(wanted: bool):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                yield batch.filter(pa.array(passes(sent.value[0], batch.column(batch.num_columns - 1).to_numpy()) == wanted))

        return run

    numbered = with_row_id(docs, "_row_rid")
    placed = numbered.withColumn("_row_at", filter_place("_row_rid", sent.value[1]))
    sure = placed.mapInArrow(passing(False), placed.schema).drop("_row_rid", "_row_at")
    maybe = placed.mapInArrow(passing(True), placed.schema)
    return sure.unionByName(maybe.join(dropped, F.col("_row_rid") == F.col("_dropped_rid"), "left_anti").drop("_row_rid", "_row_at"))
