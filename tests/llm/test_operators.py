"""Operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF, table
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import exact_dedup, jaccard_join, mixing, queries, quality_classifier, substring_dedup, suffix_dedup
from ledgerline.llm.html_extraction import extract_main_text, read_page
from ledgerline.llm.sentencepiece_codec import LEXICON_CHARS, PieceModel, _encode_batches, build_lexicon, decode_ids, encode, fold_lattice, lattice, units_of
from ledgerline.llm.token_counts import END_OF_DOCUMENT, PATTERN, count_document_tokens, find_separators, read_token_files, stitch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(queries.oracle_sql()[name])
    assert got == table(cursor.fetchall(), [c[0] for c in cursor.description])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40)), st.lists(st.integers(0, 2**40)))
def test_counting_quotient_filters_merge_without_loss(a, b):
    q = exact_dedup.CountingQuotientFilter
    got = q.from_bytes(q(np.array(a, np.uint64)).merge(q(np.array(b, np.uint64))).to_bytes())
    assert dict(zip(got.fingerprints().tolist(), got.count.tolist(), strict=True)) == dict(collections.Counter(a + b))


def test_flat_token_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for f in range(3):
        sizes = rng.integers(0, 90_000, 5)
        flat = np.concatenate([np.r_[rng.integers(0, 50_000, n), END_OF_DOCUMENT] for n in sizes]).astype("<u2")
        if f == 2:
            flat, sizes = np.r_[flat, 7].astype("<u2"), [*sizes, 1]
        flat.tofile(tmp_path / f"{f}.bin")
        want[f"{f}.bin"] = [int(n) for n in sizes]
    got = collections.defaultdict(list)
    for r in stitch(find_separators(read_token_files(spark, str(tmp_path)))).orderBy("file", "ordinal").collect():
        got[r["file"].rsplit("/", 1)[-1]].append(r["n_tokens"])
    assert got == want


def test_token_counts_equal_the_library(docs, texts):
    import base64

    import tiktoken

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["id"]: r["n_tokens"] for r in count_document_tokens(docs).collect()}
    assert got == {i: len(coder.encode_ordinary(t)) for i, t in texts.items()}


def test_sentencepiece_equals_the_library(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    rows = encode(docs).collect()
    assert all(r["round_trip"] for r in rows)
    assert {r["id"]: list(r["tokens"]) for r in rows} == {i: library.encode(t) for i, t in texts.items()}


def test_lattice_folds(spark, docs):
    model = PieceModel.load()
    lexicon = build_lexicon(docs, model, limit=500)
    assert lexicon and all(model.fold(u) == np.frombuffer(i, "<i4").tolist() for u, i in lexicon.items())
    toy = PieceModel("unigram", {p: (i, s) for i, (p, s) in enumerate([("a", -2.0), ("b", -2.0), ("ab", -3.5), ("ba", -1.0), ("bab", -9.0)])}, -1, 9, (b"",) * 10, False, 3)
    units = spark.createDataFrame([("abab",), ("bab",), ("axb",)], "unit string")
    got = {r["unit"]: list(r["bounds"]) for r in fold_lattice(lattice(units, toy), toy).collect()}
    assert got == {u: toy._best_path(u) for u in ("abab", "bab", "axb")}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab ▁\n\t日🙂Zé", max_size=60))
def test_fold_equals_library_on_any_text(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    model = PieceModel.load()
    ids = [i for u in units_of(text, model) for i in model.fold(u)]
    assert ids == library.encode(text)
    assert decode_ids(np.array(ids, int), model) == text.replace("▁", " ")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abteh ▁\n\t日🙂Zéͼ", max_size=40)))
def test_units_folded_side_by_side_equal_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    model = PieceModel.load()
    coded = model.fold_all({u for x in texts for u in units_of(x, model)})
    assert [np.frombuffer(b"".join(coded[u] for u in units_of(x, model)), "<i4").tolist() for x in texts] == [library.encode(x) for x in texts]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.integers(-3, -1), max_size=30), st.sets(st.text(alphabet="abcd", max_size=30)))
def test_units_folded_side_by_side_equal_the_fold_with_equal_scores(scores, units):
    toy = PieceModel("bpe", {p: (i, float(s)) for i, (p, s) in enumerate(scores.items())}, 100, 99, (), False, 4)
    assert toy.fold_all(units) == {u: np.array(toy.fold(u), "<i4").tobytes() for u in units}


def test_no_short_unit_is_folded_alone(monkeypatch):
    model = PieceModel.load()
    texts = ["Each of these wörds is new 日本 ͼ", "x" * (LEXICON_CHARS + 1), None, "", "new words " * 1000]
    ids, alone = pa.array(range(len(texts))), []
    fold = PieceModel.fold
    monkeypatch.setattr(PieceModel, "fold", lambda self, unit: alone.append(unit) or fold(self, unit))
    known = {}
    coded = _encode_batches(model)(ids, ids, texts, known)
    assert alone == ["▁" + "x" * (LEXICON_CHARS + 1)] and alone[0] not in known and "▁new" in known
    assert coded.column("round_trip").to_pylist() == [True] * 5 and coded.column("n_tokens").to_pylist()[2:4] == [0, 0]


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train = labels.filter("doc_id % 3 != 0")
    judged = {r["id"]: r["kept"] for r in quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), train).collect()}
    held = labels.filter("doc_id % 3 = 0").collect()
    good = [judged[r["doc_id"]] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    poor = [judged[r["doc_id"]] for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.1


def test_posteriors_shrink_sparse_sites(spark, tmp_path):
    rows = [(i, "x", "p", "big") for i in range(50)] + [(99, "x", "p", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(spark.read.parquet(str(tmp_path / "d")), none).collect()
    assert all(r["kept"] and abs(r["path_posterior"] - 0.5) < 1e-9 for r in out)


def test_suffix_arrays_against_brute_force(docs, texts):
    length = 200
    seen, first = collections.Counter(), {}
    for i, t in texts.items():
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            h = hash(raw[k : k + length])
            seen[h] += 1
            first.setdefault(h, (i, k))
    for keep, split in ((False, 512), (True, 512), (False, 1), (True, 1)):
        got = {r["id"]: r for r in suffix_dedup.remove_repeated_bytes(docs, keep_first=keep, split_kinds=split).collect()}
        for i, t in texts.items():
            raw = t.encode()
            gone = np.zeros(len(raw), bool)
            for k in range(len(raw) - length + 1):
                h = hash(raw[k : k + length])
                if seen[h] > 1 and not (keep and first[h] == (i, k)):
                    gone[k : k + length] = True
            rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
            assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([97, 98]), min_size=12, max_size=120), st.integers(8, 12), st.randoms())
def test_longest_previous_and_next_factors(raw, depth, rnd):
    data = np.array(raw, np.uint8)
    at = np.array(rnd.sample(range(len(data) - depth + 1), rnd.randint(1, len(data) - depth + 1)))
    rid = np.array([rnd.randint(0, 2) for _ in at])
    before, after = suffix_dedup.factor_arrays(data, at, rid, np.arange(len(at)), depth)
    strings, place = [data[i : i + depth].tobytes() for i in at], list(zip(rid, range(len(at)), strict=True))

    def common(i, j):
        return next((k for k in range(depth) if strings[i][k] != strings[j][k]), depth)

    every = range(len(at))
    assert before.tolist() == [max((common(i, j) for j in every if place[j] < place[i]), default=0) for i in every]
    assert after.tolist() == [max((common(i, j) for j in every if place[j] > place[i]), default=0) for i in every]


def sets_of(texts, width):
    out = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize(("width", "percent", "region"), [(4, 85, 2048), (5, 80, 2048), (4, 85, 3), (1, 30, 2048), (2, 50, 4)])
def test_jaccard_components_are_exact(docs, texts, width, percent, region):
    sets = sets_of(texts, width)
    held = collections.defaultdict(list)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        both = collections.Counter(j for g in s for j in held[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    found = jaccard_join.jaccard_components(docs, width=width, percent=percent, max_region=region).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_mix_meets_targets_and_agrees_with_its_takes(docs):
    documents, takes = mixing.mix_sources(docs)
    d, t = documents.toPandas(), takes.toPandas()
    per = d.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (per.target <= 3 * per["size"] + 1e-6).all() and (d.taken <= 3 * d["size"]).all()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per.index))}
    open_ = per[per.target < 3 * per["size"] - 1e-6]
    share = open_.target / open_.index.map(weights)
    assert share.max() - share.min() < 1e-6 * share.max() and abs(per.target.sum() - d["size"].sum()) < 1e-3
    t["words"] = t.to_word - t.from_word
    assert t.groupby("_rid").words.sum().to_dict() == d[d.taken > 0].set_index("_rid").taken.to_dict()
    assert mixing.mix_sources(docs)[0].toPandas().sort_values("_rid").taken.tolist() == d.sort_values("_rid").taken.tolist()
    # Any stretch of the schedule holds the sources near their shares.
    part = t[t.slot < t.slot.max() // 10].groupby("source").words.sum()
    assert (abs(part / part.sum() - per.target / per.target.sum()) < 0.01).all()


def test_style_tree_drops_what_a_site_repeats(spark, tmp_path):
    page = "<body><div class='x1'>Same words here</div><div class='x2'>{}</div></body>"
    rows = [(i, f"http://h/{i}", page.format(f"text {i} of its own")) for i in range(8)] + [(9, "http://other/1", page.format("alone"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = {r["id"]: r["text"] for r in extract_main_text(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert got[3] == "text 3 of its own" and got[9] == "Same words here alone"


def test_declared_parts_of_a_page():
    html = """<head><title>T</title><style>p{}</style></head><body><header>H</header><nav>N</nav><div class="cookie-notice">C</div><aside>S</aside>
    <article><h1>Head&amp;line</h1><script>var a="</p>";</script><p>One <b>two</b>three<p>Four<form>F</form><div class="comments">R</div></article><footer>&copy;</footer>"""
    assert read_page(html).text() == "Head&line One twothree Four"


def _removed_by_every_run(docs):
    """Removed sentences of each document when every run of consecutive sentences is hashed."""
    first, gone = {}, []
    for doc in docs:
        drop = set()
        for a in range(len(doc)):
            for b in range(a + 1, len(doc) + 1):
                run = " ".join(doc[a:b]).split()
                if len(run) >= 50 or (b - a >= 2 and len(run) >= 30):
                    if tuple(run) in first:
                        drop |= set(range(a, b))
                    first.setdefault(tuple(run), None)
        gone.append(drop)
    return gone


def test_repeated_spans_against_every_run(spark, tmp_path):
    rng = np.random.default_rng(6)
    fresh = iter(range(10**6))

    def sentence(n):
        return " ".join(f"w{next(fresh)}" for _ in range(n)) + "."

    docs = []
    for sizes in ([60, 45], [55, 12, 12], [25, 25, 4], [25, 4, 25], [10, 10, 10, 3, 3], [29, 1, 1], [49, 60, 1]):
        passage = [sentence(n) for n in sizes]
        docs += [[sentence(5), *passage, sentence(5)], [sentence(7), *passage], [*passage, sentence(9), *passage]]
    pool = [[sentence(int(n)) for n in rng.integers(1, 62, 8)] for _ in range(12)]
    for _ in range(120):
        doc = []
        for _ in range(rng.integers(0, 4)):
            passage, (a, b) = pool[rng.integers(len(pool))], sorted(rng.integers(0, 9, 2))
            doc += [*(sentence(int(n)) for n in rng.integers(1, 20, rng.integers(0, 3))), *passage[a:b]]
        docs.append(doc)
    rows = [(i, " ".join(doc)) for i, doc in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = substring_dedup.remove_repeated_spans(spark.read.parquet(str(tmp_path / "d"))).orderBy("_rid").collect()
    for r, doc, drop in zip(got, docs, _removed_by_every_run(docs), strict=True):
        assert (r["n_sentences"], r["n_removed"]) == (len(doc), len(drop))
        assert r["text"].split() == " ".join(x for i, x in enumerate(doc) if i not in drop).split()
