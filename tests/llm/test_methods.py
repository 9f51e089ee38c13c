"""What the named methods decide, what does not depend on settings, and every stage of the pipeline."""

import collections
import hashlib
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import exact_dedup, html_extraction, jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, token_counts
from ledgerline.llm.html_extraction import declared, extract_main_text, read_page
from ledgerline.llm.rows import _written, spread_join, with_row_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def saved(df, path):
    df.coalesce(1).write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


# HTML extraction

LONG = "long text of its own " * 20
CASES = {
    '<div id="page" class="no-sidebar"><article><p>A b</p></article></div>': "A b",
    '<div class="article-body ad-free">X y</div>': "X y",
    '<main><section class="share-price-analysis">S t</section></main>': "S t",
    f'<div class="post-content"><p>{LONG}</p></div><article class="card">teaser</article>': LONG.strip(),
    "<main><p>Lead</p><article>Body</article></main>": "Lead Body",
    '<h1 class="post-title">T</h1><div class="body">whole article</div>': "T whole article",
    '<div class="main-header">MH</div><div class="body">whole article text</div>': "whole article text",
    '<div class="content with-sidebar"><p>ok</p><div class="sidebar-left">no</div></div>': "ok",
    '<h1>Title</h1><div class="article-body"><p>Body of it</p></div><div>Other</div>': "Title Body of it",
    "<form><p>Everything</p><div class=ad>no</div></form>": "Everything",
    "<article>One</article><article>Two</article><div class=comments>R</div>": "One Two",
    "<p>a&amp;b &#x41;&nbsp;c<!-- x --> d<script>if (a<b) '</p>'</script> e</p": "a&b A\xa0c d e",
    "<p title='a>b'>x</p><p hidden>y<p style='display: none'>z": "x",
}


@pytest.mark.parametrize("page", CASES)
def test_articles_stay(page):
    assert read_page(page).text() == CASES[page]


def test_declarations_are_head_nouns_of_tokens():
    told = {"no-sidebar": 2, "sidebar": 0, "sidebar-left": 0, "commentList": 0, "ad": 0, "ad-free": 2, "adroit": 2, "post-body": 3, "share": 1, "share-price": 2, "with-ads": 2, "widget": 1}
    assert {k: declared(k) for k in told} == told


@pytest.mark.parametrize("part", ["<b ", "<span>|</b>", "<b><span>|</b>", "<!-- ", '<a href="', "<p><ul>|<li>", "<div><p>|</p>x", "<script></scrip", "&<", "<title>", "</div>", "<a x='"])
def test_broken_pages_take_linear_time(part):
    first, _, second = part.partition("|")
    began = time.perf_counter()
    read_page(first * 20_000 + second * 20_000).text()
    assert time.perf_counter() - began < 5


def test_the_style_tree_decides(spark, tmp_path):
    prose = "words and more words that nobody else has written down before " * 5
    rows = []
    for i in range(8):
        page = f"<body><article class='hint'>{'Same on every page, and an article. ' * 4}</article><article><p>{prose} {i}</p></article><div class='x9'>All rights reserved</div><div class='share'>{prose[:100]} {i} {'z' * i}</div></body>"
        rows.append((i, f"http://HOST/{i}?q", page))
    rows += [(20, "http://few/1", rows[0][2]), (21, None, rows[0][2]), (3, rows[3][1], rows[3][2])]
    rows += [(30 + i, f"http://copies/{i}", f"<article><p>{prose}</p></article><div>n {i}</div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("rid", "host", "text", "place", "told", "host_key")})
    pages = saved(df, tmp_path / "p")
    got = extract_main_text(pages).orderBy("_rid").collect()
    plain = [read_page(r[2]).text() for r in rows]
    assert got[3]["text"] == f"{prose.strip()} 3" == got[10]["text"] and "Same on every page" in plain[3] and "All rights" not in got[3]["text"]
    assert got[8]["text"] == plain[8] and got[9]["text"] == plain[9]  # hosts with few pages: declarations alone
    assert all(r["text"] == prose.strip() for r in got[11:])  # copies of an article are articles
    assert [r["text"] for r in extract_main_text(pages, min_pages=1000).orderBy("_rid").collect()] == plain
    assert [tuple(r) for r in extract_main_text(pages, broadcast_places=0).orderBy("_rid").collect()] == [tuple(r) for r in got]


def test_importance_overrules_doubtful_words(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<div class='discussion'>{' '.join(f'w{i}x{k}' for k in range(100))}</div><div class='related'><a href='/'>{' '.join(f'l{i}x{k}' for k in range(100))}</a></div>") for i in range(8)]
    got = extract_main_text(saved(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path / "p")).orderBy("id").collect()
    assert got[2]["text"].startswith("w2x0 ") and "l2x0" not in got[2]["text"] and read_page(rows[2][2]).text() == ""


def test_empty_pages(spark, tmp_path):
    pages = saved(spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "x" * 3_000_000)], "page_id long, url string, html string"), tmp_path / "p")
    assert [r["n_chars"] for r in extract_main_text(pages).orderBy("_rid").collect()] == [0, 0, 3_000_000]
    assert extract_main_text(pages.filter("false")).count() == 0


# Token counts


def test_long_white_space(spark, tmp_path):
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = token_counts.read_ranks(f.read())
    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in (" " * 12_000 + "a", "a" + "\n" * 12_000, "b" + " \n" * 6_000 + "\tc" + " " * 11_000 + " " * 10_500 + "d e", " " * 10_000):
        assert token_counts.encode_text(coder, text) == coder.encode_ordinary(text)
    rows = [(1, " " * 2_000_000 + "a"), (2, "x" * 2_000_000), (3, None)]
    got = {r["id"]: r["n_tokens"] for r in token_counts.count_document_tokens(saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")).collect()}
    assert got[1] == 2_000_000 and got[2] == len(coder.encode_ordinary(rows[1][1])) and got[3] == 0
    large = tmp_path / "large.tiktoken"
    large.write_text("YQ== 0\nYg== 70000\n")
    with pytest.raises(ValueError, match="65536"):
        token_counts.encode_to_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", str(large))


def test_blocks_are_searched_where_they_are_made(spark, tmp_path):
    """One Python worker a task, no table in between, and every document's own number across block edges."""
    block = token_counts.BLOCK_TOKENS
    long = {40: block, 41: block - 1, 42: 2 * block + 5, 90: 3 * block}
    want = {i: long.get(i, (i % 3) * 2) for i in range(100)}
    docs = saved(spark.createDataFrame([(i, ("x\n" * n)[:n]) for i, n in want.items()], "doc_id long, text string"), tmp_path / "d")
    before, name = len(_written), "spark.sql.parquet.columnarReaderBatchSize"
    for given, kept in (("4096", "512"), ("100", "100")):
        spark.conf.set(name, given)
        counts = token_counts.count_document_tokens(docs)
        assert spark.conf.get(name) == kept
    assert len(_written) == before
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = counts.collect()
    assert {r["id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
    assert {(r["_rid"], r["id"]) for r in got} == {(r["_rid"], r["doc_id"]) for r in with_row_id(docs).collect()}
    for file in {r["file"] for r in got}:
        mine = sorted((r["ordinal"], r["_rid"]) for r in got if r["file"] == file)
        assert [o for o, _ in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda x: x[1])
    blocks = token_counts.encode_to_blocks(docs, "doc_id", "text")
    apart = token_counts.stitch(token_counts.find_separators(blocks)).collect()
    assert sorted((r["doc"]["id"], r["n_tokens"]) for r in apart) == sorted(want.items())
    spark.conf.unset(name)


# Quality classifier


def test_posteriors_shrink_as_in_closed_form_and_decide(spark, tmp_path):
    rng = np.random.default_rng(3)
    good, bad, even = ([f"{k}word{i}" for i in range(60)] for k in "gbn")
    text = lambda words, n=40: " ".join(rng.choice(words, n))
    rows, labels = [], []
    for i in range(400):
        ok = i % 2 == 0
        rows.append((i, text(good if ok else bad), "en", "train"))
        labels.append((i, int(ok), 0))
    twin = " ".join([*even[:20], *good[:3], *bad[:3]])
    for i in range(200):
        rows.append((1000 + i, text(good), "en", "fine"))
        rows.append((2000 + i, text(bad), "en", "poor"))
    rows += [(5000, twin, "en", "fine"), (5001, twin, "en", "poor"), (5002, text(bad), "en", "tiny"), (5003, text(good), None, None), (5004, twin, "xx", "poor")]
    d = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tmp_path / "d")
    out = quality_classifier.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    out[["host", "path"]] = out[["host", "path"]].fillna("~")
    out["e"] = (out.evidence * 1e6).round() / 1e6
    paths = out.groupby(["host", "path"], as_index=False).agg(n=("e", "size"), good=("e", "sum"))
    mean = paths.good.sum() / paths.n.sum()

    def strength(g):
        between = (((g.n * (g.good / g.n - g.prior) ** 2).sum()) - (len(g) - 1) * mean * (1 - mean)) / (g.n.sum() - (g.n**2).sum() / g.n.sum())
        return min(max(mean * (1 - mean) / max(between, 1e-6) - 1, 1.0), 1e6)

    hosts = paths.groupby("host", as_index=False).agg(n=("n", "sum"), good=("good", "sum"))
    hosts["prior"] = mean
    s = strength(hosts)
    hosts["prior"] = (hosts.good + s * mean) / (hosts.n + s)
    sites = paths.merge(hosts[["host", "prior"]], on="host")
    t = strength(sites)
    want = out.merge(sites, on=["host", "path"])
    want["pp"] = (want.good - want.evidence + t * want.prior) / (want.n - 1 + t)
    assert np.allclose(want.host_posterior, want.prior, atol=1e-6) and np.allclose(want.path_posterior, want.pp, atol=1e-6)
    by = out.set_index("id")
    assert by.evidence[5000] == by.evidence[5001] and by.posterior[5000] > 0.5 > by.posterior[5001] and by.kept[5000] and not by.kept[5001]
    tiny, poor = hosts.set_index("host").prior["tiny"], hosts.set_index("host").prior["poor"]
    assert poor < tiny < mean  # one page moves a host less than two hundred
    # Repeated identifiers and rows beyond a cap no longer change the fit.
    twice = saved(d.unionAll(d.filter("doc_id < 400")), tmp_path / "e")
    again = quality_classifier.classify(twice, spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")).filter("id >= 1000").toPandas().set_index("id")
    assert np.allclose(again.p_quality.sort_index(), by.p_quality[by.index >= 1000].sort_index())


# Codec


def test_every_unit_through_the_lattice(spark, docs):
    a = {r["id"]: list(r["tokens"]) for r in sentencepiece_codec.encode(docs).collect()}
    rows = sentencepiece_codec.encode_joined(docs).collect()
    assert {r["id"]: list(r["tokens"]) for r in rows} == a and all(r["round_trip"] for r in rows)


def test_best_paths(spark):
    model = sentencepiece_codec.replace(sentencepiece_codec.PieceModel.load(), kind="unigram")
    rows = sentencepiece_codec.viterbi_units(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert len(rows) > 500
    for r in rows:
        b = model._best_path(r["unit"])
        assert list(r["pieces"]) == [r["unit"][i:j] for i, j in zip(b, b[1:], strict=False)]


# Quality rules


def test_frequent_lines_are_removed(spark, tmp_path):
    rows = [(i, f"Shared  LINE here\nown line {i}\n\nshared line here", "en", None if i % 2 else "a") for i in range(60)] + [(99, "shared line here", "en", "b"), (100, None, "en", "a")]
    d = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tmp_path / "d")
    texts = {r["id"]: r["text"] for r in quality_rules.without_frequent_lines(d).collect()}
    assert texts[3] == "own line 3\n" and texts[99] == "shared line here" and texts[100] == ""
    judged = [quality_rules.quality_rules(d, broadcast_lines=n).orderBy("id").collect() for n in (100_000, 0)]
    assert judged[0] == judged[1] and judged[0][0]["n_removed_words"] == 6 and judged[0][0]["kept_sha256"] == hashlib.sha256(b"own line 0\n").hexdigest()


# Mixing


def test_mix_does_not_depend_on_splits(spark, docs):
    name, out = "spark.sql.files.minPartitionNum", []
    try:
        for n in ("1", "64"):
            spark.conf.set(name, n)
            out.append({r["id"]: r["taken"] for r in mixing.mix_sources(docs)[0].collect()})
    finally:
        spark.conf.unset(name)
    assert out[0] == out[1] and len(set(out[0].values())) > 20
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(docs, plan=mixing.MixPlan(max_sources=1))


# Joins


def test_packed_signatures_of_many_texts():
    rid = np.arange(70_000) * 3 + (5 << 33)
    sig = np.arange(140_000, dtype=np.uint64) << np.uint64(3)
    local = np.r_[np.arange(70_000), np.arange(70_000)[::-1]]
    got, low = jaccard_join._unpack(jaccard_join._pack(rid, sig, local))
    assert (got == rid[local]).all() and (low == sig).all()


def test_regions_by_shuffle(docs):
    a, b = (jaccard_join.jaccard_components(docs, broadcast_nodes=n).orderBy("id", "_rid").collect() for n in (200_000, 0))
    assert a == b


def test_members_that_share_common_lines_only_do_not_all_meet(spark, monkeypatch):
    line = " ".join(f"c{i}" for i in range(40))
    texts = [f"{line} {' '.join(f'u{i}x{j}' for j in range(16))}" for i in range(60)]
    texts += [f"{texts[0]} end", f"{texts[1]} end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def one_region(*_):
        none = lambda n: np.zeros(n, np.uint64)
        return lambda stream: (jaccard_join._dealt(b.column(0).to_numpy(), none(len(b)), np.arange(len(b)), 8) for b in stream if len(b))

    monkeypatch.setattr(jaccard_join, "_cell_blobs", one_region)
    monkeypatch.setattr(jaccard_join, "_hot_links", lambda *_: pytest.fail("all members against all"))
    found = {r["id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows, max_region=16).collect()}
    assert found == {i: {60: 0, 61: 1}.get(i, i) for i in range(len(texts))}


@pytest.mark.parametrize("percent", [30, 80, 85])
def test_linked_sets_share_a_rare_signature(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(300):
        base = rng.integers(1, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        near = np.r_[base[rng.random(len(base)) < 0.93], rng.integers(1, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]
        sets += [np.unique(x) for x in (base, near) if len(x)]
    h, at = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
    listed = np.sort(rng.choice(np.unique(h), 500, replace=False))
    sig, of = jaccard_join.rare_signatures(h, at, np.ones(len(sets), np.int64), jaccard_join.SizeClasses(percent), listed, rng.integers(1, 9, 500))
    names = [set(sig[of == i].tolist()) for i in range(len(sets))]
    linked = [(i, j) for i in range(len(sets)) for j in range(max(0, i - 2), i) if 100 * len(a := np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - len(a))]
    assert len(linked) > 50 and all(names[i] & names[j] for i, j in linked)


@pytest.mark.parametrize("percent", [30, 80, 85])
def test_linked_sets_share_a_rare_part(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(300):
        base = rng.integers(1, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        near = np.r_[base[rng.random(len(base)) < 0.93], rng.integers(1, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]
        sets += [np.unique(x) for x in (base, near) if len(x)]
    h, at = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
    listed = np.sort(rng.choice(np.unique(h), len(h) // 3, replace=False))
    linked = [(i, j) for i in range(len(sets)) for j in range(max(0, i - 2), i) if 100 * len(a := np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - len(a)) and len(a) < len(sets[i] if len(sets[i]) > len(sets[j]) else sets[j])]
    assert len(linked) > 50
    for deal in range(1, 5):
        sig, of = jaccard_join.rare_parts(h, at, np.ones(len(sets), np.int64), jaccard_join.SizeClasses(percent), listed, rng.integers(1, 9, len(listed)), deal)
        names = [set(sig[of == i].tolist()) for i in range(len(sets))]
        assert all(names[i] & names[j] for i, j in linked)


def test_members_that_meet_in_single_shingles_do_not_all_meet(spark, monkeypatch):
    n = 60
    runs = {(i, (i + k) % n): " ".join(f"s{i}x{k}w{w}" for w in range(5)) for i in range(n) for k in range(1, 11)}
    texts = [" ".join(f"{run} u{i}x{j}" for j, run in enumerate(r for pair, r in runs.items() if i in pair)) for i in range(n)]
    texts += [f"{texts[0]} end", f"{texts[1]} end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def one_region(*_):
        none = lambda n: np.zeros(n, np.uint64)
        return lambda stream: (jaccard_join._dealt(b.column(0).to_numpy(), none(len(b)), np.arange(len(b)), 8) for b in stream if len(b))

    monkeypatch.setattr(jaccard_join, "_cell_blobs", one_region)
    monkeypatch.setattr(jaccard_join, "COMMON_SHINGLES", 1)
    monkeypatch.setattr(jaccard_join, "_hot_links", lambda *_: pytest.fail("all members against all"))
    found = {r["id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows, max_region=16).collect()}
    assert found == {i: {60: 0, 61: 1}.get(i, i) for i in range(len(texts))}


def test_tiles_are_written_a_few_columns_at_once(spark, monkeypatch):
    n, chunk = 40, 4
    sets = spark.createDataFrame([(0, i, np.arange(5 * i, 5 * i + 5).astype(np.uint64).tobytes()) for i in range(n)], "region long, rid long, set binary")
    sizes = spark.createDataFrame([(0, n)], "size_region long, size long")
    degrees = spark.createDataFrame([(i, 1) for i in range(n)], "node long, degree long")
    written, write = [], jaccard_join.materialize

    def counted(df, name, *rows):
        out = write(df, name, *rows)
        written.extend([out.collect()] if name == "tile-links" else [])
        return out

    def every_row(_):
        return lambda stream: (pa.RecordBatch.from_arrays([b.column(1), pa.array(np.where(b.column(2).to_numpy(zero_copy_only=False), -1, -2))], ["a", "b"]) for b in stream)

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "_join_tiles", every_row)
    monkeypatch.setattr(jaccard_join, "TILE_COLUMNS", 2)
    jaccard_join._hot_links(sets, sizes, degrees, 80, chunk)
    rows = [tuple(r) for part in written for r in part]
    assert len(written) == 5 and max(map(len, written)) <= 2 * 2 * n + 2 * n
    # Every outer document (all but the pivot) meets every chunk of members, and every member every chunk of outer documents.
    assert sorted(rows) == sorted([(i, -1) for i in range(1, n) for _ in range(n // chunk)] + [(i, -2) for i in range(n) for _ in range(n // chunk)])


def test_only_members_of_regions_are_exchanged(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate([*texts, f"{texts[7]} end"])), "doc_id long, text string")
    moved, pack = [], jaccard_join.packed_texts
    monkeypatch.setattr(jaccard_join, "packed_texts", lambda df: moved.append(df.count()) or pack(df))
    found = {r["id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows, broadcast_nodes=0).collect()}
    assert found == {i: 7 if i == 300 else i for i in range(301)}
    assert moved[0] < 10


def test_spread_join_equals_a_join(spark):
    left = spark.range(3000).selectExpr("id AS rid", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 200 END AS k")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).filter("k != 7").withColumn("v", F.col("k") * 2)
    want = sorted((r["rid"], r["k"], r["v"]) for r in left.join(right, "k", "left").collect())[:]
    got = spread_join(left, right, "k", "w", 3000, "left", parts=16).collect()
    assert sorted(((r["rid"], r["k"], r["v"]) for r in got), key=repr) == sorted(want, key=repr)


# Long rows


def test_one_word_and_one_space_run(spark, tmp_path):
    rows = [(1, "w" * 2_500_000, "en", "a"), (2, " " * 2_500_000, "en", "a"), (3, "w" * 2_500_000, "en", "a"), (4, "a b", "en", "b")]
    d = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tmp_path / "d")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ids = lambda df, *c: {r["id"]: tuple(r[x] for x in c) for r in df.collect()}
    assert ids(quality_classifier.classify(d, none), "kept")[1] == (True,)
    assert ids(sentencepiece_codec.encode(d), "round_trip")[1] == (True,) and ids(sentencepiece_codec.encode(d), "round_trip")[2] == (True,)
    assert ids(quality_rules.quality_rules(d), "n_words", "word_chars")[1] == (1, 2_500_000)
    assert ids(substring_dedup.remove_repeated_spans(d), "n_removed") == {1: (0,), 2: (0,), 3: (0,), 4: (0,)}
    assert ids(suffix_dedup.remove_repeated_bytes(d, keep_first=False), "n_removed") == {1: (2_500_000,), 2: (2_500_000,), 3: (2_500_000,), 4: (0,)}
    assert ids(mixing.mix_sources(d)[0], "size") == {1: (1,), 2: (0,), 3: (1,), 4: (2,)}
    assert ids(jaccard_join.jaccard_components(d), "component_id") == {1: (1,), 2: (2,), 3: (1,), 4: (4,)}
    assert ids(exact_dedup.exact_duplicates(d), "keep_id") == {1: (1,), 2: (2,), 3: (1,), 4: (4,)}


# Pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output at the smallest scale."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, SF)
        done.write.parquet(f"{root}/{k}")
        done = spark.read.parquet(f"{root}/{k}")
        out.append((docs, done))
        docs = done
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes and after.count()


def test_quality_stage_drops_what_the_classifier_rejects(spark, stages):
    before, after = stages[0]
    kept = {r["id"] for r in quality_classifier.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and after.count() < before.count()


def test_exact_stage_against_brute_force(stages):
    before, after = stages[1]
    best = {}
    for r in before.collect():
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for _, i in best.values())


def test_near_stage_against_brute_force(stages):
    before, after = stages[2]
    sets = {}
    for r in before.collect():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in held[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({find(i) for i in sets})


def test_mix_stage_comes_near_its_targets(stages):
    before, after = stages[3]
    words = lambda df: df.select("doc_id", F.coalesce("source", F.lit("~")).alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("n")).toPandas()
    a, b = words(before), words(after)
    size = a.groupby("source").n.sum()
    targets = pd.Series(mixing.targets([int(x) for x in size], [(5, 2, 1)[i % 3] for i in range(len(size))], 3), size.index)
    got = b.groupby("source").n.sum().reindex(size.index).fillna(0)
    longest = a.groupby("source").n.max()
    assert (abs(got - targets) <= 0.05 * targets + 2 * longest).all() and b.doc_id.value_counts().max() <= 3 and set(b.doc_id) <= set(a.doc_id)


def test_token_stage_round_trips(stages):
    before, after = stages[4]
    model = sentencepiece_codec.PieceModel.load()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert sentencepiece_codec.decode_ids(np.array(r["tokens"]), model) == (texts[r["doc_id"]] or "").replace("▁", " ") and r["n_tokens"] == len(r["tokens"])


def test_run_is_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], tuple(r["tokens"])) for r in got.collect()) == sorted((r["doc_id"], tuple(r["tokens"])) for r in stages[-1][1].collect())


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, rid long, copies string"
    rows = [(1, None, None, None, None, 1, "x"), (1, "", "en", "a", 0, 1, "x"), (None, "some words of a short text " * 9, "en", "a", 5, 1, "x"), (2, "some words of a short text " * 9, "en", None, 5, 1, "x")]
    for k, part in enumerate((rows, [])):
        docs = saved(spark.createDataFrame(part, kind), tmp_path / f"in{k}")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            out.write.parquet(str(tmp_path / f"out{k}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"out{k}{i}"))
        assert bool(docs.count()) == bool(part) or docs.count() == 0
