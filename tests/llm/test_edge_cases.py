"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import (
    exact_dedup,
    html_extraction,
    jaccard_join,
    mixing,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    token_counts,
)

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS * 30)
PROSE = ". ".join(" ".join(WORDS[i : i + 12]) for i in range(0, 240, 12)) + "."
ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, PROSE + " end", "en", None),
    (None, None, None, None),
    (3, None, "en", "a"),
    (4, "", "en", ""),
    (5, " \n\t", None, "b"),
    (6, LONG, "en", "b"),
    (7, "é🙂 ß", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edge")

    def saved(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    docs = saved("docs", spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    clash = docs
    for c in ("_rid", "rid", "id", "kept", "size", "n", "key", "node", "root", "taken", "file", "block", "hash", "tokens", "host", "path", "unit"):
        clash = clash.withColumn(c, F.lit("x"))
    labels = saved("labels", spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int"))
    return {"docs": docs, "clash": saved("clash", clash), "empty": saved("none", docs.filter("false")), "labels": labels}


def ops(t):
    return {
        2: lambda d: token_counts.count_document_tokens(d),
        3: lambda d: quality_classifier.classify(d, t["labels"]),
        4: lambda d: sentencepiece_codec.encode(d),
        5: lambda d: quality_rules.quality_rules(d),
        6: lambda d: substring_dedup.remove_repeated_spans(d),
        7: lambda d: suffix_dedup.remove_repeated_bytes(d),
        8: lambda d: mixing.mix_sources(d)[0],
        9: lambda d: jaccard_join.jaccard_components(d),
        10: lambda d: exact_dedup.exact_duplicates(d),
    }


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 8, 9, 10])
def test_every_row_comes_back_with_odd_input(tables, n):
    for name in ("docs", "clash"):
        rows = ops(tables)[n](tables[name]).collect()
        assert len(rows) == len(ROWS)
        assert sorted((r["id"] is None, r["id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert ops(tables)[n](tables["empty"]).count() == 0


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_defined_results(tables):
    docs = tables["docs"]
    counts = by_id(token_counts.count_document_tokens(docs))
    assert counts[3]["n_tokens"] == counts[4]["n_tokens"] == counts[None]["n_tokens"] == 0
    coded = by_id(sentencepiece_codec.encode(docs))
    assert all(r["round_trip"] for r in coded.values()) and coded[4]["n_tokens"] == 0
    rules = by_id(quality_rules.quality_rules(docs))
    assert not rules[3]["kept"] and rules[6]["n_words"] == 12000 and rules[6]["base_failed"] and rules[1]["kept"]
    spans = substring_dedup.remove_repeated_spans(docs).orderBy("_rid").collect()
    assert [r["n_removed"] > 0 for r in spans[:3]] == [False, True, True] and spans[4]["text"] == ""
    cut = suffix_dedup.remove_repeated_bytes(docs, keep_first=False).orderBy("_rid").collect()
    assert cut[0]["n_removed"] == cut[1]["n_removed"] == len(PROSE) and cut[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    first = suffix_dedup.remove_repeated_bytes(docs).orderBy("_rid").collect()
    assert first[0]["n_removed"] == 0 and first[1]["n_removed"] == len(PROSE)
    taken = by_id(mixing.mix_sources(docs)[0])
    assert taken[3]["size"] == taken[3]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in taken.values())
    near = by_id(jaccard_join.jaccard_components(docs))
    assert near[2]["component_id"] == 1 and near[3]["component_id"] == 3 and near[None]["component_id"] is None and near[4]["n_shingles"] == 0
    same = exact_dedup.exact_duplicates(docs).collect()
    groups = {r["id"]: r["group_size"] for r in same}
    assert groups[1] == 2 and groups[5] == 4
    assert sum(r["kept"] for r in same) == 5
    blank = {r["id"]: r["keep_id"] for r in same}
    assert blank[3] == blank[4] == blank[None] == 5  # most code points stay


def test_html_edge_cases(spark, tmp_path):
    rows = [(1, "http://a.b/x", None), (2, None, ""), (None, "odd", "<p>a&amp;b <b>c</b>d<br>e"), (1, "http://a.b/x", "<div class=ad>no</div>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    out = html_extraction.extract_main_text(pages).orderBy("_rid").collect()
    assert [r["text"] for r in out] == ["", "", "a&b cd e", ""]
    assert html_extraction.extract_main_text(pages.filter("false")).count() == 0


def test_long_text_after_empty_ones_goes_in_pieces(spark, tmp_path):
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 123, 400, np.uint8).tobytes().decode()
    long = rng.integers(97, 123, 1 << 24, np.uint8).tobytes().decode() + "|" + passage + "|" + "x" * 50
    rows = [(1, "short|" + passage), (2, None), (3, ""), (4, long), (5, ""), (6, "end")]
    batch = pa.RecordBatch.from_pydict({"rid": [r[0] for r in rows], "text": [r[1] for r in rows]})
    parts = list(suffix_dedup._slices(batch))
    assert [r for p in parts for r in p.column(0).to_pylist()] == [1, 2, 3, 4, 5, 6]
    assert all(len(data) < 1 << 21 for p in parts for data, _, _ in suffix_dedup._pieces(p, 200))
    spark.createDataFrame(rows[1:] + rows[:1], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = by_id(suffix_dedup.remove_repeated_bytes(spark.read.parquet(str(tmp_path / "d")), keep_first=False))
    assert {i: r["n_removed"] for i, r in got.items()} == {1: 401, 2: 0, 3: 0, 4: 401, 5: 0, 6: 0}
