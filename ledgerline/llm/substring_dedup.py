"""Repeated passages by sliding sentence spans.

A span starts at every sentence and runs over the following ones until it is
long enough, and one ends at every sentence and runs back over the ones before
it; they are hashed over their words, by two hashes of 64 bits.  Spans of all
documents are joined on both, and sentences covered by a span that is not the
first of its kind (by identifier) are removed.  Only texts that lose something
are exchanged.

These spans cover what all longer runs would: in a repeated run the span from
its first sentence repeats too, and a sentence beyond that one's end closes a
run that is long enough, so the span that ends there lies inside and repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import (
    BUCKET_ITEMS,
    ROW_FILTER_BITS,
    ascii_lower,
    batches,
    bucket_blobs,
    filter_place,
    joined,
    lists,
    materialize,
    mix64,
    offsets,
    packed_texts,
    passes,
    prefix_hash,
    range_hash,
    repeated_filter,
    row_filter,
    sequence_hash,
    spread_join,
    text_of,
    top_bits,
    unpacked,
    with_row_id,
    word_spans,
)

#: Turns words' hashes into those of a second, independent sequence hash.
_SECOND = np.uint64(0xA0761D6478BD642F)

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]}")] = True


def sentences(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first word of every sentence: after a stop (and closers) or a line break, and at a text's start."""
    if not len(start):
        return np.zeros(0, np.int64)
    last = end[:-1] - 1
    for _ in range(2):
        last = np.where(_CLOSER[data[last]] & (last > start[:-1]), last - 1, last)
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    fresh = _STOP[data[last]] | (feeds[start[1:]] > feeds[end[:-1]]) | (owner[1:] != owner[:-1])
    return np.flatnonzero(np.r_[True, fresh])


def _spans(min_sentences: int, min_words: int, alone_words: int):
    """(rid, id, text) to (rid, id, sentences, and the spans' hashes, first sentences and ends)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rid, ids, text = batch.columns
        data, bounds = joined(text)
        start, end, at = word_spans(data, bounds)
        owner = text_of(at)
        head = sentences(data, start, end, owner)
        of = owner[head] if len(head) else head
        count = np.searchsorted(of, np.arange(batch.num_rows + 1))
        edge = np.r_[head, len(start)]
        index = np.arange(len(head))
        several = np.maximum(index + min_sentences, np.searchsorted(edge, edge[:-1] + min_words))
        alone = np.searchsorted(edge, edge[:-1] + alone_words)
        stop = np.minimum(several, alone)
        good = np.flatnonzero(stop <= count[1:][of]) if len(head) else index
        # Backward: the latest first sentence of a span that ends with each sentence, unless that span is there already.
        several = np.minimum(index + 1 - min_sentences, np.searchsorted(edge, edge[1:] - min_words, "right") - 1)
        begin = np.maximum(several, np.searchsorted(edge, edge[1:] - alone_words, "right") - 1)
        more = np.flatnonzero(begin >= count[:-1][of]) if len(head) else index
        more = more[stop[begin[more]] != more + 1]
        first, last = np.r_[good, begin[more]], np.r_[stop[good], more + 1]
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        words = range_hash(prefix_hash(ascii_lower(data)), start, end)
        h = range_hash(sequence_hash(words), edge[first], edge[last])
        check = range_hash(sequence_hash(mix64(words ^ _SECOND)), edge[first], edge[last])
        span_at = np.searchsorted(of[first], np.arange(batch.num_rows + 1)) if len(head) else np.zeros(batch.num_rows + 1, np.int64)
        base = count[:-1][of[first]] if len(head) else first
        return pa.RecordBatch.from_arrays(
            [
                rid,
                ids,
                pa.array(np.diff(count), pa.int64()),
                lists(h.view(np.int64), span_at),
                lists(check.view(np.int64), span_at),
                lists((first - base).astype(np.int32), span_at),
                lists((last - base).astype(np.int32), span_at),
            ],
            ["rid", "id", "n", "hash", "check", "first", "stop"],
        )

    return run


def _hash_blobs(buckets: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in stream:
            held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
            n += len(held[-1])
            if n > BUCKET_ITEMS:
                yield bucket_blobs(np.concatenate(held), buckets)
                held, n = [], 0
        if n:
            yield bucket_blobs(np.concatenate(held), buckets)

    return run


def _likely_spans(sent):
    """(rid, id, hash, check, first, stop) lists to one row per span that the filter of repeated hashes passes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = sent.value
        for batch in stream:
            lists_ = [c.flatten().to_numpy() for c in batch.columns[2:]]
            hit = np.flatnonzero(passes(bits, top_bits(lists_[0].view(np.uint64), size)))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets(batch.column(2))))[hit]
            rid, ids = (c.take(pa.array(owner)) for c in batch.columns[:2])
            yield pa.RecordBatch.from_arrays([rid, ids, *(pa.array(x[hit]) for x in lists_)], ["rid", "id", "hash", "check", "first", "stop"])

    return run


_KEPT = ["rid", "id", "n_sentences", "n_removed", "text", "kept_sha256"]


def _whole(sent):
    """(rid, id, text, at) to the results of texts that the filter does not pass: they lose nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rid, ids, text, at = batch.columns
        bits, _ = sent.value
        keep = pa.array(~passes(bits, at.to_numpy()))
        rid, ids, text = (c.filter(keep) for c in (rid, ids, text.fill_null("")))
        data, bounds = joined(text)
        start, end, word_at = word_spans(data, bounds)
        owner = text_of(word_at)
        head = sentences(data, start, end, owner)
        n = np.bincount(owner[head], minlength=len(rid)) if len(head) else np.zeros(len(rid), np.int64)
        digest = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [rid, ids, pa.array(n, pa.int64()), pa.array(np.zeros(len(rid), np.int64)), text, pa.array(digest, pa.string())], _KEPT
        )

    return run


def _without():
    """(rid, id, packed, n, ranges) to the text without the sentences in the ranges."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rid, ids, packed, n, ranges = batch.columns
            kept, gone, digest = [], [], []
            for raw, cut in zip(unpacked(packed), ranges.to_pylist(), strict=True):
                removed = 0
                if cut:
                    data = np.frombuffer(raw, np.uint8)
                    start, end, at = word_spans(data, np.array([0, len(data)]))
                    head = sentences(data, start, end, text_of(at))
                    drop = np.zeros(len(head) + 1, np.int64)
                    for r in cut:
                        drop[r["first"]] += 1
                        drop[r["stop"]] -= 1
                    drop = np.cumsum(drop)[:-1] > 0
                    edge = np.r_[0, start[head[1:]], len(data)]
                    raw = b"".join(raw[edge[i] : edge[i + 1]] for i in np.flatnonzero(~drop))
                    removed = int(drop.sum())
                gone.append(removed)
                kept.append(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rid, ids, n, pa.array(gone, pa.int64()), text, pa.array(digest, pa.string())], _KEPT)

    return run


def remove_repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_sentences: int = 2,
    min_words: int = 30,
    alone_words: int = 50,
) -> DataFrame:
    """Remove sentences covered by repeated runs, keeping each run's first occurrence.

    First is the one in the document of the smallest identifier (null last;
    rows of one identifier in table order), and there the earliest.

    Sentences end at ``.!?`` before white space and at line breaks.  Runs of
    at least ``min_sentences`` sentences with at least ``min_words`` words
    count, and shorter ones with ``alone_words``.  For every sentence the
    shortest such run that starts there and the shortest that ends there are
    joined; they cover all longer ones.  Runs are equal when their words are
    (ASCII lower case), in one document or in two; copies whose lines break
    inside sentences at other places share only the spans that end alike.  A
    removed sentence goes with the white space after it.

    Null and empty texts have no sentences and come back empty; later repeated
    rows lose what their first row has.  A text of any length is read whole in
    its task.  An empty table gives an empty result.

    Returns per row: _rid, id, n_sentences, n_removed, text, kept_sha256 (hex).
    """
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"rid long, id {kind}, n long, hash array<long>, check array<long>, first array<int>, stop array<int>"
    seen = materialize(rows.mapInArrow(batches(_spans(min_sentences, min_words, alone_words)), schema), "spans")
    # Most spans stand once: a count of hashes in buckets finds those that may not, and only they are exchanged as rows.
    n, total = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("hash")), F.lit(0))).first()
    size = min(ROW_FILTER_BITS, max(20, (4 * total).bit_length()))
    buckets = max(8, total // BUCKET_ITEMS + 1)
    often = repeated_filter(seen.select("hash").mapInArrow(_hash_blobs(buckets), "bucket long, blob binary"), size)
    known = docs.sparkSession.sparkContext.broadcast((often, size))
    spans = seen.select("rid", "id", "hash", "check", "first", "stop").mapInArrow(
        _likely_spans(known), f"rid long, id {kind}, hash long, check long, first int, stop int"
    )
    kinds = spans.groupBy("hash", "check").agg(
        F.min(F.struct(F.col("id").isNull().alias("u"), "id", "rid", "first")).alias("origin"), F.count(F.lit(1)).alias("n")
    )
    repeated = materialize(
        kinds.filter("n > 1").select(F.struct("hash", "check").alias("kind"), "origin.rid", "origin.first", "n").withColumnsRenamed({"rid": "origin_rid", "first": "origin_first"}),
        "repeated-spans", 4 * n,
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    marked = spans.select("rid", "first", "stop", F.struct("hash", "check").alias("kind"))
    later = spread_join(marked, repeated, "kind", "n", total).filter((F.col("rid") != F.col("origin_rid")) | (F.col("first") != F.col("origin_first")))
    cuts = materialize(later.groupBy(F.col("rid").alias("cut_rid")).agg(F.collect_list(F.struct("first", "stop")).alias("ranges")), "cuts", n)
    sent = docs.sparkSession.sparkContext.broadcast(row_filter(cuts, cuts.count(), lambda size: filter_place("cut_rid", size)))
    size = sent.value[1]
    result = f"rid long, id {kind}, n_sentences long, n_removed long, text string, kept_sha256 string"

    def chosen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(passes(sent.value[0], batch.column("at").to_numpy())))

    placed = rows.withColumn("at", filter_place("rid", size))
    untouched = placed.mapInArrow(batches(_whole(sent), sized=2), result)
    cut = placed.select("rid", "text", "at").mapInArrow(chosen, "rid long, text string, at long")
    facts = seen.select(F.col("rid").alias("n_rid"), "id", "n", filter_place("rid", size).alias("at")).mapInArrow(chosen, f"n_rid long, id {kind}, n long, at long").drop("at")
    facts = facts.join(cuts, F.col("n_rid") == F.col("cut_rid"), "left").drop("cut_rid")
    whole = packed_texts(cut).join(facts, F.col("rid") == F.col("n_rid")).select("rid", "id", "packed", "n", "ranges")
    return untouched.unionByName(whole.mapInArrow(_without(), result)).withColumnRenamed("rid", "_rid")
