"""Quality rules: per-document counts and cross-document line frequency.

Lines are normalised (ASCII lower case, single spaces) and hashed; the distinct
documents of each host that hold a line are counted over the whole table.
Lines above the host's limit are removed, and a document that loses more than a
given share of its words is depleted and rejected.

The limit is a share of the host with a floor.  On a host of few documents
nothing is common enough to be removed, and on a host with a third of a large
corpus a line must stand in one percent of it: a license line under every tenth
page goes, a saying in one page of a thousand stays, however many pages that is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import (
    ascii_lower,
    batches,
    filter_place,
    joined,
    lists,
    materialize,
    mix64,
    packed_texts,
    passes,
    prefix_hash,
    range_hash,
    row_filter,
    sequence_hash,
    spread_join,
    text_of,
    unpacked,
    with_row_id,
    word_spans,
)

SYMBOLS = b"#*$%&|<>"
#: Frequent lines up to this many are broadcast (about 32 bytes each); more are joined by shuffle, common ones salted.
BROADCAST_LINES = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(key) else False
    return out


def lines_of(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, first word, word after the last, hash) of the lines that hold a word; lines end after their line feed."""
    edge = np.unique(np.r_[0, np.flatnonzero(data == 10) + 1, bounds]) if len(data) else np.zeros(1, np.int64)
    line_at = np.searchsorted(start, edge)
    has = np.flatnonzero(np.diff(line_at) > 0)
    first_word, last_word = line_at[has], line_at[has + 1]
    low = range_hash(prefix_hash(ascii_lower(data)), start, end)
    return edge[has], edge[has + 1], first_word, last_word, range_hash(sequence_hash(low), first_word, last_word)


def document_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(rid, id, host, text) to the base counts and the hashes and words of the distinct lines."""
    rid, ids, host, text = batch.columns
    data, bounds = joined(text)
    start, end, at = word_spans(data, bounds)
    n = np.diff(at)
    words = len(start)
    owner = text_of(at)
    lead = (data & 0xC0) != 0x80
    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=in_words[1:])
    chars = np.bincount(owner, in_words[end] - in_words[start], len(n)).astype(np.int64)
    symbols = _sums(_SYMBOL[data], bounds)

    # Words in 3-word windows that stand twice or more in their text.
    hashes = range_hash(prefix_hash(data), start, end)
    marked = np.zeros(words, bool)
    if words > 2:
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        window = range_hash(sequence_hash(hashes), whole, whole + 3) ^ mix64(owner[whole].astype(np.uint64))
        hit = whole[_repeated(window)]
        for k in range(3):
            marked[hit + k] = True
    repeats = _sums(marked, at)

    a, b, first_word, last_word, line = lines_of(data, bounds, start, end)
    line_owner = owner[first_word]
    # Raw content, without the line feed itself.
    b = b - ((data[b - 1] == 10) if len(b) else 0)
    raw = range_hash(prefix_hash(data), a, b) ^ mix64(line_owner.astype(np.uint64))
    dup = np.zeros(len(n), np.int64)
    if len(raw):
        _, kept = np.unique(raw, return_index=True)
        dup = np.bincount(line_owner, minlength=len(n)) - np.bincount(line_owner[kept], minlength=len(n))

    order = np.lexsort((line, line_owner))
    line, by, size = line[order], line_owner[order], (last_word - first_word)[order]
    fresh = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (by[1:] != by[:-1])]) if len(line) else np.zeros(0, np.int64)
    size = np.add.reduceat(size, fresh) if len(fresh) else size
    list_at = np.searchsorted(by[fresh], np.arange(len(n) + 1))
    return pa.RecordBatch.from_arrays(
        [rid, ids, host]
        + [pa.array(x.astype(np.int64)) for x in (n, chars, symbols, dup, repeats)]
        + [lists(line[fresh].view(np.int64), list_at), lists(size.astype(np.int32), list_at)],
        ["rid", "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_line_percent: int = 1,
    min_line_docs: int = 20,
    max_removed_percent: int = 50,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Judge every document, and remove the lines above the limit from its text.

    A line is above the limit when more than ``min_line_docs`` documents and
    more than ``max_line_percent`` percent of the host's documents hold it.  A
    document is rejected when it has under ``min_words`` words, when over
    ``max_repeat_percent`` percent of them stand in repeated 3-word windows, or
    when over ``max_removed_percent`` percent of them are in such lines.

    Null text has no words and is rejected; null is a host of its own.  Lines
    without a word are ignored, and stay.  Repeated rows are documents of their
    own.  Texts of any length are read whole.  An empty table gives an empty
    result.  Frequent lines are broadcast up to ``broadcast_lines`` of them.

    Returns per row: _rid, id, host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept,
    kept_sha256 (hex, of the text without the lines above the limit).
    """
    judged, rows, cuts = _judged(
        docs, id_col, text_col, host_col, min_words, max_repeat_percent, max_line_percent, min_line_docs, max_removed_percent, broadcast_lines
    )
    digests = _cleaned(rows, cuts, False).select(F.col("rid").alias("clean_rid"), "kept_sha256")
    return judged.join(digests, F.col("_rid") == F.col("clean_rid")).drop("clean_rid")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: int) -> DataFrame:
    """(_rid, id, text): every text without its host's lines above the limits of :func:`quality_rules`; null becomes empty."""
    options = {
        "min_words": 50, "max_repeat_percent": 50, "max_line_percent": 1, "min_line_docs": 20, "max_removed_percent": 50, "broadcast_lines": BROADCAST_LINES,
    }
    _, rows, cuts = _judged(docs, id_col, text_col, host_col, **(options | limits))
    texts = _cleaned(rows, cuts, True).select(F.col("rid").alias("clean_rid"), F.col("text").alias("clean"))
    return rows.select("rid", "id").join(texts, F.col("rid") == F.col("clean_rid")).select(F.col("rid").alias("_rid"), "id", F.col("clean").alias("text"))


def _cleaned(rows: DataFrame, cuts: DataFrame, with_text: bool) -> DataFrame:
    """(rid, text, kept_sha256) of every row, text null unless wanted; only texts with lines to remove are exchanged."""
    sent = rows.sparkSession.sparkContext.broadcast(row_filter(cuts, cuts.count(), lambda size: filter_place("cut_rid", size)))
    schema, names = "rid long, text string, kept_sha256 string", ["rid", "text", "kept_sha256"]
    placed = rows.select("rid", "text", filter_place("rid", sent.value[1]).alias("at"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        rid, text, at = batch.columns
        keep = pa.array(~passes(sent.value[0], at.to_numpy()))
        rid, text = rid.filter(keep), text.filter(keep).fill_null("")
        data, bounds = joined(text)
        digest = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays([rid, text if with_text else pa.nulls(len(rid), pa.string()), pa.array(digest, pa.string())], names)

    def chosen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(passes(sent.value[0], batch.column("at").to_numpy())))

    def remove(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out, digest = [], []
            for raw, gone in zip(unpacked(batch.column(1)), batch.column(2), strict=True):
                if gone.is_valid:
                    data = np.frombuffer(raw, np.uint8)
                    bounds = np.array([0, len(data)])
                    start, end, _ = word_spans(data, bounds)
                    begin, _, _, _, line = lines_of(data, bounds, start, end)
                    number = np.searchsorted(np.flatnonzero(data == 10), begin)
                    drop = set(number[np.isin(line.view(np.int64), gone.values.to_numpy())].tolist())
                    raw = b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in drop)
                out.append(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
            shown = pa.array(out, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(out), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), shown, pa.array(digest, pa.string())], names)

    untouched = placed.mapInArrow(batches(whole, sized=1), schema)
    touched = packed_texts(placed.mapInArrow(chosen, "rid long, text string, at long"))
    touched = touched.join(cuts, F.col("rid") == F.col("cut_rid"), "left").select("rid", "packed", "gone")
    return untouched.unionByName(touched.mapInArrow(remove, schema))


def _judged(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat_percent: int, max_line_percent: int,
    min_line_docs: int, max_removed_percent: int, broadcast_lines: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, rows, lines to remove as (cut_rid, gone))."""
    rows = with_row_id(docs).select(
        F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    kind = dict(rows.dtypes)["id"]
    schema = (
        f"rid long, id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, lines array<long>, line_words array<int>"
    )
    seen = materialize(rows.mapInArrow(batches(document_counts), schema), "line-counts")
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    held = seen.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # The hosts table has one row per host; the line counts meet it already aggregated.
    frequent = held.filter(F.col("n") > min_line_docs).join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    key = F.struct(F.col("host").isNull().alias("u"), F.coalesce("host", F.lit("")).alias("h"), "line")
    frequent = materialize(
        frequent.filter(100 * F.col("n") > max_line_percent * F.col("host_docs")).select(key.alias("key"), "n"), "frequent-lines", seen.count()
    )
    few, total = frequent.count() <= broadcast_lines, frequent.agg(F.sum("n")).first()[0] or 0
    lines = seen.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("rid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("own_words"))
    lines = lines.select("rid", key.alias("key"), "own_words")
    met = lines.join(F.broadcast(frequent.drop("n")), "key") if few else spread_join(lines, frequent, "key", "n", total)
    removed = met.groupBy(F.col("rid").alias("cut_rid")).agg(F.sum("own_words").alias("removed"), F.collect_list("key.line").alias("gone"))
    removed = materialize(removed, "removed-lines", seen.count())
    gone = F.coalesce("removed", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = (
        seen.drop("lines", "line_words")
        .join(removed, F.col("rid") == F.col("cut_rid"), "left")
        .select(
            F.col("rid").alias("_rid"), "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            gone.alias("n_removed_words"), failed.alias("base_failed"),
            (~failed & (100 * gone <= max_removed_percent * F.col("n_words"))).alias("kept"),
        )
    )
    return judged, rows.select("rid", "id", "text"), removed.select("cut_rid", "gone")
