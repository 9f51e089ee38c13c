"""Exact duplicates by counting quotient filters and byte verification.

Each scan partition builds a counting quotient filter over the fingerprints of
its texts: a fingerprint splits into block, quotient and remainder, remainders
stand sorted inside their quotient's run, and equal ones raise a counter.  The
filters of one block merge without loss by merging sorted remainders and adding
counters.  Texts whose merged counter is above one are fetched again and
compared byte for byte; all others are unique for certain, and a filter of the
repeated fingerprints keeps them out of every exchange.

A third of all rows may be one text: every task sends one counter, and one
text to verify, for it, and its rows meet their group in salted parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import SPACE, materialize, passes, raw_texts, row_filter, slices, spread_join, with_row_id

REMAINDER_BITS = 32
#: Fingerprints in a merged block, about; the number of blocks follows the rows.
BLOCK_ITEMS = 1 << 19


class CountingQuotientFilter:
    """Multiset of (quotient, remainder) kept as sorted runs.

    ``occupied`` are the quotients that have a run, ``runend`` the slot after
    each run, ``remainder`` the slots in order, ``count`` their counters.
    """

    def __init__(self, fingerprint: np.ndarray, count: np.ndarray | None = None):
        count = np.ones(len(fingerprint), np.int64) if count is None else count
        order = np.argsort(fingerprint, kind="stable")
        fp, n = fingerprint[order], count[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
        fp = fp[first]
        self.count = np.add.reduceat(n, first) if len(first) else n
        quotient = fp >> np.uint64(REMAINDER_BITS)
        self.remainder = (fp & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.uint32)
        heads = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(fp) else np.zeros(0, np.int64)
        self.occupied = quotient[heads]
        self.runend = np.r_[heads[1:], len(fp)].astype(np.int64) if len(fp) else heads

    def fingerprints(self) -> np.ndarray:
        runs = np.diff(np.r_[0, self.runend])
        return (np.repeat(self.occupied, runs) << np.uint64(REMAINDER_BITS)) | self.remainder.astype(np.uint64)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return CountingQuotientFilter(
            np.r_[self.fingerprints(), other.fingerprints()], np.r_[self.count, other.count]
        )

    def to_bytes(self) -> bytes:
        head = np.array([len(self.occupied), len(self.remainder)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.runend, self.remainder, self.count))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        runs, slots = np.frombuffer(data, np.int64, 2)
        self = cls.__new__(cls)
        at = 16
        self.occupied = np.frombuffer(data, np.uint64, runs, at)
        self.runend = np.frombuffer(data, np.int64, runs, at := at + 8 * runs)
        self.remainder = np.frombuffer(data, np.uint32, slots, at := at + 8 * runs)
        self.count = np.frombuffer(data, np.int64, slots, at + 4 * slots)
        return self


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, id, text) to (rid, id, code points, SHA-256 of the text without white space)."""
    for batch in stream:
        rid, ids, text = batch.columns
        text = text.fill_null("")
        points = pc.utf8_length(text).cast(pa.int64())
        sha = [hashlib.sha256(x.translate(None, SPACE)).digest() for x in raw_texts(text)]
        yield pa.RecordBatch.from_arrays([rid, ids, points, pa.array(sha, pa.binary())], ["rid", "id", "points", "sha"])


def _fingerprints(sha: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in sha.to_pylist()), ">u8").astype(np.uint64)


def _build(block_bits: int):
    """One filter per block for the fingerprints of a partition."""

    def build(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_fingerprints(b.column(0)) for b in stream]
        fp = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        block = (fp >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fp), np.int64)
        order = np.argsort(block, kind="stable")
        fp, block = fp[order], block[order]
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(fp) else []
        cuts = [*at, len(fp)]
        filters = [CountingQuotientFilter(fp[a:b]).to_bytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(block[a]) for a in at], pa.int64()), pa.array(filters, pa.binary())], ["block", "filter"]
        )

    return build


def _merge(_, pdf):
    import pandas as pd

    parts = [CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]]
    while len(parts) > 1:
        parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    fp = parts[0].fingerprints()[parts[0].count > 1]
    return pd.DataFrame({"fp": fp.astype(np.int64)})


def _flag(sent):
    """Digest rows with ``maybe``: whether the filter of repeated fingerprints passes them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = sent.value
        for batch in stream:
            maybe = passes(bits, (_fingerprints(batch.column("sha")) >> np.uint64(64 - size)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

    return run


def _candidates(sent):
    """The different texts of a task that the filter passes, without white space, as Zstandard frames."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, done = zstandard.ZstdCompressor(level=3), set()
        bits, size = sent.value
        for whole in stream:
            for batch in slices(whole, 16 << 20):
                rows = []
                for x in raw_texts(batch.column(0)):
                    raw = x.translate(None, SPACE)
                    sha = hashlib.sha256(raw).digest()
                    at = int.from_bytes(sha[:8], "big") >> (64 - size)
                    if bits[at >> 6] >> (at & 63) & 1 and sha not in done:
                        done.add(sha)
                        rows.append((int.from_bytes(sha[:8], "big", signed=True), sha, coder.compress(raw)))
                if rows:
                    fp, sha, packed = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp, pa.int64()), pa.array(sha, pa.binary()), pa.array(packed, pa.binary())], ["fp", "sha", "packed"]
                    )

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts and choose the row of each group that stays.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null
    counts as empty, so null, empty and blank texts form one group.  The row
    with the most code points in its original text stays, then the smallest
    identifier (null last), then the first row.  Texts of any length are
    compared whole.  An empty table gives an empty result.

    Returns per row: _rid, id, keep_id, keep_rid, group_size, kept, sha (hex).
    """
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"rid long, id {kind}, points long, sha binary"
    seen = materialize(rows.mapInArrow(_digests, schema), "digests")
    n = seen.count()
    block_bits = max(0, min(30, (n // BLOCK_ITEMS).bit_length()))
    filters = seen.select("sha").mapInArrow(_build(block_bits), "block long, filter binary")
    repeated = materialize(filters.groupBy("block").applyInPandas(_merge, "fp long"), "repeated-fingerprints", n)
    sent = docs.sparkSession.sparkContext.broadcast(
        row_filter(repeated, repeated.count(), lambda size: F.shiftrightunsigned("fp", 64 - size))
    )
    texts = rows.select("text").mapInArrow(_candidates(sent), "fp long, sha binary, packed binary")
    same = (
        texts.join(repeated, "fp", "left_semi")
        .groupBy("sha")
        .agg(F.min("packed").alias("low"), F.max("packed").alias("high"))
        .select("sha", F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.lit(True)).cast("boolean").alias("verified"))
        .filter("verified")
        .select("sha")
    )
    flagged = seen.mapInArrow(_flag(sent), f"{schema}, maybe boolean")
    groups = (
        flagged.filter("maybe")
        .groupBy("sha")
        .agg(
            F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("u"), "id", "rid")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .join(same, "sha", "left_semi")
        .select("sha", F.col("first.id").alias("first_id"), F.col("first.rid").alias("first_rid"), "n", F.col("n").alias("group_rows"))
    )
    groups = materialize(groups, "groups", n)
    no_group = [F.lit(None).cast(t).alias(c) for c, t in groups.dtypes if c not in ("sha", "group_rows")]
    alone = flagged.filter("NOT maybe").select("rid", "id", "sha", *no_group)
    met = spread_join(flagged.filter("maybe").select("rid", "id", "sha"), groups, "sha", "group_rows", n, "left")
    return alone.unionByName(met).select(
        F.col("rid").alias("_rid"),
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("first_rid", "rid").alias("keep_rid"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("first_rid", "rid") == F.col("rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("sha"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the row of each group that stays; all columns as they were."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("_rid").alias("_kept_rid"))
    numbered = with_row_id(docs, "_row_rid")
    return numbered.join(kept, numbered["_row_rid"] == kept["_kept_rid"], "left_semi").drop("_row_rid")
