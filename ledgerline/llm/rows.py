"""Row numbers, shared intermediate tables and byte-level helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits on.
SPACE = b" \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share (``spark.checkpoint.dir``).

    A session of one process that names none gets a temporary one; on a cluster
    a missing name is an error, for executors do not share local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


#: Rows of a table of numbers that are worth a file of their own.
FILE_ROWS = 200_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``rows``: how many rows of numbers there are at most; few rows then go to
    few files, whatever the session's number of partitions.

    Cuts the lineage: a lost executor costs a reread of these files, not the
    work before them.  The folders go when the driver's Python ends, or with
    :func:`drop_materialized`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    narrow = df if rows is None else df.coalesce(max(4, -(-rows // FILE_ROWS)))
    narrow.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table needs any more: it does so when the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def drop_materialized() -> None:
    """Delete every folder :func:`materialize` wrote, if its session is alive."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows of a file scan: partition index and position in it.

    Splits of a scan follow from the files and the session's settings, so the
    same numbers come from every pass of one session over the same tables, also
    after lost executors, but another session may number otherwise: results
    must not depend on them, but for ties among equal rows.  For frames that
    are not plain scans, materialize the result before it is used twice.
    """
    bound_batches(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


#: Bytes of a batch between Spark and Python at most, unless one row has more.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session send smaller Arrow batches to Python: each is there several times over, in every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows that Spark's Parquet reader decodes at once at most.
READ_ROWS = 512


def bound_reads(spark: SparkSession) -> None:
    """Let the session decode fewer rows at once: a column of texts is one array a task, doubled until they fit, and the heap grows by it."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))


#: A key with more than one part in so many of all rows is dealt to several tasks.
HOT_PARTS = 1024


def spread_join(
    left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", by: str = "rid", parts: int = HOT_PARTS
) -> DataFrame:
    """Join ``left`` with ``right`` on ``key`` so that no key fills a task.

    right: one row per key; ``weight`` tells how many rows of ``left`` have it,
    of ``total`` in all.  A key with more than 1/parts of the rows is salted: its
    left rows are dealt by a hash of ``by``, its right row goes to every salt.  There are
    fewer than ``parts`` such keys, so their list may be broadcast at any size.
    The result has the columns of both, the key once, without the weight.
    """
    salts = F.ceil(F.col(weight) * parts / F.lit(max(total, 1))).cast("int")
    salted = right.withColumn("_salts", F.when(F.col(weight) * parts > total, F.least(salts, F.lit(parts))).otherwise(F.lit(1)))
    hot = F.broadcast(salted.filter("_salts > 1").select(F.col(key).alias("_hot_key"), F.col("_salts").alias("_hot_salts")))
    deal = F.pmod(F.xxhash64(F.col(by), F.lit("salt")), F.coalesce("_hot_salts", F.lit(1)))
    dealt = left.join(hot, left[key] == F.col("_hot_key"), "left").withColumn("_salt", deal.cast("int")).drop("_hot_key", "_hot_salts")
    copies = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", weight)
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


#: Bits of a row filter at most (32 MB); fewer for few rows.
ROW_FILTER_BITS = 28


def filter_place(column: str, size: int) -> Column:
    """The bit of a row number in a filter of 2**size bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - size)


def row_filter(keys: DataFrame, n: int, place: Callable[[int], Column]) -> tuple[np.ndarray, int]:
    """(bits, size): a filter that passes every given key and few others; place(size) is a key's bit.

    Executors set the bits; at most 2**(ROW_FILTER_BITS - 6) words come to the
    driver, however many keys there are.  With very many keys it passes more
    of the others, which costs work, never rows.  n: how many there are, about.
    """
    size = min(ROW_FILTER_BITS, max(16, (16 * n).bit_length()))
    words = keys.select(place(size).alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits, size


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places of a filter are set."""
    return (bits.view(np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def batches(
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], max_bytes: int = 1 << 20, sized: int = -1
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Make a ``mapInArrow`` function of one that takes bounded slices.

    Column ``sized`` (a string or binary column) decides where to cut: a slice
    holds at most ``max_bytes`` of it, or a single longer row.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, max_bytes, sized):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


def slices(batch: pa.RecordBatch, max_bytes: int, sized: int = -1) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = np.diff(offsets(batch.column(sized % batch.num_columns)))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if start < i and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    """Start of each value in the buffer, and the last one's end."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null: none."""
    wide = pa.types.is_large_string(column.type)
    return column.fill_null("").cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none) as one array, and the bounds of each value in it."""
    if column.null_count:
        column = column.fill_null("")
    off = offsets(column)
    buf = column.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buf, np.uint8)[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        tables = []
        for base in (_BASE, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            tables.append(p)
        _powers[0] = have = (tables[0], tables[1])
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the hash of data[a:b] is (H[b] - H[a]) * INV**a modulo 2**64."""
    power, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end], equal for equal content wherever it stands."""
    _, inverse = _power_table(len(prefix))
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Everything but ASCII letters, digits and bytes of other scripts.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False


def word_spans(
    data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it.

    data: bytes of texts joined without separators; words never cross a bound.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(data)]
    begins[cut] |= inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    ends[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_of(at: np.ndarray) -> np.ndarray:
    """For each item the number of its text, from the items before each text."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def sequence_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`range_hash` over 64-bit items instead of bytes."""
    power, _ = _power_table(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values) * power[: len(values)], out=out[1:])
    return out


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """One list per text."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def runs_of_key(stream: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of every run of equal keys in a partition sorted by that column; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in stream:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


#: Hashes in a bucket of :func:`repeated_filter`, about, and in a blob.
BUCKET_ITEMS = 2_000_000


def bucket_blobs(hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, blob): the different hashes of each bucket, and whether each stood twice already."""
    value, count = np.unique(hashes, return_counts=True)
    bucket = ((value >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    value, count, bucket = value[order], count[order], bucket[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    pairs = list(zip(cuts, cuts[1:], strict=False))
    blobs = [value[a:b].tobytes() + (count[a:b] > 1).tobytes() for a, b in pairs]
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in pairs], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def repeated_filter(blobs: DataFrame, size: int) -> np.ndarray:
    """Bits of a filter of 2**size that passes every hash that stands twice in blobs (bucket, blob), by its highest bits."""

    def repeated(_, pdf):
        import pandas as pd

        values, twice = [], []
        for blob in pdf["blob"]:
            n = len(blob) // 9
            values.append(np.frombuffer(blob, np.uint64, n))
            twice.append(np.frombuffer(blob, bool, n, 8 * n))
        value, twice = np.concatenate(values), np.concatenate(twice)
        order = np.argsort(value, kind="stable")
        value, twice = value[order], twice[order]
        head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        often = (np.diff(np.r_[head, len(value)]) > 1) | np.logical_or.reduceat(twice, head)
        word, at = np.divmod(np.unique(top_bits(value[head[often]], size)), 64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
        bits = np.bitwise_or.reduceat(np.uint64(1) << at.astype(np.uint64), starts) if len(word) else at.astype(np.uint64)
        return pd.DataFrame({"word": word[starts], "bits": bits.view(np.int64)})

    words = blobs.groupBy("bucket").applyInPandas(repeated, "word long, bits long")
    table = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**size / 64 rows
    out = np.zeros((1 << size) // 64, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def top_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - size)).astype(np.int64)


def packed_texts(rows: DataFrame) -> DataFrame:
    """(rid, text) to (rid, packed): Zstandard frames of the UTF-8 bytes, a third of what a shuffle would hold."""

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=3)
        for batch in stream:
            packed = [coder.compress(x) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rid", "packed"])

    return rows.select("rid", "text").mapInArrow(pack, "rid long, packed binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    coder = zstandard.ZstdDecompressor()
    for x in column:
        yield coder.decompress(x.as_py()) if x.is_valid else b""
