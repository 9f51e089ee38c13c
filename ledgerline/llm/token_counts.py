"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of identifiers in which an end-of-document
identifier closes each document; there is no index.  The file is cut into
blocks, each block is searched for the identifier with one vectorised
comparison, and a prefix scan over the blocks' totals (tokens before, documents
before, last separator before) stitches documents that cross block edges.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.rows import bound_reads, slices, with_row_id

#: Values of the public 50k byte-level vocabulary (fixed): free identifier, and its splitting pattern.
END_OF_DOCUMENT = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 16
#: Runs of white space (Unicode White_Space) that the library's pattern engine is not given: it recurses once a character.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def _cut(path: str, tokens: np.ndarray, first: int) -> pa.RecordBatch:
    parts = [tokens[i : i + BLOCK_TOKENS].tobytes() for i in range(0, len(tokens), BLOCK_TOKENS)]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(parts), pa.string()), pa.array(range(first, first + len(parts)), pa.int64()), pa.array(parts, pa.binary())],
        ["file", "block", "tokens"],
    )


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """Blocks (file, block, tokens) of the flat files at ``path``, in any store Spark reads.

    Every file is one shard of at most ``spark.sql.sources.binaryFile.maxLength`` bytes.
    """
    width = np.dtype(dtype).itemsize

    def blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, content in zip(*batch.columns, strict=True):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{name}: {data.size} bytes are not whole {width}-byte identifiers")
                yield _cut(name.as_py(), np.frombuffer(data, dtype), 0)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(blocks, "file string, block long, tokens binary")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to identifiers, of a vocabulary file of ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def encode_text(coder, text: str) -> list[int]:
    """Identifiers of a text of any length.

    The pattern makes one piece of a run of white space, without its last
    character where other text follows.  So long runs are cut out there and
    encoded as the pieces they are, and the text between them as it stands.
    """
    out: list[int] = []
    at = 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += coder.encode_ordinary(text[at : run.start()])
        out += coder._encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return out + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)


def _scan(separator: int, dtype: str = "<u2") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ``tokens`` to batches with ``n`` and ``ends`` instead, behind their other columns."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = batch.schema.get_field_index("tokens")
            n, ends = [], []
            for x in batch.column(at):
                tokens = np.frombuffer(x.as_buffer(), dtype) if x.is_valid else None
                n.append(None if tokens is None else len(tokens))
                ends.append(None if tokens is None else np.flatnonzero(tokens == separator))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                [*(batch.schema.names[i] for i in rest), "n", "ends"],
            )

    return scan


def encode_to_blocks(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, scanned: bool = False
) -> DataFrame:
    """Encode each scan partition into one flat stream of identifiers, cut into blocks (file, block, tokens, docs).

    ``docs`` is the manifest: (rid, id) of the documents whose separators lie in
    the block, in their order.  The driver reads the vocabulary and sends it
    (under 1 MB); texts that spell a special token are ordinary text.
    Identifiers take two bytes; a vocabulary that needs more, or that uses the
    separator, is an error.  With ``scanned`` the worker that makes a block also
    searches it, as :func:`find_separators` does, and the tokens stay there.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read()
    known = set(read_ranks(data).values())
    if separator in known or max(known | {separator}) >= 1 << 16:
        raise ValueError(f"{vocabulary}: identifiers must be below 65536 and leave {separator} free")
    sent = spark.sparkContext.broadcast(data)
    bound_reads(spark)

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=read_ranks(sent.value), special_tokens={})
        file = f"part-{TaskContext.get().partitionId():08d}"
        close = np.array([separator], "<u2")
        held, ends, manifest, n, block = [], [], [], 0, 0
        for whole in stream:
            for batch in slices(whole, 4 << 20):
                rid, ids, text = batch.columns
                for x in text.fill_null("").to_pylist():
                    tokens = np.array(encode_text(coder, x), "<u2")
                    held += [tokens, close]
                    n += len(tokens) + 1
                    ends.append(n - 1)
                manifest.append(pa.StructArray.from_arrays([rid, ids], ["rid", "id"]))
                if n >= BLOCK_TOKENS:
                    flat, rows = np.concatenate(held), pa.concat_arrays(manifest)
                    full = n - n % BLOCK_TOKENS
                    out = _with_manifest(_cut(file, flat[:full], block), ends, rows)
                    yield out
                    block += out.num_rows
                    done = int(np.searchsorted(ends, full))
                    held, ends, manifest, n = [flat[full:].copy()], [e - full for e in ends[done:]], [rows.slice(done)], n - full
        if n:
            yield _with_manifest(_cut(file, np.concatenate(held), block), ends, pa.concat_arrays(manifest))

    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    manifest = f"docs array<struct<rid: long, id: {dict(rows.dtypes)['id']}>>"
    if not scanned:
        return rows.mapInArrow(encode, f"file string, block long, tokens binary, {manifest}")
    scan = _scan(separator)
    return rows.mapInArrow(lambda stream: scan(encode(stream)), f"file string, block long, {manifest}, n long, ends array<long>")


def _with_manifest(blocks: pa.RecordBatch, ends: list[int], rows: pa.StructArray) -> pa.RecordBatch:
    """Give each block the rows whose separators, at ``ends`` of the stream, lie in it."""
    at = np.searchsorted(ends, np.arange(blocks.num_rows + 1) * BLOCK_TOKENS)
    return blocks.append_column("docs", pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows.slice(0, int(at[-1]))))


def find_separators(blocks: DataFrame, separator: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """Replace the tokens of each block by their number and the separators' places in it; other columns stay."""
    kept = ", ".join(f"`{c}` {t}" for c, t in blocks.dtypes if c != "tokens")
    return blocks.mapInArrow(_scan(separator, dtype), f"{kept}, n long, ends array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) per document from scanned blocks, by a prefix scan over each file's blocks.

    Tokens after a file's last separator are a last document.  The window holds
    one row per block of one file.  Blocks with a manifest ``docs`` give each
    document its entry as a column ``doc``.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    manifest = [c for c in scanned.columns if c == "docs"]
    placed = scanned.select("file", "block", "n", "ends", *manifest, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    carried = placed.select(
        "file",
        *manifest,
        F.transform("ends", lambda e: e + F.col("base")).alias("ends"),
        F.coalesce(F.max(last).over(before), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        (F.max("block").over(whole) == F.col("block")).alias("tail"),
        (F.col("base") + F.col("n")).alias("total"),
    )
    bounds = F.concat(F.array("carry"), "ends", F.when(F.col("tail") & (F.element_at(F.concat(F.array("carry"), "ends"), -1) < F.col("total") - 1), F.array("total")).otherwise(F.array().cast("array<long>")))
    cut = carried.select("file", "first", *manifest, bounds.alias("b"))
    sizes = F.transform(F.slice("b", F.lit(2), F.size("b") - 1), lambda e, i: e - F.element_at("b", (i + 1).cast("int")) - 1)
    each = cut.select("file", "first", F.posexplode(F.arrays_zip(sizes.alias("n_tokens"), *manifest)).alias("k", "x"))
    return each.select(
        "file", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), F.col("x.n_tokens").cast("long").alias("n_tokens"), *(F.col(f"x.{c}").alias("doc") for c in manifest)
    )


def count_document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: _rid, id, file, ordinal, n_tokens of its encoding in the flat files made of ``docs``.

    Null and empty texts have 0 tokens; repeated rows are counted each; a text
    of many megabytes, also of one word or of white space alone, is encoded
    whole in its task; an empty table gives an empty result.
    """
    counts = stitch(encode_to_blocks(docs, id_col, text_col, vocabulary, scanned=True))
    return counts.select(F.col("doc.rid").alias("_rid"), F.col("doc.id").alias("id"), "file", "ordinal", "n_tokens")
