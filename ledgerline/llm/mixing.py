"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule has the point ``frac(t * golden ratio)``, which a table
of cumulative target shares maps to a source.  Slots are ranked per source; the
r-th slot of a source takes the r-th of equal-token blocks of that source's
shuffled stream, which starts again from its first document when it is used up.
A source with K slots and a target of T tokens has blocks of T/K tokens (up to
rounding to whole tokens), so its slots add up to the target.

Nothing is gathered per source: ranks and running token counts are sums inside
bounded chunks plus a prefix over the chunks' totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.rows import batches, joined, materialize, prefix_hash, range_hash, with_row_id, word_spans

#: frac(t * golden ratio) as a fraction of 2**32, with t modulo 2**31 to stay inside 64 bits.
GOLDEN_STEP = 2654435769
GOLDEN_SIZE = 1 << 32
SLOT_PERIOD = 1 << 31


@dataclass(frozen=True)
class MixPlan:
    """Parameters of a mix.

    weights repeat over the sources in code-point order, null last; a source is
    repeated at most ``max_epochs`` times; blocks hold about ``block_tokens``,
    fewer where the schedule would have less than ``min_slots`` slots.  The
    driver holds about 200 bytes for each of at most ``max_sources`` sources.
    """

    weights: Sequence[float] = (5, 2, 1)
    max_epochs: int = 3
    block_tokens: int = 1024
    min_slots: int = 1 << 16
    chunk_rows: int = 1 << 14
    max_sources: int = 500_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_epochs: float) -> list[float]:
    """Share the sum of sizes by weight; what lies above ``max_epochs`` times a size is shared again."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Words of each text, and a hash of it that gives rows their order in any session."""
    rid, ids, source, text = batch.columns
    data, bounds = joined(text)
    _, _, at = word_spans(data, bounds)
    content = range_hash(prefix_hash(data), bounds[:-1], bounds[1:]).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [rid, ids, source, pa.array(np.diff(at), pa.int64()), pa.array(content)], ["rid", "id", "source", "size", "content"]
    )


def _sources(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: size, target, slots, the part of the circle it owns."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(plan.max_sources + 1).collect()
    if len(found) > plan.max_sources:
        raise ValueError(f"more than {plan.max_sources} sources to mix")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in found]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(found))]
    wanted = targets(sizes, weights, plan.max_epochs)
    total = sum(sizes)
    edges = np.floor(np.cumsum([0.0, *wanted]) / max(total, 1) * GOLDEN_SIZE).astype(np.int64)
    table = [
        (k, r["source"], s, t, int(t + 0.5), int(lo), int(hi))
        for k, (r, s, t, lo, hi) in enumerate(zip(found, sizes, wanted, edges, edges[1:], strict=False))
    ]
    kind = "key int, source string, source_size long, target double, quota long, lo long, hi long"
    return spark.createDataFrame(table, kind)


def _slots(sources: DataFrame, plan: MixPlan) -> DataFrame:
    """The schedule: slot, key of its source, rank among that source's slots."""
    spark = sources.sparkSession
    edges = [(r["key"], r["lo"], r["hi"]) for r in sources.filter("hi > lo").orderBy("key").collect()]
    total = sum(r["quota"] for r in sources.select("quota").collect())
    block = max(1, min(plan.block_tokens, total // plan.min_slots))
    n = -(-total // block)
    starts = np.array([lo for _, lo, _ in edges], np.int64)
    keys = np.array([k for k, _, _ in edges], np.int32)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = batch.column(0).to_numpy()
        point = (slot % SLOT_PERIOD) * GOLDEN_STEP % GOLDEN_SIZE
        where = np.maximum(np.searchsorted(starts, point, side="right") - 1, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(slot // plan.chunk_rows), pa.array(keys[where])], ["slot", "chunk", "key"]
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (deal(b) for b in stream if len(keys))

    dealt = spark.range(n).mapInArrow(run, "slot long, chunk long, key int")
    before = _prefix(dealt.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")), "key", "chunk", "n")
    inside = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["key", "chunk"])
    return ranked.select("slot", "key", (F.col("before") + F.col("inside")).alias("rank"))


def _prefix(totals: DataFrame, key: str, chunk: str, value: str) -> DataFrame:
    """(key, chunk, before): the sum of value in the key's earlier chunks. One row per key and chunk comes in."""
    w = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, chunk, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias("before"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    plan: MixPlan = MixPlan(),  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs``; returns (documents, takes).

    documents: _rid, id, source, size, source_size, target, taken (one row per
    input row).  takes: slot, source, epoch, _rid, id, from_word, to_word: in
    slot order, the words each slot takes of each document.

    Null text has size 0 and is never taken; null is a source of its own, last
    in order.  The stream of a source is in hash order of (id, text), so reruns
    agree, on any cluster and however files are split; rows equal in both are
    interchangeable.  No document is taken more than ``max_epochs`` times over.  An empty
    table, or one without words, gives no takes.  A text of any length counts
    whole.  Source statistics, one row per source, pass through the driver and
    are broadcast; more than ``max_sources`` sources are an error.
    """
    rows = with_row_id(docs).select(
        F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")
    )
    kind = dict(rows.dtypes)["id"]
    rows = materialize(rows.mapInArrow(batches(_count_words), f"rid long, id {kind}, source string, size long, content long"), "sizes")
    sources = _sources(rows, plan)
    slots = _slots(sources, plan)
    per_source = slots.groupBy("key").agg(F.count(F.lit(1)).alias("slots"))
    stats = sources.join(per_source, "key", "left").withColumn(
        "slots", F.when(F.col("quota") > 0, F.coalesce("slots", F.lit(0))).otherwise(F.lit(0)).cast("long")
    )
    stats = F.broadcast(_local(stats))  # one row per source
    # A source with a target but too small for a slot of its own takes its target in one block after the schedule.
    extra = stats.filter("slots = 0 AND quota > 0").select(F.lit(None).cast("long").alias("slot"), "key", F.lit(0).cast("long").alias("rank"))
    stats = stats.withColumn("slots", F.when((F.col("slots") == 0) & (F.col("quota") > 0), F.lit(1).cast("long")).otherwise(F.col("slots")))

    known = rows.join(stats, rows["source"].eqNullSafe(stats["source"])).drop(stats["source"])
    full = known.filter("size > 0 AND quota > 0").select("rid", "id", "source", "size", "content", "key", "source_size", "quota", "slots")
    n = rows.count()
    chunks = max(1, -(-n // plan.chunk_rows))
    mixed = F.xxhash64(F.lit("mix"), F.col("id"), F.col("content"))
    placed = full.withColumn("order", mixed).withColumn("chunk", _chunk(F.col("order"), chunks))
    before = _prefix(placed.groupBy("key", "chunk").agg(F.sum("size").alias("n")), "key", "chunk", "n")
    running = F.sum("size").over(
        Window.partitionBy("key", "chunk").orderBy("order", "id", "content", "rid").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("inside", F.coalesce(running, F.lit(0))).join(before, ["key", "chunk"])
    at = (F.col("before") + F.col("inside") + F.col("epoch") * F.col("source_size")).cast("long")
    laps = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div source_size"))))
    laps = laps.withColumn("at", at).filter("at < quota")
    end = F.least(F.col("at") + F.col("size"), F.col("quota"))
    # Block b holds the words [b * quota div slots, (b + 1) * quota div slots).
    first, last = _block("at"), _block("end - 1")
    laps = laps.withColumn("end", end).withColumn("rank", F.explode(F.sequence(first, last)))
    lo, hi = _edge("rank"), _edge("rank + 1")
    laps = laps.withColumn("lo", F.greatest(lo, "at")).withColumn("hi", F.least(hi, "end"))
    takes = (
        slots.unionByName(extra)
        .join(laps.filter("hi > lo"), ["key", "rank"])
        .select("slot", "source", "epoch", F.col("rid").alias("_rid"), "id", (F.col("lo") - F.col("at")).alias("from_word"), (F.col("hi") - F.col("at")).alias("to_word"))
    )
    taken = takes.groupBy(F.col("_rid").alias("rid")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    documents = (
        rows.join(stats, rows["source"].eqNullSafe(stats["source"]), "left")
        .select("rid", "id", rows["source"], "size", "source_size", "target")
        .join(taken, "rid", "left")
        .select(F.col("rid").alias("_rid"), "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return documents, takes


def _chunk(order: Column, chunks: int) -> Column:
    """Equal parts of the 64-bit hash range, in hash order; 2**24 parts at most."""
    return F.floor((F.shiftright(order, 40) + F.lit(1 << 23)) * F.lit(min(chunks, 1 << 24)) / F.lit(1 << 24)).cast("long")


def _block(word: str) -> Column:
    """The block that holds a word of the stream: the largest b with floor(b * quota / slots) <= word."""
    return F.expr(f"(cast({word} + 1 as decimal(19,0)) * cast(slots as decimal(18,0)) - 1) div quota")


def _edge(block: str) -> Column:
    """The first word of a block."""
    return F.expr(f"(cast({block} as decimal(19,0)) * cast(quota as decimal(18,0))) div slots")


def _local(df: DataFrame) -> DataFrame:
    """A frame of one row per source, held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", plan: MixPlan = MixPlan()) -> DataFrame:  # noqa: B008
    """``docs`` as the mix takes them: each row as often as it is taken whole, to the nearest copy; columns as they were."""
    taken, _ = mix_sources(docs, id_col, text_col, source_col, plan)
    copies = taken.filter("size > 0").select(F.col("_rid").alias("_mix_rid"), F.expr("(2 * taken + size) div (2 * size)").cast("int").alias("_mix_copies"))
    numbered = with_row_id(docs, "_row_rid")
    repeated = numbered.join(copies.filter("_mix_copies > 0"), F.col("_row_rid") == F.col("_mix_rid"))
    return repeated.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
