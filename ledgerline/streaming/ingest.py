"""Streaming ingestion: batches with a ledger, and alerts by ingestion order.

Rows are accepted once per key however often a batch is replayed, old-dated
rows still alert because the order is that of arrival, and every alert rule
keeps a watermark that only grows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerline.sources.tables import AppendStore


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums per kind and day; rows later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "event_type", "n", "value")


def rescanned(events: DataFrame, key: Sequence[str], tail: str = "7 days") -> DataFrame:
    """A stream in which every key counts once within the trailing window that sources are read again for."""
    return events.withWatermark("ts", tail).dropDuplicatesWithinWatermark(list(key))


def accept_batch(store: AppendStore, key: str, stream: str, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds unseen keys to table ``rows``, each batch of a stream once.

    A batch is a folder of its own, named by stream and number; it is there
    whole or not at all, so a replay writes the same folder again and another
    stream, or a new checkpoint under another name, cannot hide it.  Of a key
    that a batch holds several times the last by ``order`` (all columns if
    none) counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        name = f"{stream}-{number:012d}"
        if store.has("rows", name):
            return
        rest = [c for c in batch.columns if c != key]
        rank = F.struct(*(order or sorted(rest)))
        fresh = batch.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in rest))
        known = store.read("rows")
        if known is not None:
            fresh = fresh.join(known.select(key), key, "left_anti")
        store.append("rows", name, fresh.withColumns({"stream": F.lit(stream), "batch_id": F.lit(number).cast("long")}))

    return run


def ingest(
    spark: SparkSession, source: str, schema: str, store: AppendStore, key: str, checkpoint: str, stream: str = "files", order: Sequence[str] = (), max_files: int = 1000
) -> StreamingQuery:
    """Read new Parquet files of a folder into the store, ``max_files`` a batch, all that is there and no more.

    ``stream`` names the checkpoint: a new checkpoint needs a new name.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        files.writeStream.foreachBatch(accept_batch(store, key, stream, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def settled(rows: DataFrame, today: date, day: str = "filing_date") -> DataFrame:
    """Rows of finished days; those of today and later may still change and are not to be kept for good."""
    return rows.filter(F.col(day) < F.lit(today))


def advance(watermarks: dict[str, int], seen: dict[str, int]) -> dict[str, int]:
    """Watermarks after an acknowledgement; they never go back."""
    return {rule: max(watermarks.get(rule, 0), seen.get(rule, 0)) for rule in watermarks | seen}
