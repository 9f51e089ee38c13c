"""Interval coverage, ingestion order, alerts and prices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import fold, valid_symbol


def _with_island(df: DataFrame, key: str) -> DataFrame:
    """Adds ``island``: intervals (first, last) that overlap or touch on the next day share one."""
    w = Window.partitionBy(key).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= F.date_add(reach, 1), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def islands(df: DataFrame, key: str) -> DataFrame:
    """Merged inclusive date intervals per key."""
    merged = _with_island(df, key).groupBy(key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.select(key, "first", "last")


def islands_at(df: DataFrame, key: str) -> DataFrame:
    """Merged intervals that keep the oldest ``covered_at``."""
    merged = _with_island(df, key).groupBy(key, "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("covered_at").alias("covered_at")
    )
    return merged.drop("island")


def gaps(df: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """Uncovered parts of [start, end] per key."""
    lo, hi = F.lit(start), F.lit(end)
    kept = islands(df.filter((F.col("last") >= lo) & (F.col("first") <= hi)), key)
    kept = kept.select(key, F.greatest("first", lo).alias("first"), "last")
    keys = df.select(key).distinct()
    edges = keys.select(key, F.date_sub(lo, 1).alias("first"), F.date_sub(lo, 1).alias("last")).unionByName(kept)
    after = F.lead("first").over(Window.partitionBy(key).orderBy("first", "last"))
    open_ = edges.select(
        key, F.date_add("last", 1).alias("first"), F.least(F.date_sub(F.coalesce(after, F.date_add(hi, 1)), 1), hi).alias("last")
    )
    return open_.filter("first <= last")


def remove(df: DataFrame, start: date, end: date) -> DataFrame:
    """Intervals without [start, end]; an interval around it splits in two."""
    lo, hi = F.lit(start), F.lit(end)
    left = F.struct(F.col("first").alias("first"), F.least("last", F.date_sub(lo, 1)).alias("last"))
    right = F.struct(F.greatest("first", F.date_add(hi, 1)).alias("first"), F.col("last").alias("last"))
    parts = F.filter(F.array(left, right), lambda p: p["first"] <= p["last"])
    away = (F.col("last") < lo) | (F.col("first") > hi)
    whole = F.array(F.struct("first", "last"))
    rest = [c for c in df.columns if c not in ("first", "last")]
    return df.select(*rest, F.explode(F.when(away, whole).otherwise(parts)).alias("p")).select(*rest, "p.first", "p.last")


def ingestion_sequence(df: DataFrame, order: Sequence[str], group: str) -> DataFrame:
    """Adds ``sequence``: a dense number over a total order, without sorting all rows in one task.

    ``group`` is the leading order column, coarse enough that its values are
    few: rows are numbered inside each value, and the values' counts add up.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col(group).alias("_g"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_inside", inside).join(base, F.col(group) == F.col("_g")).withColumn("sequence", (F.col("_before") + F.col("_inside")).cast("long")).drop("_g", "_before", "_inside")


def pending_alerts(feed: DataFrame, after: int, limit: int) -> DataFrame:
    """Earliest unseen rows; old-dated rows count as well, for the order is that of ingestion."""
    return feed.filter(F.col("sequence") > after).orderBy("sequence").limit(limit)


def watched(feed: DataFrame, entries: DataFrame) -> DataFrame:
    """Feed rows that a watch entry (kind, market, term) names, by identifier or person."""
    out = None
    for kind, column in (("company", "identifier"), ("insider", "person")):
        terms = entries.filter(F.col("kind") == kind).select(F.col("market").alias("m"), fold(F.col("term")).alias("t")).distinct()
        hit = feed.join(terms, (F.col("market") == F.col("m")) & (fold(F.trim(column)) == F.col("t")), "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.dropDuplicates(["market", "row_id"])


def valid_bar() -> Column:
    numbers = [F.col(c) for c in ("open", "high", "low", "close")]
    fine = valid_symbol(F.col("symbol"))
    for c in numbers:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    o, h, lo, c = numbers
    return F.coalesce(fine & (lo <= o) & (lo <= c) & (h >= o) & (h >= c) & (lo <= h), F.lit(False))


def upsert_bars(bars: DataFrame, arrival: str) -> DataFrame:
    """One bar per symbol and date, the last to arrive."""
    rest = [c for c in bars.columns if c not in ("symbol", "price_date", arrival)]
    best = bars.groupBy("symbol", "price_date").agg(F.max_by(F.struct(*rest), arrival).alias("x"))
    return best.select("symbol", "price_date", *(F.col(f"x.{c}").alias(c) for c in rest))


def asof_close(markers: DataFrame, bars: DataFrame, adjusted: bool = False) -> DataFrame:
    """Each marker (row_id, symbol, day) with the close of the last bar on or before its day, else of the first bar.

    With ``adjusted`` the adjusted close counts where there is one.  Markers
    and bars are sorted together by symbol and year, so that no symbol fills a
    task; the last bar of the years before comes from the years' own last bars.
    Symbols without bars give null.
    """
    close = F.coalesce("adjusted_close", "close") if adjusted else F.col("close")
    bars = bars.select("symbol", F.col("price_date").alias("day"), close.alias("close")).filter("close IS NOT NULL")
    none = F.lit(None)
    both = markers.select("symbol", "day", F.lit(1).alias("kind"), "row_id", none.cast("double").alias("close")).unionByName(
        bars.select("symbol", "day", F.lit(0).alias("kind"), none.cast("long").alias("row_id"), "close")
    )
    both = both.withColumn("year", F.year("day"))
    years = bars.groupBy("symbol", F.year("day").alias("year")).agg(F.max_by("close", "day").alias("year_close"), F.min_by("close", "day").alias("year_first"))
    in_order = Window.partitionBy("symbol").orderBy("year")
    first = F.first("year_first").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # One row per symbol and year: what stands before the year, also for years without bars.
    span = markers.select("symbol", F.year("day").alias("year")).distinct().join(years, ["symbol", "year"], "full")
    carried = span.select("symbol", "year", F.last("year_close", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    opening = years.select("symbol", first.alias("first_close")).distinct()
    w = Window.partitionBy("symbol", "year").orderBy("day", "kind", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("before", F.last("close", ignorenulls=True).over(w)).filter("kind = 1")
    met = seen.join(carried, (seen["symbol"] == carried["symbol"]) & seen["year"].eqNullSafe(carried["year"]), "left").drop(carried["symbol"], carried["year"])
    return met.join(opening, "symbol", "left").select("row_id", "symbol", "day", F.coalesce("before", "carry", "first_close").alias("close"))


def basis_changed(cached: DataFrame, fetched: DataFrame, relative: float = 1e-6, absolute: float = 1e-8) -> DataFrame:
    """(symbol, overlap, changed): whether a bar that both have differs beyond the tolerance."""
    new = fetched.select("symbol", "price_date", F.col("close").alias("new_close"))
    both = cached.join(new, ["symbol", "price_date"])
    bound = F.greatest(F.lit(absolute), relative * F.greatest(F.abs("close"), F.abs("new_close")))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("overlap"), F.bool_or(F.abs(F.col("close") - F.col("new_close")) > bound).alias("changed"))


def replacement_ok(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """(symbol, missing): cached days that a replacement lacks; 0 allows it."""
    new = fetched.select("symbol", "price_date", F.lit(True).alias("there"))
    return cached.join(new, ["symbol", "price_date"], "left").groupBy("symbol").agg(F.count_if(F.col("there").isNull()).alias("missing"))


def nearest_bars(bars: DataFrame, start: date, end: date) -> DataFrame:
    """(symbol, before, after): the cached days next to a gap."""
    day = F.col("price_date")
    return bars.groupBy("symbol").agg(
        F.max(F.when(day < F.lit(start), day)).alias("before"), F.min(F.when(day > F.lit(end), day)).alias("after")
    )


def refresh_decision(cached: DataFrame, fetched: DataFrame, replacement: DataFrame, start: date, end: date, today: date) -> DataFrame:
    """(symbol, action) of a price refresh over [start, end].

    ``append`` adds the fetched bars: those finished bars that both have agree.
    A finished bar that changed, or an overlap of which no day came back, needs
    the whole history anew: ``replace`` if ``replacement`` has bars and all old
    days, else ``keep`` the old bars.
    """
    done = cached.filter(F.col("price_date") < F.lit(today))
    overlap = done.filter(F.col("price_date").between(F.lit(start), F.lit(end))).groupBy("symbol").agg(F.count(F.lit(1)).alias("expected"))
    seen = basis_changed(done, fetched)
    lacking = replacement_ok(cached, replacement)
    offered = replacement.groupBy("symbol").agg(F.count(F.lit(1)).alias("offered"))
    symbols = cached.select("symbol").union(fetched.select("symbol")).distinct()
    met = symbols.join(seen, "symbol", "left").join(overlap, "symbol", "left").join(lacking, "symbol", "left").join(offered, "symbol", "left")
    broken = F.coalesce("changed", F.lit(False)) | ((F.coalesce("expected", F.lit(0)) > 0) & (F.coalesce("overlap", F.lit(0)) == 0))
    whole = (F.coalesce("offered", F.lit(0)) > 0) & (F.coalesce("missing", F.lit(0)) == 0)
    return met.select("symbol", F.when(~broken, "append").when(whole, "replace").otherwise("keep").alias("action"))


def refreshed_bars(cached: DataFrame, fetched: DataFrame, replacement: DataFrame, decision: DataFrame) -> DataFrame:
    """Bars after a refresh, by :func:`refresh_decision`."""
    of = lambda df, *actions: df.join(decision.filter(F.col("action").isin(*actions)).select("symbol"), "symbol", "left_semi")
    stays = of(cached, "append", "keep").withColumn("_arrival", F.lit(0))
    added = of(fetched, "append").withColumn("_arrival", F.lit(1))
    return upsert_bars(stays.unionByName(added), "_arrival").unionByName(of(replacement, "replace").select(*[c for c in cached.columns]))


def add_coverage(stored: DataFrame, added: DataFrame, today: date, unfinished: Sequence[str] = ("us", "congress")) -> DataFrame:
    """Coverage (domain, identifier, source, first, last, covered_at) with new intervals.

    In domains that may still get filings for an unfinished day, an interval
    ends yesterday at the latest; what is left without a day is dropped.
    Intervals that overlap or touch become one, as old as its oldest part.
    """
    key = ["domain", "identifier", "source"]
    capped = F.when(F.col("domain").isin(*unfinished), F.least("last", F.date_sub(F.lit(today), 1))).otherwise(F.col("last"))
    fresh = added.withColumn("last", capped).filter("first <= last")
    both = stored.unionByName(fresh.select(*stored.columns)).withColumn("_key", F.struct(*key))
    return islands_at(both, "_key").select(*(F.col(f"_key.{k}").alias(k) for k in key), "first", "last", "covered_at")


def uncovered(requests: DataFrame, coverage: DataFrame, key: Sequence[str]) -> DataFrame:
    """Parts of each request (key columns, start, end) that no interval of its key covers: key columns, start, end, first, last."""
    ask = [*key, "start", "end"]
    cov = coverage.select(*(F.col(k).alias(f"_{k}") for k in key), "first", "last")
    same = (F.col("last") >= F.col("start")) & (F.col("first") <= F.col("end"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = requests.select(*ask).distinct().join(cov, same).select(F.struct(*ask).alias("_ask"), F.greatest("first", "start").alias("first"), "last")
    kept = islands(met, "_ask")
    edge = requests.select(*ask).distinct().select(F.struct(*ask).alias("_ask"), F.date_sub("start", 1).alias("first"), F.date_sub("start", 1).alias("last"))
    after = F.lead("first").over(Window.partitionBy("_ask").orderBy("first", "last"))
    end = F.col("_ask.end")
    open_ = edge.unionByName(kept).select(
        "_ask", F.greatest(F.date_add("last", 1), F.col("_ask.start")).alias("first"), F.least(F.date_sub(F.coalesce(after, F.date_add(end, 1)), 1), end).alias("last")
    )
    return open_.filter("first <= last").select("_ask.*", "first", "last")


def plan_scan(
    requests: DataFrame, coverage: DataFrame, refreshed: DataFrame, now: str, ttl_hours: int, recent: int = 7, use_cache: bool = True
) -> DataFrame:
    """Intervals (domain, identifier, source, first, last) that a scan has to read.

    History comes from coverage; the trailing ``recent`` days are read again
    when their last refresh (domain, identifier, source, refreshed_at) is older
    than the limit, lies ahead, or is not known.  Without the cache everything
    asked for is read.  Intervals that touch become one.
    """
    key = ["domain", "identifier", "source"]
    moment = F.lit(now).cast("timestamp_ntz")
    tail = F.greatest("start", F.date_sub(moment.cast("date"), recent - 1))
    if not use_cache:
        return requests.select(*key, F.col("start").alias("first"), F.col("end").alias("last"))
    asked = requests.withColumn("tail", tail)
    past = asked.withColumn("end", F.least("end", F.date_sub("tail", 1))).filter("start <= end").drop("tail")
    parts = uncovered(past, coverage, key).select(*key, "first", "last")
    last = refreshed.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.max("refreshed_at").cast("timestamp_ntz").alias("at"))
    met = asked.filter("tail <= end").join(last, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    fresh = F.coalesce((F.col("at") <= moment) & (F.col("at") > moment - F.expr(f"INTERVAL {ttl_hours} HOURS")), F.lit(False))
    recent_parts = met.filter(~fresh).select(*key, F.col("tail").alias("first"), F.col("end").alias("last"))
    both = parts.unionByName(recent_parts).withColumn("_key", F.struct(*key))
    return islands(both, "_key").select("_key.*", "first", "last")


def unseen_count(feed: DataFrame, after: int) -> DataFrame:
    """(n): rows after a place in the order of ingestion."""
    return feed.filter(F.col("sequence") > after).agg(F.count(F.lit(1)).alias("n"))
