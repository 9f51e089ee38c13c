"""The unified feed over the three markets: projection, filters, total order, paging, search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import classify_direction, contains_folded, fold, strip
from ledgerline.schemas import FEED_SCHEMA, MARKETS

SORT_FIELDS = ("transaction_date", "filing_date", "issuer", "person", "value", "market")
SEARCHED = ("market", "trade_type", "issuer", "identifier", "person", "role", "source")


@dataclass(frozen=True)
class FeedCriteria:
    """Filters and order of a feed; empty means all."""

    search: str = ""
    markets: Sequence[str] = ()
    directions: Sequence[str] = ()
    date_from: date | None = None
    date_to: date | None = None
    value_min: float | None = None
    value_max: float | None = None
    sort_field: str = "transaction_date"
    descending: bool = True

    def __post_init__(self) -> None:
        if self.sort_field not in SORT_FIELDS or not set(self.markets) <= set(MARKETS):
            raise ValueError("unknown sort field or market")
        if not set(self.directions) <= {"Buy", "Sell", "Other"}:
            raise ValueError("unknown direction")
        for bound in (self.value_min, self.value_max):
            if bound is not None and not (isfinite(bound) and bound >= 0):
                raise ValueError("value bounds are finite and not negative")
        if None not in (self.value_min, self.value_max) and self.value_min > self.value_max:
            raise ValueError("value_min is above value_max")
        if None not in (self.date_from, self.date_to) and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")

    @property
    def is_nontrivial(self) -> bool:
        bounds = (self.date_from, self.date_to, self.value_min, self.value_max)
        return bool(self.search.strip() or self.markets or self.directions or any(b is not None for b in bounds))


@dataclass(frozen=True)
class Cursor:
    """The last row of a page, and the largest row per market when the walk began."""

    sort_value: object
    filing_date: date | None
    market_rank: int
    row_id: int
    snapshot: dict[str, int] = field(default_factory=dict)


def feed_union(us: DataFrame, congress: DataFrame, eu: DataFrame) -> DataFrame:
    """Rows of ``FEED_SCHEMA``: missing US numbers become null, Congress shows its amount range."""
    none = F.lit(None).cast("double")
    value = F.when(~F.col("value_missing"), F.col("value"))
    branches = (
        (us, "US", 0, "trade_date", "company", "ticker", "insider_name", F.lit(""), F.when(~F.col("shares_missing"), F.col("shares")), none, value, F.lit(""), F.lit("USD"), value),
        (congress, "Congress", 1, "trade_date", F.lit(""), "ticker", "official_name", F.col("chamber"), none, none, none, F.col("amount_range"), F.lit("USD"), F.col("amount_low")),
        (eu, "Europe", 2, "trade_date", "issuer_name", "isin", "insider_name", F.col("position"), F.col("volume"), F.col("price"), F.col("total_value"), F.lit(""), F.col("currency"), F.col("total_value")),
    )
    names = FEED_SCHEMA.fieldNames()
    out = []
    for df, market, rank, day, issuer, identifier, person, role, quantity, price, amount, shown, currency, order in branches:
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        columns = (
            F.lit(market), F.lit(rank), F.col("row_id"), as_column(day), F.col("filing_date"), F.col("trade_type"), as_column(issuer),
            as_column(identifier), as_column(person), role, quantity, price, amount, shown, currency, F.col("source"), F.lit(""), order,
        )
        out.append(df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True))))
    return reduce(DataFrame.unionByName, out)


def apply_criteria(feed: DataFrame, c: FeedCriteria) -> DataFrame:
    tests: list[Column] = []
    if c.markets:
        tests.append(F.col("market").isin(*c.markets))
    if c.directions:
        tests.append(classify_direction(F.col("trade_type")).isin(*c.directions))
    if c.date_from is not None:
        tests.append(F.col("transaction_date") >= F.lit(c.date_from))
    if c.date_to is not None:
        tests.append(F.col("transaction_date") <= F.lit(c.date_to))
    if c.value_min is not None:
        tests.append(F.col("sort_value") >= F.lit(float(c.value_min)))
    if c.value_max is not None:
        tests.append(F.col("sort_value") <= F.lit(float(c.value_max)))
    if c.search.strip():
        tests.append(contains_folded([F.col(x) for x in SEARCHED], c.search.strip()))
    return reduce(DataFrame.filter, tests, feed)


def sort_key(name: str) -> Column:
    return {"issuer": fold(F.col("issuer")), "person": fold(F.col("person")), "value": F.col("sort_value")}.get(name, F.col(name))


def feed_order(c: FeedCriteria) -> list[Column]:
    """Total order: the sort field (nulls last either way), filing date, market, row."""
    key = sort_key(c.sort_field)
    first = key.desc_nulls_last() if c.descending else key.asc_nulls_last()
    return [first, F.col("filing_date").desc_nulls_last(), F.col("market_rank").asc(), F.col("row_id").asc()]


def snapshot(feed: DataFrame) -> DataFrame:
    return feed.groupBy("market").agg(F.max("row_id").alias("last_row"))


def after_cursor(feed: DataFrame, c: FeedCriteria, cursor: Cursor) -> DataFrame:
    """Rows after the cursor in feed order, without rows newer than its snapshot."""
    key = sort_key(c.sort_field)

    def later(value: Column, last: object, descending: bool) -> tuple[Column, Column]:
        """(strictly after, equal) with nulls last."""
        if last is None:
            return F.lit(False), value.isNull()
        bound = F.lit(last)
        beyond = value < bound if descending else value > bound
        return value.isNull() | beyond, value == bound

    after_key, same_key = later(key, cursor.sort_value, c.descending)
    after_filed, same_filed = later(F.col("filing_date"), cursor.filing_date, True)
    rank, row = F.col("market_rank"), F.col("row_id")
    tail = (rank > cursor.market_rank) | ((rank == cursor.market_rank) & (row > cursor.row_id))
    out = feed.filter(after_key | (same_key & (after_filed | (same_filed & tail))))
    seen = reduce(lambda a, kv: a | ((F.col("market") == kv[0]) & (row <= kv[1])), cursor.snapshot.items(), F.lit(False))
    return out.filter(seen) if cursor.snapshot else out


def page(feed: DataFrame, c: FeedCriteria = FeedCriteria(), limit: int = 200, offset: int = 0, cursor: Cursor | None = None) -> DataFrame:  # noqa: B008
    """One page; ask for ``limit + 1`` to learn whether there are more."""
    if not 1 <= limit <= 501 or offset < 0:
        raise ValueError("limit is 1 to 500 and offset not negative")
    rows = apply_criteria(feed, c)
    if cursor is not None:
        rows = after_cursor(rows, c, cursor)
    rows = rows.orderBy(*feed_order(c))
    return (rows.offset(offset) if offset else rows).limit(limit)


@dataclass(frozen=True)
class Page:
    """A page as a caller shows it: rows, whether more follow, how many there are in all (if asked), and how fresh."""

    rows: list
    has_more: bool
    total: int | None
    refreshed_at: object
    next: Cursor | None


def query(
    feed: DataFrame, c: FeedCriteria = FeedCriteria(), limit: int = 200, offset: int = 0, cursor: Cursor | None = None, with_total: bool = True, refreshed: DataFrame | None = None  # noqa: B008
) -> Page:
    """One page with one row more fetched to know whether there are any; a walk by cursor keeps the first page's snapshot.

    refreshed: (domain, refreshed_at) of the markets; the latest of those shown counts.
    """
    key = "_key"
    rows = page(feed, c, limit + 1, offset, cursor).withColumn(key, sort_key(c.sort_field)).collect()
    shown, more = rows[:limit], len(rows) > limit
    total = apply_criteria(feed, c).count() if with_total and cursor is None else None
    at = None
    if refreshed is not None:
        names = [m for m in MARKETS if not c.markets or m in c.markets]
        at = refreshed.filter(F.col("domain").isin(*names)).agg(F.max("refreshed_at")).first()[0]
    following = None
    if more:
        held = cursor.snapshot if cursor else {r["market"]: r["last_row"] for r in snapshot(apply_criteria(feed, FeedCriteria(markets=c.markets))).collect()}
        last = shown[-1]
        following = Cursor(last[key], last["filing_date"], last["market_rank"], last["row_id"], held)
    return Page(shown, more, total, at, following)


def investigation(feed: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """A row with what else its person and its issuer did: ``section`` is anchor, person or issuer; the anchor stands once.

    The anchor's person and identifier are looked up first, one row.
    """
    market, row = parse_key(key)
    anchor = detail(feed, key)
    found = anchor.select("person", "identifier").head(1)
    out = anchor.withColumn("section", F.lit("anchor"))
    if not found:
        return out
    for section, column in (("person", "person"), ("issuer", "identifier")):
        value = found[0][column]
        if value and value.strip():
            out = out.unionByName(recent(feed, column, value, limit, (market, row)).withColumn("section", F.lit(section)))
    return out


def parse_key(key: str) -> tuple[str, int]:
    """``us:12`` to its market and row; anything looser is an error."""
    market, colon, number = key.partition(":")
    names = {m.lower(): m for m in MARKETS}
    if not colon or market not in names or not number.isascii() or not number.isdigit() or number.startswith("0"):
        raise ValueError(f"not a feed key: {key!r}")
    return names[market], int(number)


def detail(feed: DataFrame, key: str) -> DataFrame:
    market, row = parse_key(key)
    return feed.filter((F.col("market") == market) & (F.col("row_id") == row))


def recent(feed: DataFrame, column: str, value: str, limit: int = 8, without: tuple[str, int] | None = None) -> DataFrame:
    """Latest rows of a person (caseless) or an issuer identifier, without the anchor row."""
    test = fold(strip(F.col("person"))) == fold(F.lit(value.strip())) if column == "person" else F.upper(strip(F.col("identifier"))) == value.strip().upper()
    rows = feed.filter(test)
    if without:
        rows = rows.filter(~((F.col("market") == without[0]) & (F.col("row_id") == without[1])))
    return rows.orderBy(*feed_order(FeedCriteria())).limit(limit)


def search_companies(feed: DataFrame, text: str, limit: int = 8) -> DataFrame:
    rows = feed.filter(F.col("identifier") != "").filter(contains_folded([F.col("issuer"), F.col("identifier")], text))
    hits = rows.select("issuer", "identifier", "market", "market_rank").distinct()
    return hits.orderBy(fold(F.col("issuer")), fold(F.col("identifier")), "market_rank", "issuer", "identifier").limit(limit).drop("market_rank")


def search_people(feed: DataFrame, text: str, limit: int = 8) -> DataFrame:
    hits = feed.filter(contains_folded([F.col("person")], text)).select("person", "market", "market_rank").distinct()
    return hits.orderBy(fold(F.col("person")), "market_rank", "person").limit(limit).drop("market_rank")


def entity_summary(feed: DataFrame, column: str) -> DataFrame:
    way = classify_direction(F.col("trade_type"))
    return feed.groupBy(column).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(way == "Buy").alias("buys"),
        F.count_if(way == "Sell").alias("sells"),
        F.max(F.coalesce("transaction_date", "filing_date")).alias("latest"),
    )
