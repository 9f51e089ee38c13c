"""Lists, merges, links and visibility of trade rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.checkpoints import cut
from ledgerline.functions.text import collapse_ws, digest, fold
from ledgerline.schemas import CHAMBERS, CONGRESS_TYPES, EU_COUNTRIES, EU_TYPES, US_TYPES

TOLERANCE_SHARES = 1e-6
TOLERANCE_VALUE = 1.0


def _all(df: DataFrame, tests: Sequence[Column | None]) -> DataFrame:
    return reduce(DataFrame.filter, [t for t in tests if t is not None], df)


def _between(column: str, since: date | None, until: date | None) -> list[Column]:
    out = []
    if since is not None:
        out.append(F.col(column) >= F.lit(since))
    if until is not None:
        out.append(F.col(column) <= F.lit(until))
    return out


def filter_us(us: DataFrame, ticker: str = "", trade_type: str = "", min_value: float = 0, congress_only: bool = False, since: date | None = None, until: date | None = None) -> DataFrame:
    """Missing values never reach a minimum; ranges are over filing dates and drop null ones."""
    return _all(us, [
        F.upper("ticker") == ticker.strip().upper() if ticker else None,
        F.col("trade_type") == trade_type if trade_type else None,
        ~F.col("value_missing") & (F.abs("value") >= min_value) if min_value else None,
        F.col("is_congress") if congress_only else None,
        *_between("filing_date", since, until),
    ])


def filter_eu(eu: DataFrame, isin: str | None = None, country: str = "All", trade_type: str = "All", min_value: float = 0, since: date | None = None, until: date | None = None) -> DataFrame:
    """A missing total counts as 0; ranges are over trade dates."""
    return _all(eu, [
        F.upper("isin") == isin.strip().upper() if isin else None,
        F.col("country") == country if country not in ("", "All") else None,
        F.col("trade_type") == trade_type if trade_type not in ("", "All") else None,
        F.coalesce("total_value", F.lit(0.0)) >= min_value if min_value else None,
        *_between("trade_date", since, until),
    ])


def filter_congress(rows: DataFrame, trade_type: str = "", min_value: float = 0, sector: str = "", since: date | None = None, until: date | None = None) -> DataFrame:
    """A minimum counts only above 0; ``sectors`` is the member's list."""
    return _all(rows, [
        F.col("trade_type") == trade_type if trade_type else None,
        F.col("amount_low") >= min_value if min_value > 0 else None,
        F.array_contains("sectors", sector) if sector else None,
        *_between("filing_date", since, until),
    ])


def by_provenance(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """The row's source or any of its provenance is asked for; a null provenance is empty."""
    listed = F.exists(F.coalesce("provenance", F.array().cast("array<string>")), lambda x: x.isin(*sources))
    return df.filter(F.col("source").isin(*sources) | listed)


def latest(df: DataFrame, dates: tuple[str, str], n: int, key: str = "row_id") -> DataFrame:
    return df.orderBy(*(F.desc_nulls_last(d) for d in dates), key).limit(n)


def congress_scan_order(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("filing_date"), F.desc_nulls_last("trade_date"), "official_name", "row_id").limit(n)


def query_us(
    us: DataFrame, links: DataFrame | None, ticker: str, since: date | None = None, until: date | None = None, traded: tuple[date | None, date | None] = (None, None), sources: Sequence[str] = ()
) -> DataFrame:
    """A ticker's rows that no link hides (all rows without links), in ranges of filing and of trade dates, of any of the sources."""
    rows = _all(filter_us(us, ticker=ticker, since=since, until=until), _between("trade_date", *traded))
    rows = by_provenance(rows, sources) if sources else rows
    return rows if links is None else visible(rows, links, sources)


def query_congress(
    rows: DataFrame, members: DataFrame | None = None, official: str = "", ticker: str = "", chamber: str = "", source: str = "",
    since: date | None = None, until: date | None = None, traded: tuple[date | None, date | None] = (None, None),
) -> DataFrame:
    """Officials are matched as people on the distinct names in the window, then joined back; without members by name alone."""
    from ledgerline.operators.members import same_official

    rows = _all(rows, [
        F.upper("ticker") == ticker.strip().upper() if ticker else None,
        F.col("chamber") == chamber if chamber else None,
        F.col("source") == source if source else None,
        *_between("filing_date", since, until), *_between("trade_date", *traded),
    ])
    if not official:
        return rows
    names = rows.select(F.col("official_name").alias("name")).distinct()
    return rows.join(same_official(names, official, members).withColumnRenamed("name", "official_name"), "official_name", "left_semi")


def query_eu(eu: DataFrame, isin: str | None = None, country: str = "All", since: date | None = None, until: date | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """Rows of an ISIN and country in a range of trade dates, of any of the sources."""
    rows = filter_eu(eu, isin=isin, country=country, since=since, until=until)
    return by_provenance(rows, sources) if sources else rows


def verify_isin(eu: DataFrame, isin: str) -> DataFrame:
    """Rows whose own ISIN is the asked one; sources may return others."""
    return eu.filter(F.upper(F.trim("isin")) == isin.strip().upper())


def eu_scan_order(eu: DataFrame, n: int) -> DataFrame:
    return eu.orderBy(F.desc_nulls_last("trade_date"), F.desc_nulls_last("filing_date"), F.desc("source"), "row_id").limit(n)


def merged_order(df: DataFrame, arrival: str, n: int) -> DataFrame:
    """A merged list: latest trades first, undated ones last, ties in order of arrival."""
    return df.orderBy(F.desc_nulls_last("trade_date"), arrival).limit(n)


def search_house(rows: DataFrame, name: str = "", kind: str = "", since: date | None = None, until: date | None = None) -> DataFrame:
    """Representatives' filings by type, part of a name and date; undated ones pass the range."""
    tests = [F.col("chamber") == "House" if "chamber" in rows.columns else None, F.col("filing_type") == kind if kind else None]
    tests.append(F.contains(fold(F.col("official_name")), fold(F.lit(name))) if name else None)
    tests += [F.col("filing_date").isNull() | t for t in _between("filing_date", since, until)]
    return _all(rows, tests)


def overlay(us: DataFrame, congress: DataFrame, tickers: Sequence[str], since: date, until: date) -> DataFrame:
    def part(df: DataFrame, market: str) -> DataFrame:
        hit = df.filter(F.col("ticker").isin(*tickers) & F.col("trade_date").between(F.lit(since), F.lit(until)))
        return hit.select(F.lit(market).alias("market"), "row_id", "ticker", "trade_date", "trade_type")

    return part(us, "US").unionByName(part(congress, "Congress"))


def last_wins(df: DataFrame, key: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row per key, the last to arrive."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("x"))
    return picked.select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def ordered_distinct(df: DataFrame, key: Column, position: str, limit: int = 10_000) -> DataFrame:
    """The first ``limit`` distinct keys, numbered by their first position, as a watchlist is.

    Only that many rows meet in one task for their numbers.
    """
    first = df.groupBy(key.alias("key")).agg(F.min(position).alias("first"))
    first = first.orderBy("first", "key").limit(limit)
    return first.select("key", F.row_number().over(Window.orderBy("first", "key")).cast("long").alias("position"))


def freshness(df: DataFrame, domain: str, at: str, now: str, ttl_hours: int = 24) -> DataFrame:
    """Stale without a time, with a future one, or with one older than the limit."""
    last, moment = F.max(at), F.lit(now).cast("timestamp_ntz")
    out = df.groupBy(F.col(domain).alias("domain")).agg(last.alias("refreshed_at"))
    age = F.col("refreshed_at").cast("timestamp_ntz")
    old = moment - F.expr(f"INTERVAL {ttl_hours} HOURS")
    return out.withColumn("stale", F.col("refreshed_at").isNull() | (age > moment) | (age < old))


#: What rows of a market must fulfil: closed lists, numbers that are not negative, columns that are not null.
RULES = {
    "US": ({"trade_type": US_TYPES}, ("shares", "price", "value"), ("ticker", "insider_name")),
    "Congress": ({"trade_type": CONGRESS_TYPES, "chamber": CHAMBERS, "source": ("", "house", "senate")}, ("amount_low", "amount_high"), ("official_name", "amount_low", "amount_high")),
    "Europe": ({"trade_type": EU_TYPES, "country": EU_COUNTRIES}, ("volume", "price", "total_value"), ("isin", "insider_name")),
}


def reject_rows(df: DataFrame, market: str = "US") -> DataFrame:
    """Adds ``error``: null for valid rows, else the first rule that fails. Rules about columns the rows lack are left out."""
    lists, numbers, needed = RULES[market]
    bad = F.when(F.lit(False), "")
    for c in needed:
        if c in df.columns:
            bad = bad.when(F.col(c).isNull(), f"{c} is missing")
    for c, allowed in lists.items():
        if c in df.columns:
            bad = bad.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), f"{c} is not known")
    for c in numbers:
        if c in df.columns:
            bad = bad.when(F.isnan(c) | (F.col(c) < 0), f"{c} is negative or not a number")
    if market == "Congress":
        bad = bad.when(F.col("amount_high") < F.col("amount_low"), "amount range is inverted")
    return df.withColumn("error", bad)


def us_identity(us: DataFrame) -> DataFrame:
    """Adds ``identity``: a filing row, or exactly what a scraper saw; undated observations do not match across reports.

    Quantities and prices are compared as they are, without rounding.  Columns
    that the rows lack (price, url) count as unknown everywhere.
    """
    have = set(us.columns)
    native = (F.trim("accession_number") != "") & (F.trim("sec_row_id") != "")
    exact = lambda c: (F.col(c) + F.lit(0.0)).cast("string") if c in have else F.lit(None).cast("string")
    flag = lambda c: F.col(c) if c in have else F.lit(None).cast("boolean")
    seen = [
        F.upper(F.trim("ticker")), fold(F.trim("insider_name")), F.col("trade_date"), F.col("trade_type"), F.abs("shares").cast("string"),
        exact("price"), flag("shares_missing"), flag("price_missing"),
    ]
    undated = [F.col("filing_date"), fold(F.trim("source")), F.col("url") if "url" in have else F.lit("")]
    return us.withColumn(
        "identity",
        F.when(native, digest(F.lit("sec"), F.trim("accession_number"), F.trim("sec_row_id")))
        .when(F.col("trade_date").isNull(), digest(F.lit("scraper"), *seen, *undated))
        .otherwise(digest(F.lit("scraper"), *seen)),
    )


NUMBERS = ("shares", "price", "value", "shares_owned_after")
#: Columns that a merge treats on their own: links, annotations, identity and provenance.
_APART = ("identity", "row_id", "arrival", "source", "provenance", "url", "is_congress", "congress_member", "accession_number", "sec_row_id", "batch")


def merge_us(us: DataFrame, arrival: str = "row_id") -> DataFrame:
    """One row per identity, of any columns of the US model.

    Scraped observations are merged in any order: texts and dates by maximum,
    numbers with their flags by (known, size, value), the filing identity as a
    pair.  Of a filing row the last to arrive replaces all.  Either way the
    greatest link stays, a member's mark is never lost, and sources add up.
    """
    have = us.columns
    numbers = [c for c in NUMBERS if c in have]
    flags = {f"{c}_missing" for c in numbers}
    plain = [c for c in have if c not in (*numbers, *_APART) and c not in flags]
    keyed = us_identity(us)
    native = (F.trim("accession_number") != "") & (F.trim("sec_row_id") != "")
    kept = [*plain, *numbers, *sorted(flags & set(have))]
    missing = lambda c: F.col(f"{c}_missing") if f"{c}_missing" in have else F.lit(False)
    aggregates = [F.max(c).alias(c) for c in plain]
    aggregates += [F.max(F.struct((~missing(c)).alias("known"), F.abs(c).alias("size"), F.col(c).alias("v"))).alias(c) for c in numbers]
    aggregates += [F.max(F.struct("accession_number", "sec_row_id")).alias("pair"), F.bool_or(native).alias("native")]
    aggregates += [F.max_by(F.struct(*kept), arrival).alias("last"), F.count(F.lit(1)).alias("observations")]
    listed = F.collect_set("source") if "provenance" not in have else F.array_distinct(F.flatten(F.collect_set(F.array_append(F.coalesce("provenance", F.array().cast("array<string>")), F.col("source")))))
    aggregates.append(F.array_join(F.array_sort(listed), ",").alias("provenance"))
    if "url" in have:
        aggregates.append(F.coalesce(F.max(F.when(F.col("url") != "", F.col("url"))), F.lit("")).alias("url"))
    if "is_congress" in have:
        aggregates.append(F.bool_or("is_congress").alias("is_congress"))
    if "congress_member" in have:
        mark = F.when(F.col("is_congress") & (F.col("congress_member") != ""), F.col("congress_member"))
        aggregates.append(F.coalesce(F.max(mark), F.lit("")).alias("congress_member"))
    merged = keyed.groupBy(F.unhex("identity").alias("key")).agg(*aggregates)
    pick = lambda c, v: F.when(F.col("native"), F.col(f"last.{c}")).otherwise(v).alias(c)
    out = [F.lower(F.hex("key")).alias("identity"), *(pick(c, F.col(c)) for c in plain)]
    out += [pick(c, F.col(f"{c}.v")) for c in numbers]
    out += [pick(f"{c}_missing", ~F.col(f"{c}.known")) for c in numbers if f"{c}_missing" in have]
    out += ["pair.accession_number", "pair.sec_row_id", "provenance", "observations", *(c for c in ("url", "is_congress", "congress_member") if c in have)]
    return merged.select(*out)


def merge_congress(rows: DataFrame, key: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Per key, filled values of later rows replace those of earlier ones; a range moves as a pair, and only a filled one.

    Texts without content, nulls, zeros and false are not filled.  Completeness
    follows the last row that names its report.
    """
    types = dict(rows.dtypes)
    when = F.struct(*arrival)

    def filled(c: str) -> Column:
        if types[c] == "string":
            return F.coalesce(F.col(c) != "", F.lit(False))
        if types[c] == "boolean":
            return F.coalesce(F.col(c), F.lit(False))
        return F.col(c).isNotNull() & (F.col(c) != 0) if types[c] in ("double", "int", "bigint") else F.col(c).isNotNull()

    def last(value: Column, test: Column) -> Column:
        return F.coalesce(F.max_by(value, F.when(test, when)), F.max_by(value, when))

    aggregates = []
    for c in rows.columns:
        if c in key or c in arrival or c in ("amount_low", "amount_high", "filing_complete"):
            continue
        aggregates.append(last(F.col(c), filled(c)).alias(c))
    pair = "amount_low" in rows.columns
    if pair:
        given = F.coalesce((F.col("amount_low") != 0) | (F.col("amount_high") != 0), F.lit(False))
        aggregates.append(last(F.struct("amount_low", "amount_high"), given).alias("_amounts"))
    if "filing_complete" in rows.columns:
        named = filled("report_title") if "report_title" in rows.columns else F.lit(True)
        aggregates.append(F.coalesce(F.max_by("filing_complete", F.when(named, when)), F.min_by("filing_complete", when)).alias("filing_complete"))
    out = rows.groupBy(*key).agg(*aggregates)
    return out.select(*(c for c in out.columns if c != "_amounts"), *(("_amounts.amount_low", "_amounts.amount_high") if pair else ()))


def first_filled(df: DataFrame, key: Sequence[str], columns: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Per key, the first filled value of each column in arrival order (null and '' are not filled)."""
    return _filled(df, key, columns, arrival, F.min_by)


def last_filled(df: DataFrame, key: Sequence[str], columns: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Per key, the last filled value of each column in arrival order."""
    return _filled(df, key, columns, arrival, F.max_by)


def _filled(df: DataFrame, key: Sequence[str], columns: Sequence[str], arrival: Sequence[str], pick) -> DataFrame:
    text = {c for c, t in df.dtypes if t == "string"}
    when = F.struct(*arrival)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "") if c in text else F.col(c).isNotNull()
    # An order that is null leaves the row out of the aggregate.
    return df.groupBy(*key).agg(*(pick(F.col(c), F.when(filled(c), when)).alias(c) for c in columns))


def upsert_outcomes(stored: DataFrame, incoming: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, outcome) of each incoming row: inserted, updated or skipped as unchanged."""
    old = stored.select(F.col(key).alias("old_key"), F.struct(*compared).alias("old"))
    joined = incoming.join(old, F.col(key) == F.col("old_key"), "left")
    same = F.struct(*compared).eqNullSafe(F.col("old"))
    return joined.select(key, F.when(F.col("old_key").isNull(), "inserted").when(same, "skipped").otherwise("updated").alias("outcome"))


ECONOMIC = ("ticker", "insider_name", "trade_date", "filing_date", "trade_type")


def comparable(df: DataFrame) -> Column:
    """Rows outside derivatives that buy, sell or exercise, by type and transaction code."""
    fine = F.col("trade_type").isin("Buy", "Sell", "Exercise") & ~F.col("is_derivative")
    if "transaction_code" in df.columns:
        fine = fine & F.upper(F.trim(F.coalesce("transaction_code", F.lit("")))).isin("", "P", "S", "M")
    return fine


def duplicate_links(us: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """(row_id, replacement, reason) of scraped rows that a filing reports as well.

    Per filing and security: the lot that alone fits; where none does, all lots
    together, for which a superseded one stands if there is any, else the
    first.  One match that is not superseded makes a duplicate; without one,
    matches that were all replaced by the same row pass that link on.
    ``superseded``: links of filing rows (row_id, replacement, reason).
    """
    known = [c for c in ("shares_missing", "price_missing", "value_missing") if c in us.columns]
    usable = us.filter(comparable(us) & F.col("filing_date").isNotNull() & F.col("trade_date").isNotNull() & (F.trim("insider_name") != ""))
    for c in known:
        usable = usable.filter(~F.col(c))
    key = list(ECONOMIC)
    usable = usable.withColumn("insider_name", collapse_ws(fold(F.col("insider_name"))))
    is_native = (F.col("accession_number") != "") & (F.col("sec_row_id") != "")
    security = collapse_ws(fold(F.col("security_title" if "security_title" in us.columns else "company")))
    native = usable.filter(is_native).select(*key, "row_id", F.abs("shares").alias("s"), F.abs("value").alias("v"), "accession_number", security.alias("security"))
    if superseded is None:
        native = native.withColumn("to", F.lit(None).cast("struct<replacement:bigint,reason:string>"))
    else:
        old = superseded.select(F.col("row_id").alias("old_row"), F.struct("replacement", "reason").alias("to"))
        native = native.join(old, F.col("row_id") == F.col("old_row"), "left").drop("old_row")
    # The lots of one filing about one person, day and security.
    lots = native.groupBy(*key, "accession_number", "security").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "s", "v", "to"))).alias("lots"), F.sum("s").alias("s"), F.sum("v").alias("v")
    )
    scraped = usable.filter(~is_native).select(F.col("row_id").alias("scraped"), F.abs("shares").alias("own_s"), F.abs("value").alias("own_v"), *key)
    met = scraped.join(lots, key)
    fits = lambda s_, v_: (F.abs(F.col("own_s") - s_) <= TOLERANCE_SHARES) & (F.abs(F.col("own_v") - v_) <= TOLERANCE_VALUE)
    single = F.filter("lots", lambda x: fits(x["s"], x["v"]))
    stale = F.get(F.filter("lots", lambda x: x["to"].isNotNull()), F.lit(0))
    whole = F.when((F.size("lots") > 1) & fits(F.col("s"), F.col("v")), F.coalesce(stale, F.get("lots", F.lit(0))))
    match = F.when(F.size(single) == 1, F.get(single, F.lit(0))).when(F.size(single) == 0, whole)
    met = met.withColumn("match", match).filter("match IS NOT NULL")
    found = met.groupBy("scraped").agg(
        F.count_if(F.col("match.to").isNull()).alias("active"), F.min(F.when(F.col("match.to").isNull(), F.col("match.row_id"))).alias("lot"),
        F.count_distinct("match.to").alias("targets"), F.min("match.to").alias("to"),
    )
    own = F.when(F.col("active") == 1, F.struct(F.col("lot").alias("replacement"), F.lit("duplicate").alias("reason")))
    link = own.when((F.col("active") == 0) & (F.col("targets") == 1), F.col("to"))
    return found.withColumn("link", link).filter("link IS NOT NULL").select(F.col("scraped").alias("row_id"), "link.replacement", "link.reason")


def visible(rows: DataFrame, links: DataFrame, sources: Sequence[str] = (), native: str = "sec_edgar") -> DataFrame:
    """Rows that no link hides: superseded ones always, duplicates unless only other sources are asked for."""
    hidden = links if not sources or native in sources else links.filter("reason != 'duplicate'")
    return rows.join(hidden.select("row_id"), "row_id", "left_anti")


def lot_sums(us: DataFrame) -> DataFrame:
    lots = us.filter("accession_number != ''")
    return lots.groupBy("accession_number", "company").agg(
        F.sum(F.abs("shares").cast("decimal(18,2)")).alias("shares"), F.sum(F.abs("value").cast("decimal(18,2)")).alias("value"), F.count(F.lit(1)).alias("lots")
    )


def pair_lots(old: DataFrame, new: DataFrame, key: Sequence[str], row: str = "row_id") -> DataFrame:
    """Equal lots of two filings one for one, smallest rows first."""
    w = Window.partitionBy(*key).orderBy(row)
    a = old.select(*key, F.col(row).alias("old_row"), F.row_number().over(w).alias("k"))
    b = new.select(*key, F.col(row).alias("new_row"), F.row_number().over(w).alias("k"))
    return a.join(b, [*key, "k"]).select("old_row", "new_row")


def close_links(links: DataFrame) -> DataFrame:
    """(row_id, replacement) with chains collapsed to their end, whatever their length.

    Each round every row takes the replacement of its replacement, so the
    rounds grow with the logarithm of the longest chain.  A cycle has no end
    and raises an error.
    """
    now = cut(links.select("row_id", "replacement"))
    for _ in range(now.count().bit_length() + 1):
        following = now.select(F.col("row_id").alias("_at"), F.col("replacement").alias("_next"))
        moved = cut(now.join(following, F.col("replacement") == F.col("_at"), "left").select(
            "row_id", F.coalesce("_next", "replacement").alias("replacement"), F.col("_at").isNotNull().alias("_moved")
        ))
        now = moved.select("row_id", "replacement")
        if not moved.filter("_moved").limit(1).count():
            return now
    raise RuntimeError("links run in a cycle")


def supersede_reports(rows: DataFrame) -> DataFrame:
    """(row_id, replacement, reason) for periodic reports: the latest complete amendment replaces earlier reports of its group.

    Columns: row_id, group_key, doc_id, filing_date, is_amendment, filing_complete.
    Rows without a document or filing date belong to no report.  A report is
    filed when its first row is.  Groups with several originals, an original
    later than the winner, or no complete amendment stay as they are; reports
    of the winner's own day have no order and stay as well.
    """
    rows = rows.filter("coalesce(trim(doc_id), '') != '' AND filing_date IS NOT NULL")
    docs = rows.groupBy("group_key", "doc_id").agg(
        F.min_by("filing_date", "row_id").alias("filed"), F.bool_and("is_amendment").alias("amended"), F.bool_or("is_amendment").alias("some"),
        F.bool_and("filing_complete").alias("complete"), F.min("row_id").alias("first_row"),
    )
    groups = docs.groupBy(F.col("group_key").alias("g")).agg(
        F.count_if(~F.col("some")).alias("originals"),
        F.max(F.when(~F.col("some"), F.col("filed"))).alias("original_filed"),
        F.max(F.when(F.col("amended") & F.col("complete"), F.struct("filed", "doc_id", "first_row"))).alias("winner"),
    )
    groups = groups.filter("originals <= 1 AND winner IS NOT NULL AND (original_filed IS NULL OR original_filed <= winner.filed)")
    old = docs.select(F.col("group_key").alias("old_group"), F.col("doc_id").alias("old_doc"), "filed")
    old = old.join(groups, F.col("old_group") == F.col("g")).filter("old_doc != winner.doc_id AND filed < winner.filed")
    hit = rows.join(old, (F.col("group_key") == F.col("old_group")) & (F.col("doc_id") == F.col("old_doc")))
    return hit.select("row_id", F.col("winner.first_row").alias("replacement"), F.lit("superseded").alias("reason"))


def with_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every row with the state of its filing, null where none is recorded."""
    return rows.join(ledger, "accession_number", "left")


def best_ledger(entries: DataFrame) -> DataFrame:
    """One entry per filing: a success is never undone by a later failure; attempts add up."""
    rank = F.struct((F.col("status") == "success").alias("ok"), "seq")
    return entries.groupBy("accession_number").agg(F.max_by("status", rank).alias("status"), F.sum("attempts").alias("attempts"))


def prefer_representation(rows: DataFrame) -> DataFrame:
    """Rows of the best representation of each filing: documents before quarterly data sets."""
    rank = F.when(F.col("representation") == "xml", 1).otherwise(2)
    w = Window.partitionBy("accession_number")
    return rows.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(w)).filter("_rank = _best").drop("_rank", "_best")


def issuer_scope(us: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """All rows whose issuer also trades under one of the tickers."""
    issuers = us.filter(F.col("ticker").isin(*tickers)).select("cik").distinct()
    return us.join(issuers, "cik", "left_semi")
