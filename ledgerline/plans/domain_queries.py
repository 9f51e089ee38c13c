"""Registered function, merge, link, interval and price queries with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as x
from ledgerline.operators import compare, members, timeline, trades
from ledgerline.plans import bridge as b
from ledgerline.plans.bridge import sql

LO, HI = date(1996, 1, 1), date(1999, 12, 31)


def _text(s, d, expression: str) -> DataFrame:
    """(row, raw): made-up texts over the orders table."""
    return b.table(s, d, "orders").selectExpr("o_orderkey AS row_id", f"{expression} AS raw")


# Made-up inputs, the same text in both engines.
DATE_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '03/05/2024' WHEN 2 THEN '3/5/70' WHEN 3 THEN '-' WHEN 4 THEN ''
 WHEN 5 THEN '2024-03-05T10:11:12' WHEN 6 THEN '12/31/68' ELSE '2024-02-30' END"""
NUMBER_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN concat('$', cast(o_custkey AS string), ',000.50') WHEN 1 THEN concat('(', cast(o_custkey AS string), ')')
 WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN concat(' +', cast(o_custkey AS string), ' ') ELSE cast(o_custkey AS string) END"""
TRADE_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN 'P - Purchase' WHEN 1 THEN 'D - Sale to issuer' WHEN 2 THEN 'Sale' WHEN 3 THEN ' buy ' WHEN 4 THEN 'Option exercise'
 WHEN 5 THEN 'M' WHEN 6 THEN 'gift' WHEN 7 THEN '' ELSE 'S-' END"""
TX_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN 'S (partial)' WHEN 1 THEN 'P' WHEN 2 THEN 'Exchange' WHEN 3 THEN 'sale (Full)' WHEN 4 THEN 'x' ELSE 'Purchase' END"
OWNER_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'SP' WHEN 2 THEN 'dc' WHEN 3 THEN ' jt ' WHEN 4 THEN 'trust' ELSE 'Sp' END"
AMOUNT_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN '$1,001 - $15,000' WHEN 1 THEN 'Over $50,000,000' WHEN 2 THEN 'Spouse over $ 1,000' WHEN 3 THEN '15000-1000'
 WHEN 4 THEN '1,00 - 2,000' ELSE '$5 - 10.5' END"""
TICKER_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN 'Apple Inc (AAPL) [ST]' WHEN 1 THEN 'Berkshire (BRK.B)' WHEN 2 THEN 'nothing (toolong)' ELSE '' END"
CIK_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN cast(o_orderkey AS string) WHEN 1 THEN '' WHEN 2 THEN 'x12' ELSE '12345678901' END"
POSITION_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Non-Executive Director' WHEN 2 THEN 'Mitglied des Aufsichtsrat' WHEN 3 THEN 'PCA of X'
 WHEN 4 THEN 'specacle' WHEN 5 THEN 'Director' WHEN 6 THEN '' ELSE 'executive director' END"""
NAME_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN 'Hon. John Q. Public Jr.' WHEN 1 THEN 'Sen O''Neil-Smith' WHEN 2 THEN 'Mary "Mimi" Jones III' WHEN 3 THEN 'Dr' ELSE 'Ann Lee' END"""


def _duck(text: str) -> str:
    return text.replace("AS string)", "AS VARCHAR)")


def _coverage(s, d) -> DataFrame:
    return b.table(s, d, "lineitem").selectExpr(
        "l_suppkey AS key", "cast(l_shipdate AS date) AS first", "date_add(cast(l_shipdate AS date), l_linenumber) AS last", "l_orderkey AS covered_at"
    )


_COV = "SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS first, CAST(l_shipdate AS DATE) + l_linenumber AS last, l_orderkey AS covered_at FROM lineitem"
_ISLANDS = """SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY key ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM cov)"""


def _sequenced(s, d) -> DataFrame:
    events = b.table(s, d, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "cast(ts AS date) AS day")
    return timeline.ingestion_sequence(events, ["ts", "event_id"], "day")


def _senate(s, d) -> DataFrame:
    rows = b.congress_trades(s, d).filter("chamber = 'Senate'")
    return rows.selectExpr(
        "row_id", "concat(cast(c_custkey AS string), '-', cast(year(trade_date) AS string)) AS group_key", "doc_id", "filing_date", "is_amendment", "filing_complete"
    )


_SENATE = """SELECT row_id, CAST(c_custkey AS VARCHAR) || '-' || CAST(year(trade_date) AS VARCHAR) AS group_key, doc_id, filing_date, is_amendment, filing_complete
 FROM congress WHERE chamber = 'Senate'"""


def _open_ranges(rows: DataFrame) -> DataFrame:
    """Some ranges that start at 0, and some that say nothing."""
    return rows.withColumns({"amount_low": F.when(F.col("row_id") % 3 == 0, 0.0).otherwise(F.col("amount_low")), "amount_high": F.when(F.col("row_id") % 6 == 0, 0.0).otherwise(F.col("amount_high"))})


def _bars(s, d) -> DataFrame:
    return b.prices(s, d)


def _ledger(s, d) -> DataFrame:
    """Two entries for every second filing: a try, and a later one of other luck."""
    tries = b.table(s, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey AS string) AS accession_number", "o_orderstatus = 'F' AS first_ok", "o_orderkey % 3 = 0 AS later_ok")
    state = lambda ok: F.when(F.col(ok), "success").otherwise("retryable_failure").alias("status")
    first = tries.select("accession_number", state("first_ok"), F.lit(1).alias("seq"), F.lit(1).alias("attempts"))
    return first.unionByName(tries.select("accession_number", state("later_ok"), F.lit(2).alias("seq"), F.lit(2).alias("attempts")))


def _fetched(s, d) -> DataFrame:
    """The same bars, some changed or lost."""
    bars = b.prices(s, d).filter("day(price_date) != 13 OR symbol != 'BRAND11'")
    return bars.withColumn("close", F.when(F.col("symbol") == "BRAND12", F.col("close") * 2).otherwise(F.col("close")))


_FETCHED = """SELECT * REPLACE (CASE WHEN symbol = 'BRAND12' THEN close * 2 ELSE close END AS close) FROM prices
 WHERE day(price_date) != 13 OR symbol != 'BRAND11'"""


def _watch(s, d) -> DataFrame:
    rows = [("company", "US", "brand11"), ("insider", "Europe", "SUPPLIER#000000003"), ("company", "Congress", "t7"), ("insider", "US", "Supplier#000000003")]
    return s.createDataFrame(rows, "kind string, market string, term string")


def links(view: str) -> str:
    """The links of duplicates in a view of US rows, without supersessions."""
    usable = """trade_type IN ('Buy', 'Sell', 'Exercise') AND transaction_code IN ('', 'P', 'S', 'M') AND NOT is_derivative
   AND NOT value_missing AND NOT shares_missing AND NOT price_missing AND filing_date IS NOT NULL"""
    near = "abs(abs(a.shares) - abs(n.shares)) <= 1e-6 AND abs(abs(a.value) - abs(n.value)) <= 1.0"
    return f"""WITH native AS (SELECT * FROM {view} WHERE accession_number != '' AND sec_row_id != '' AND {usable}),
 scraped AS (SELECT * FROM {view} WHERE accession_number = '' AND {usable}),
 met AS (SELECT a.row_id, n.accession_number, n.company, any_value(abs(a.shares)) AS own_s, any_value(abs(a.value)) AS own_v, sum(abs(n.shares)) AS s, sum(abs(n.value)) AS v,
   count(*) AS n, count(*) FILTER ({near}) AS singles, min(n.row_id) FILTER ({near}) AS one, min(n.row_id) AS lot
   FROM scraped a JOIN native n USING (ticker, insider_name, trade_date, filing_date, trade_type) GROUP BY a.row_id, n.accession_number, n.company),
 hits AS (SELECT row_id, CASE WHEN singles = 1 THEN one WHEN singles = 0 AND n > 1 AND abs(own_s - s) <= 1e-6 AND abs(own_v - v) <= 1.0 THEN lot END AS lot FROM met)
 SELECT row_id, min(lot) AS replacement, 'duplicate' AS reason FROM hits WHERE lot IS NOT NULL GROUP BY row_id HAVING count(*) = 1"""


def near_copies(s, d) -> DataFrame:
    """US rows with scraped copies of some filing rows, a little off."""
    us = b.us_trades(s, d)
    copies = us.filter("accession_number != '' AND batch % 3 = 0").selectExpr(
        "row_id + 1000000000000000000 AS row_id", *[c for c in us.columns if c not in ("row_id", "value", "source", "accession_number", "sec_row_id")],
        "value + 0.5 AS value", "'openinsider' AS source", "'' AS accession_number", "'' AS sec_row_id",
    )
    return us.unionByName(copies)


COPIES0 = f"""us0 AS ({b.US}), us AS (SELECT * FROM us0 UNION ALL BY NAME SELECT * REPLACE (row_id + 1000000000000000000 AS row_id, value + 0.5 AS value,
 'openinsider' AS source, '' AS accession_number, '' AS sec_row_id) FROM us0 WHERE accession_number != '' AND batch % 3 = 0)"""


#: The same rows beside the view ``us``.
COPIES = """copies AS (SELECT * FROM us UNION ALL BY NAME SELECT * REPLACE (row_id + 1000000000000000000 AS row_id, value + 0.5 AS value,
 'openinsider' AS source, '' AS accession_number, '' AS sec_row_id) FROM us WHERE accession_number != '' AND batch % 3 = 0)"""


def filed_rows(s, d) -> DataFrame:
    """Filing rows with their details, and amendments of some: repeated, corrected with and without saying so, and adding lots."""
    us = b.us_trades(s, d).filter("accession_number != ''")
    plain = us.selectExpr(
        "row_id", "accession_number", "sec_row_id", "lpad(cast(cik AS string), 10, '0') AS cik_issuer", "cast(abs(hash(insider_name)) % 100000 AS string) AS cik_insider",
        "last_day(trade_date) AS period_of_report", "'4' AS form_type", "coalesce(filing_date, trade_date) AS filing_date", "cast(NULL AS date) AS original_submission_date", "false AS is_amendment",
        "transaction_code", "'A' AS acquired_disposed", "'D' AS direct_or_indirect", "is_derivative", "trade_date", "shares", "shares_missing", "price", "price_missing", "value", "value_missing",
        "0D AS shares_owned_after", "true AS shares_owned_after_missing", "company", "batch",
    )
    said = F.when(F.col("batch") % 3 == 0, "Corrected the number of shares.").when(F.col("batch") % 3 == 1, "Corrects the price").otherwise("Adds an omitted lot; corrects the number of shares")
    amended = plain.filter("batch % 2 = 0").withColumns({
        "row_id": F.col("row_id") + F.lit(10**18), "accession_number": F.concat(F.lit("A"), "accession_number"), "form_type": F.lit("4/A"), "is_amendment": F.lit(True),
        "filing_date": F.date_add("filing_date", 30), "shares": F.when(F.col("batch") % 4 == 0, F.col("shares") + 1).otherwise(F.col("shares")), "remarks": said,
    })
    rows = plain.withColumn("remarks", F.lit("")).unionByName(amended)
    detail = F.to_json(F.struct(F.lit(True).alias("narrative_complete"), "remarks", F.col("company").alias("security_title")))
    return rows.withColumn("sec_detail_json", detail)


def _chain(s, d) -> DataFrame:
    """Replacement links in chains of up to 500 orders."""
    return b.table(s, d, "orders").filter("o_orderkey % 500 != 0").selectExpr("o_orderkey AS row_id", "o_orderkey + 1 AS replacement")


def _committee_members(s, d) -> DataFrame:
    """Members with the sectors of a committee each; their names are written surname first."""
    customer = b.table(s, d, "customer")
    named = members.demo_members(customer).join(customer.select(F.col("c_name").alias("member"), "c_custkey"), "member")
    shown = named.withColumn("name", F.concat_ws(" ", "last_name", "first_name")).withColumn("sectors", members.sectors(F.array(members.demo_committee(F.col("c_custkey")))))
    return shown.drop("c_custkey")


def _lots(s, d, amended: bool) -> DataFrame:
    return b.us_trades(s, d).filter(F.col("is_amendment") == amended).select(
        x.collapse_ws(x.fold(F.col("insider_name"))).alias("who"), "trade_type", "shares", "row_id"
    )


QUERIES = {
    "parse_date": lambda s, d: _text(s, d, DATE_TEXT).select("row_id", x.parse_date(F.col("raw")).alias("parsed")),
    "parse_number": lambda s, d: _text(s, d, NUMBER_TEXT).select("row_id", x.parse_number(F.col("raw")).alias("parsed")),
    "classify_trade": lambda s, d: _text(s, d, TRADE_TEXT).select("row_id", x.classify_trade(F.col("raw")).alias("kind")),
    "congress_tx_type": lambda s, d: _text(s, d, TX_TEXT).select("row_id", x.congress_type(F.col("raw")).alias("kind")),
    "congress_owner": lambda s, d: _text(s, d, OWNER_TEXT).select("row_id", x.congress_owner(F.col("raw")).alias("owner")),
    "amount_range": lambda s, d: _text(s, d, AMOUNT_TEXT).select("row_id", x.amount_range(F.col("raw")).alias("r")).select("row_id", "r.low", "r.high"),
    "extract_ticker": lambda s, d: _text(s, d, TICKER_TEXT).select("row_id", x.extract_ticker(F.col("raw")).alias("ticker")),
    "normalize_position": lambda s, d: _text(s, d, POSITION_TEXT).select("row_id", x.normalize_position(F.col("raw")).alias("category")),
    "normalize_cik": lambda s, d: _text(s, d, CIK_TEXT).select("row_id", x.normalize_cik(F.col("raw")).alias("cik")),
    "eu_total": lambda s, d: b.eu_trades(s, d).select("row_id", (F.col("volume") * F.col("price")).alias("total_value")),
    "subtract_months": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), x.subtract_months(F.col("o_orderdate").cast("date"), 6).alias("day")),
    "name_tokens": lambda s, d: _text(s, d, NAME_TEXT).select("row_id", F.array_join(x.name_tokens(F.col("raw")), " ").alias("tokens")),
    "canonical_key": lambda s, d: b.congress_trades(s, d).select("row_id", x.digest(F.col("official_name"), F.col("trade_date"), F.col("filing_date"), F.col("trade_type"), F.col("row_id")).alias("key")),
    "format_value": lambda s, d: b.us_trades(s, d).select("row_id", x.format_reported(F.floor("value").cast("double") + 0.5, F.col("value_missing")).alias("shown")),
    "us_identity": lambda s, d: trades.us_identity(b.us_trades(s, d)).groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id")),
    "us_merge": lambda s, d: trades.merge_us(b.us_trades(s, d)).select("identity", "ticker", "company", "insider_name", "trade_date", "filing_date", "trade_type", "value", "value_missing", "shares", "shares_missing", "price", "price_missing", "accession_number", "sec_row_id", "is_derivative", "provenance", "observations"),
    "eu_merge": lambda s, d: trades.first_filled(b.eu_trades(s, d), ["isin", "insider_name", "trade_type"], ["position", "volume", "filing_date"], ["arrival", "row_id", "price"]),
    "congress_merge": lambda s, d: trades.merge_congress(_open_ranges(b.congress_trades(s, d)), ["official_name", "trade_type"], ["row_id"]).select("official_name", "trade_type", "filing_date", "amount_low", "amount_high", "ticker", "filing_complete"),
    "last_filled": lambda s, d: trades.last_filled(b.congress_trades(s, d), ["official_name", "trade_type"], ["filing_date", "ticker"], ["row_id"]),
    "sec_reparse": lambda s, d: trades.last_wins(b.us_trades(s, d).filter("accession_number != ''"), ["accession_number", "sec_row_id"], ["row_id"]).select("accession_number", "sec_row_id", "row_id", "value"),
    "lot_sums": lambda s, d: trades.lot_sums(b.us_trades(s, d)),
    "dup_links": lambda s, d: trades.duplicate_links(near_copies(s, d)),
    "visible_us": lambda s, d: trades.visible(near_copies(s, d), trades.duplicate_links(near_copies(s, d))).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "senate_supersede": lambda s, d: trades.supersede_reports(_senate(s, d)),
    "visible_congress": lambda s, d: trades.visible(_senate(s, d), trades.supersede_reports(_senate(s, d))).select("row_id", "group_key"),
    "link_closure": lambda s, d: trades.close_links(_chain(s, d)),
    "lot_pairing": lambda s, d: trades.pair_lots(_lots(s, d, False), _lots(s, d, True), ["who", "trade_type", "shares"]),
    "issuer_scope": lambda s, d: trades.issuer_scope(b.us_trades(s, d), ["BRAND11"]).select("row_id", "cik"),
    "us_with_ledger": lambda s, d: trades.with_ledger(b.us_trades(s, d).filter("accession_number != ''"), trades.best_ledger(_ledger(s, d))).select("row_id", "status", "attempts"),
    "ingestion_seq": lambda s, d: _sequenced(s, d).select("event_id", "sequence"),
    "alerts_new": lambda s, d: timeline.pending_alerts(_sequenced(s, d).filter("event_type = 'purchase' OR value > 50"), 500, 100).select("sequence", "event_id"),
    "alerts_count": lambda s, d: _sequenced(s, d).filter("sequence > 500 AND value > 50").agg(F.count(F.lit(1)).alias("n")),
    "alerts_watchlist": lambda s, d: timeline.watched(b.feed(s, d), _watch(s, d)).select("market", "row_id"),
    "coverage_islands": lambda s, d: timeline.islands(_coverage(s, d), "key"),
    "coverage_islands_at": lambda s, d: timeline.islands_at(_coverage(s, d), "key"),
    "coverage_gaps": lambda s, d: timeline.gaps(_coverage(s, d), "key", LO, HI),
    "coverage_remove": lambda s, d: timeline.remove(_coverage(s, d).select("key", "covered_at", "first", "last"), date(1997, 3, 3), date(1997, 3, 4)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(F.col("last") == F.lit(date(1997, 3, 2))).alias("cut")),
    "price_bars": lambda s, d: _bars(s, d).filter((F.col("symbol") == "BRAND11") & F.col("price_date").between(F.lit(LO), F.lit(HI))).orderBy("price_date"),
    "price_coverage": lambda s, d: _bars(s, d).groupBy("symbol").agg(F.min("price_date").alias("first"), F.max("price_date").alias("last")),
    "price_valid": lambda s, d: _bars(s, d).withColumn("low", F.when(F.day("price_date") == 9, F.col("high") + 1).otherwise(F.col("low"))).filter(timeline.valid_bar()).select("symbol", "price_date", "low"),
    "price_upsert": lambda s, d: timeline.upsert_bars(_bars(s, d).withColumn("arrival", F.lit(0)).unionByName(_fetched(s, d).withColumn("arrival", F.lit(1))), "arrival").select("symbol", "price_date", "close"),
    "price_basis_changed": lambda s, d: timeline.basis_changed(_bars(s, d), _fetched(s, d)),
    "price_replacement_ok": lambda s, d: timeline.replacement_ok(_bars(s, d), _fetched(s, d)),
    "price_overlap": lambda s, d: timeline.nearest_bars(_bars(s, d), date(1997, 5, 1), date(1997, 5, 20)),
    "asof_markers": lambda s, d: timeline.asof_close(b.us_trades(s, d).select("row_id", F.col("ticker").alias("symbol"), F.col("trade_date").alias("day")), _bars(s, d).filter("day(price_date) <= 20")),
    "orphan_rows": lambda s, d: b.table(s, d, "lineitem").join(b.table(s, d, "orders").filter("o_orderkey % 9 != 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")),
    "filing_assembly": lambda s, d: compare.assemble_filings(b.table(s, d, "orders").selectExpr("o_orderkey AS accession", "o_orderstatus AS form"), {"rows": b.table(s, d, "lineitem").selectExpr("l_orderkey AS accession", "l_linenumber AS line", "l_partkey AS part")}).select("accession", "form", F.size("rows").cast("long").alias("rows"), F.get("rows", F.lit(0))["part"].alias("first_part")),
    "sec_compare": lambda s, d: compare.compare_lots(near_copies(s, d)),
    "sec_supersede": lambda s, d: compare.supersede_lines(compare.line_rows(filed_rows(s, d), _ledger(s, d))),
    "flag_congress": lambda s, d: members.flag(b.congress_trades(s, d).select("row_id", F.col("official_name").alias("name")), members.demo_members(b.table(s, d, "customer"))),
    "congress_filter": lambda s, d: trades.filter_congress(members.official_sectors(b.congress_trades(s, d), _committee_members(s, d)), trade_type="Purchase", min_value=15001, sector="Technology", since=LO, until=HI).select("row_id", "amount_low"),
    "sector_counts": lambda s, d: b.table(s, d, "customer").select(F.explode(members.sectors(F.array(members.demo_committee(F.col("c_custkey")), members.demo_committee(F.col("c_custkey") + 3)))).alias("sector")).groupBy("sector").agg(F.count(F.lit(1)).alias("n")),
}


def _orders(expression: str, raw: str, name: str) -> str:
    return f"SELECT row_id, {expression} AS {name} FROM (SELECT o_orderkey AS row_id, {_duck(raw)} AS raw FROM orders)"


def _match(raw: str, results: list[str], name: str) -> str:
    """Texts that repeat by order number, with the results to expect in turn."""
    n = len(results)
    cases = " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(results))
    return f"SELECT o_orderkey AS row_id, CASE o_orderkey % {n} {cases} END AS {name} FROM orders"


_NATIVE = "bool_or(accession_number != '' AND sec_row_id != '')"


def _either(c: str) -> str:
    """The last of a filing row, the greatest of what scrapers saw."""
    return f"CASE WHEN {_NATIVE} THEN arg_max_null({c}, row_id) ELSE max({c}) END AS {c}"


def _number(c: str) -> str:
    best = f"max((NOT {c}_missing, abs({c}), {c}))"
    return f"""CASE WHEN {_NATIVE} THEN arg_max({c}, row_id) ELSE {best}[3] END AS {c},
 CASE WHEN {_NATIVE} THEN arg_max({c}_missing, row_id) ELSE NOT {best}[1] END AS {c}_missing"""


SQL = {
    "parse_date": _match(DATE_TEXT, ["DATE '2024-03-05'", "DATE '2024-03-05'", "DATE '1970-03-05'", "NULL", "NULL", "DATE '2024-03-05'", "DATE '2068-12-31'", "NULL"], "parsed"),
    "parse_number": "SELECT o_orderkey AS row_id, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000 + 0.5 WHEN 1 THEN -o_custkey WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE o_custkey END AS DOUBLE) AS parsed FROM orders",
    "classify_trade": _match(TRADE_TEXT, ["'Buy'", "'Other'", "'Sell'", "'Buy'", "'Exercise'", "'Exercise'", "'Other'", "'Other'", "'Sell'"], "kind"),
    "congress_tx_type": _match(TX_TEXT, ["'Sale'", "'Purchase'", "'Exchange'", "'Sale'", "'Other'", "'Purchase'"], "kind"),
    "congress_owner": _match(OWNER_TEXT, ["'Self'", "'Spouse'", "'Dependent Child'", "'Joint'", "'TRUST'", "'Spouse'"], "owner"),
    "amount_range": """SELECT o_orderkey AS row_id, CAST([1001, 50000000, 1000, 0, 0, 5][o_orderkey % 6 + 1] AS DOUBLE) AS low,
 CAST([15000, 50000000, 1000, 0, 0, 10.5][o_orderkey % 6 + 1] AS DOUBLE) AS high FROM orders""",
    "extract_ticker": _orders(r"regexp_extract(raw, '\(([A-Z]{1,5}(?:[.-][A-Z])?)\)', 1)", TICKER_TEXT, "ticker"),
    "normalize_position": _match(POSITION_TEXT, ["'Executive'", "'Non-Executive'", "'Non-Executive'", "'Major Shareholder'", "'Other'", "'Board Member'", "'Other'", "'Executive'"], "category"),
    "normalize_cik": _orders("CASE WHEN regexp_full_match(raw, '[0-9]{1,10}') THEN lpad(raw, 10, '0') ELSE '' END", CIK_TEXT, "cik"),
    "eu_total": sql("SELECT row_id, volume * price AS total_value FROM eu"),
    "subtract_months": "SELECT o_orderkey AS row_id, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS day FROM orders",
    "name_tokens": _match(NAME_TEXT, ["'john q public'", "'o''neil-smith'", "'mary jones'", "''", "'ann lee'"], "tokens"),
    "canonical_key": sql("""SELECT row_id, sha256(concat_ws(chr(31), '=' || official_name, '=' || CAST(trade_date AS VARCHAR), coalesce('=' || CAST(filing_date AS VARCHAR), '~'),
 '=' || trade_type, '=' || CAST(row_id AS VARCHAR))) AS key FROM congress"""),
    "format_value": sql("SELECT row_id, CASE WHEN value_missing THEN 'N/A' ELSE format('{:,}', CAST(round_even(floor(value) + 0.5, 0) AS BIGINT)) END AS shown FROM us"),
    "us_identity": sql("SELECT identity, count(*) AS n, min(row_id) AS row_id FROM ided GROUP BY identity", "__IDED__"),
    "us_merge": sql(f"""SELECT identity, {", ".join(_either(c) for c in ("ticker", "company", "insider_name", "trade_date", "filing_date", "trade_type", "is_derivative"))},
 {", ".join(_number(c) for c in ("value", "shares", "price"))}, max((accession_number, sec_row_id))[1] AS accession_number, max((accession_number, sec_row_id))[2] AS sec_row_id,
 array_to_string(list_sort(list_distinct(list(source))), ',') AS provenance, count(*) AS observations FROM ided GROUP BY identity""", "__IDED__"),
    "eu_merge": sql("""SELECT isin, insider_name, trade_type, arg_min(position, (arrival, row_id, price)) FILTER (WHERE position != '') AS position,
 arg_min(volume, (arrival, row_id, price)) FILTER (WHERE volume IS NOT NULL) AS volume, arg_min(filing_date, (arrival, row_id, price)) FILTER (WHERE filing_date IS NOT NULL) AS filing_date
 FROM eu GROUP BY isin, insider_name, trade_type"""),
    "congress_merge": sql("""SELECT official_name, trade_type, arg_max(filing_date, row_id) FILTER (WHERE filing_date IS NOT NULL) AS filing_date,
 coalesce(arg_max(amount_low, row_id) FILTER (WHERE row_id % 6 != 0), 0) AS amount_low, coalesce(arg_max(amount_high, row_id) FILTER (WHERE row_id % 6 != 0), 0) AS amount_high,
 arg_max(ticker, row_id) AS ticker, arg_max(filing_complete, row_id) AS filing_complete FROM (SELECT * REPLACE (CASE WHEN row_id % 3 = 0 THEN 0 ELSE amount_low END AS amount_low,
 CASE WHEN row_id % 6 = 0 THEN 0 ELSE amount_high END AS amount_high) FROM congress) GROUP BY official_name, trade_type"""),
    "last_filled": sql("""SELECT official_name, trade_type, arg_max(filing_date, row_id) FILTER (WHERE filing_date IS NOT NULL) AS filing_date,
 arg_max(ticker, row_id) AS ticker FROM congress GROUP BY official_name, trade_type"""),
    "sec_reparse": sql("""SELECT accession_number, sec_row_id, max(row_id) AS row_id, arg_max(value, row_id) AS value FROM us WHERE accession_number != ''
 GROUP BY accession_number, sec_row_id"""),
    "lot_sums": sql("""SELECT accession_number, company, sum(CAST(abs(shares) AS DECIMAL(18,2))) AS shares, sum(CAST(abs(value) AS DECIMAL(18,2))) AS value, count(*) AS lots
 FROM us WHERE accession_number != '' GROUP BY accession_number, company"""),
    "dup_links": f"WITH {COPIES0} SELECT * FROM ({links('us')})",
    "visible_us": f"WITH {COPIES0}, links AS ({links('us')}) SELECT source, count(*) AS n FROM us WHERE row_id NOT IN (SELECT row_id FROM links) GROUP BY source",
    "senate_supersede": sql("""SELECT r.row_id, w.first_row AS replacement, 'superseded' AS reason FROM r JOIN w USING (group_key)
 WHERE r.doc_id != w.doc_id AND r.filing_date < w.filed""", "__SENATE__"),
    "visible_congress": sql("""SELECT row_id, group_key FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.group_key = r.group_key
 AND r.doc_id != w.doc_id AND r.filing_date < w.filed)""", "__SENATE__"),
    "link_closure": """SELECT o.o_orderkey AS row_id, e.e AS replacement FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 500 != 0) o
 ASOF JOIN (SELECT o_orderkey + 1 AS e FROM orders WHERE o_orderkey % 500 != 0 AND ((o_orderkey + 1) % 500 = 0 OR o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders))) e ON o.o_orderkey < e.e""",
    "lot_pairing": sql("""SELECT a.row_id AS old_row, b.row_id AS new_row FROM lots a JOIN lots b ON NOT a.is_amendment AND b.is_amendment AND a.who = b.who
 AND a.trade_type = b.trade_type AND a.shares = b.shares AND a.k = b.k""", """lots AS (SELECT lower(trim(insider_name)) AS who, trade_type, shares, row_id, is_amendment,
 row_number() OVER (PARTITION BY lower(trim(insider_name)), trade_type, shares, is_amendment ORDER BY row_id) AS k FROM us)"""),
    "issuer_scope": sql("SELECT row_id, cik FROM us WHERE cik IN (SELECT cik FROM us WHERE ticker = 'BRAND11')"),
    "us_with_ledger": sql("""SELECT row_id, status, attempts FROM us LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS accession_number,
 CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN 'success' ELSE 'retryable_failure' END AS status, CAST(3 AS BIGINT) AS attempts FROM orders WHERE o_orderkey % 2 = 0) USING (accession_number)
 WHERE accession_number != ''"""),
    "ingestion_seq": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM events",
    "alerts_new": """SELECT sequence, event_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM events)
 WHERE (event_type = 'purchase' OR value > 50) AND sequence > 500 ORDER BY sequence LIMIT 100""",
    "alerts_count": "SELECT count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM events) WHERE value > 50 AND sequence > 500",
    "alerts_watchlist": sql("""SELECT market, row_id FROM feed WHERE (market = 'US' AND lower(identifier) = 'brand11') OR (market = 'Europe' AND lower(person) = 'supplier#000000003')
 OR (market = 'Congress' AND lower(identifier) = 't7') OR (market = 'US' AND lower(person) = 'supplier#000000003')"""),
    "coverage_islands": f"WITH cov AS ({_COV}) SELECT key, min(first) AS first, max(last) AS last FROM ({_ISLANDS}) GROUP BY key, island",
    "coverage_islands_at": f"WITH cov AS ({_COV}) SELECT key, min(first) AS first, max(last) AS last, min(covered_at) AS covered_at FROM ({_ISLANDS}) GROUP BY key, island",
    "coverage_gaps": f"""WITH cov AS ({_COV}), days AS (SELECT key, CAST(d AS DATE) AS d FROM (SELECT DISTINCT key FROM cov), range(DATE '1996-01-01', DATE '2000-01-01', INTERVAL 1 DAY) t(d)),
 open AS (SELECT key, d FROM days WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.key = days.key AND days.d BETWEEN cov.first AND cov.last))
 SELECT key, min(d) AS first, max(d) AS last FROM (SELECT key, d, d - CAST(row_number() OVER (PARTITION BY key ORDER BY d) AS INT) AS g FROM open) GROUP BY key, g""",
    "coverage_remove": f"""WITH cov AS ({_COV}), cut AS (SELECT key, first, least(last, CASE WHEN last >= DATE '1997-03-03' AND first <= DATE '1997-03-04' THEN DATE '1997-03-02' ELSE last END) AS last FROM cov
 UNION ALL SELECT key, greatest(first, DATE '1997-03-05'), last FROM cov WHERE last >= DATE '1997-03-03' AND first <= DATE '1997-03-04')
 SELECT key, count(*) AS n, min(first) AS first, max(last) AS last, count(*) FILTER (WHERE last = DATE '1997-03-02') AS cut FROM cut WHERE first <= last GROUP BY key""",
    "price_bars": sql("SELECT * FROM prices WHERE symbol = 'BRAND11' AND price_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"),
    "price_coverage": sql("SELECT symbol, min(price_date) AS first, max(price_date) AS last FROM prices GROUP BY symbol"),
    "price_valid": sql("SELECT symbol, price_date, low FROM prices WHERE day(price_date) != 9"),
    "price_upsert": sql(f"SELECT symbol, price_date, coalesce(f.close, p.close) AS close FROM prices p LEFT JOIN ({_FETCHED}) f USING (symbol, price_date)"),
    "price_basis_changed": sql(f"SELECT symbol, count(*) AS overlap, bool_or(abs(p.close - f.close) > greatest(1e-8, 1e-6 * greatest(abs(p.close), abs(f.close)))) AS changed FROM prices p JOIN ({_FETCHED}) f USING (symbol, price_date) GROUP BY symbol"),
    "price_replacement_ok": sql(f"SELECT symbol, count(*) FILTER (WHERE f.close IS NULL) AS missing FROM prices p LEFT JOIN ({_FETCHED}) f USING (symbol, price_date) GROUP BY symbol"),
    "price_overlap": sql("SELECT symbol, max(price_date) FILTER (WHERE price_date < DATE '1997-05-01') AS before, min(price_date) FILTER (WHERE price_date > DATE '1997-05-20') AS after FROM prices GROUP BY symbol"),
    "asof_markers": sql("""SELECT m.row_id, m.symbol, m.day, coalesce(q.close, f.close) AS close FROM (SELECT row_id, ticker AS symbol, trade_date AS day FROM us) m
 ASOF LEFT JOIN (SELECT * FROM prices WHERE day(price_date) <= 20) q ON m.symbol = q.symbol AND m.day >= q.price_date
 LEFT JOIN (SELECT symbol, arg_min(close, price_date) AS close FROM prices WHERE day(price_date) <= 20 GROUP BY symbol) f ON f.symbol = m.symbol"""),
    "orphan_rows": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 9 != 0) GROUP BY l_orderkey",
    "filing_assembly": """SELECT o_orderkey AS accession, o_orderstatus AS form, coalesce(n, 0) AS rows, part AS first_part FROM orders LEFT JOIN (
 SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "congress_filter": sql("SELECT row_id, amount_low FROM congress WHERE trade_type = 'Purchase' AND amount_low >= 15001 AND c_custkey % 6 = 3 AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"),
    "flag_congress": sql("SELECT row_id, official_name AS name, official_name AS member FROM congress WHERE c_custkey % 3 = 0"),
    "sector_counts": """SELECT sector, count(*) AS n FROM (SELECT DISTINCT c_custkey, sector FROM (SELECT c_custkey,
 unnest([['Defense', 'Energy', 'Finance', 'Technology', 'Healthcare', 'Other'][c_custkey % 6 + 1], ['Defense', 'Energy', 'Finance', 'Technology', 'Healthcare', 'Other'][(c_custkey + 3) % 6 + 1]]) AS sector
 FROM customer) WHERE sector != 'Other') GROUP BY sector""",
}

_IDED = r"""ided AS (SELECT *, CASE WHEN accession_number != '' AND sec_row_id != '' THEN sha256(concat_ws(chr(31), '=sec', '=' || accession_number, '=' || sec_row_id))
 ELSE sha256(concat_ws(chr(31), '=scraper', '=' || upper(trim(ticker)), '=' || lower(trim(insider_name)), '=' || CAST(trade_date AS VARCHAR), '=' || trade_type,
 '=' || CAST(abs(shares) AS VARCHAR), '=' || CAST(price AS VARCHAR), '=' || CAST(shares_missing AS VARCHAR), '=' || CAST(price_missing AS VARCHAR))) END AS identity FROM us)"""
_SENATE_VIEWS = f"""r AS ({_SENATE}), docs AS (SELECT group_key, doc_id, min(filing_date) AS filed, bool_and(is_amendment) AS amended, bool_or(is_amendment) AS some_,
 bool_and(filing_complete) AS complete, min(row_id) AS first_row FROM r WHERE filing_date IS NOT NULL GROUP BY group_key, doc_id), g AS (SELECT group_key, count(*) FILTER (WHERE NOT some_) AS originals,
 max(filed) FILTER (WHERE NOT some_) AS original_filed, max((filed, doc_id, first_row)) FILTER (WHERE amended AND complete) AS win FROM docs GROUP BY group_key),
 w AS (SELECT group_key, win[1] AS filed, win[2] AS doc_id, win[3] AS first_row FROM g WHERE originals <= 1 AND win IS NOT NULL AND (original_filed IS NULL OR original_filed <= win[1]))"""
SQL = {k: v.replace("__IDED__", _IDED).replace("__SENATE__", _SENATE_VIEWS) for k, v in SQL.items()}
