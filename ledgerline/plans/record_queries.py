"""Registered queries over record handling: national texts, filing details, upserts, coverage, alerts, members; with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import localized as loc
from ledgerline.operators import alerts, datasets, members, timeline, trades, upsert
from ledgerline.operators import feed as feeds
from ledgerline.operators.feed import FeedCriteria
from ledgerline.plans import bridge as b
from ledgerline.plans.bridge import sql


def _cases(values: list[str]) -> str:
    """Texts that repeat by order number."""
    shown = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE o_orderkey % {len(values)} {shown} END"


def _texts(s, d, values: list[str]) -> DataFrame:
    return b.table(s, d, "orders").selectExpr("o_orderkey AS row_id", f"{_cases(values)} AS raw")


def _told(results: list[str], name: str) -> str:
    return f"SELECT o_orderkey AS row_id, {_cases(results)} AS {name} FROM orders"


GERMAN_DATES = ["'05.03.2024'", "'5.3.2024 10:11:12'", "'2024-03-05'", "'31.02.2024'", "''"]
FRENCH_DATES = ["'5 mars 2024'", "'12 AOÛT 2023'", "'2024-03-05T10:00'", "'31 fevrier 2024'", "'mars 2024'"]
UK_DATES = ["'6 March 2026'", "'March 6, 2026'", "'06/03/2026'", "'2026-03-06'", "'6.3.2026'", "'soon'"]
DUTCH_DATES = ["'2024-03-05T00:00:00'", "'05-03-2024'", "'05/03/2024'", "'x'"]
KINDS = {
    "german_type": (loc.german_type, ["'Kauf'", "' verkauf '", "'Sonstiges'", "'Kaufoption'"], ["'Buy'", "'Sell'", "'Other'", "'Other'"]),
    "german_instrument": (loc.german_instrument, ["'Aktie'", "'DERIVAT'", "' Fonds '"], ["'Share'", "'Derivative'", "'Fonds'"]),
    "french_type": (loc.french_type, ["'Acquisition'", "'Cession de titres'", "'Exercice'", "'Don'"], ["'Buy'", "'Sell'", "'Buy'", "'Other'"]),
    "uk_type": (loc.uk_type, ["'Acquisition of shares'", "'Disposal'", "'Sold on exercise'", "'Transfer'"], ["'Buy'", "'Sell'", "'Buy'", "'Other'"]),
    "dutch_type": (loc.dutch_type, ["'Verkoop'", "'Aankoop'", "'koop'", "'schenking'"], ["'Sell'", "'Buy'", "'Buy'", "'Other'"]),
}
DECIMALS = ["'10.50'", "'10.5'", "'0100'", "'-0.0'", "'1e2'", "'none'"]
PRICES = ["'12,5 €'", "'1 234.5 USD'", "'£3'", "'abc'"]
CELLS = ["'Price(s)  Volume(s) €0.065  12 345'", "'£1,5'", "'none'", "'$10 20 000,5'"]
ROLES = ["'OFFICER, DIRECTOR'", "'10% Owner'", "'Boss'", "'Director/King'", "'Other;TenPercentOwner'"]


def _ranges(s, d) -> DataFrame:
    return b.table(s, d, "orders").selectExpr("o_orderkey AS row_id", "cast(o_orderdate AS date) AS since", "date_add(cast(o_orderdate AS date), cast(o_orderkey % 400 AS int)) AS until")


_RANGES = "SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS since, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS until FROM orders"


def _owners(s, d) -> DataFrame:
    """Detail objects with owners: valid, some broken, none, no object."""
    text = """CASE o_orderkey % 4 WHEN 0 THEN concat('{"reporting_owners":[{"cik":"', o_custkey, '"},{"cik":"7"}]}')
 WHEN 1 THEN '{"reporting_owners":[{"cik":"x"},{"cik":"7"}]}' WHEN 2 THEN '{}' ELSE 'broken' END"""
    return b.table(s, d, "orders").selectExpr("o_orderkey AS row_id", "cast(o_custkey AS string) AS cik", f"{text} AS json")


def _observed(s, d, part: int) -> DataFrame:
    """US rows of the model's core: what is stored (part 0), and what comes in, some changed, some invalid."""
    rows = b.us_trades(s, d).select(
        "row_id", "ticker", "company", "insider_name", "trade_type", "trade_date", "filing_date", "shares", "shares_missing", "price", "price_missing", "value", "value_missing",
        "source", "accession_number", "sec_row_id", "is_derivative", "batch",
    )
    if not part:
        return rows.filter("batch % 2 = 0")
    changed = rows.withColumn("value", F.when(F.col("batch") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return changed.withColumn("shares", F.when(F.col("batch") % 9 == 0, -F.col("shares")).otherwise(F.col("shares")))


def _stored_us(s, d) -> DataFrame:
    return trades.merge_us(_observed(s, d, 0).drop("batch")).drop("observations")


def _upsert_us(s, d) -> upsert.Upsert:
    incoming = _observed(s, d, 1).drop("batch").withColumn("arrival", F.col("row_id"))
    return upsert.upsert_us(_stored_us(s, d), incoming.drop("row_id"))


def _congress(s, d) -> DataFrame:
    rows = b.congress_trades(s, d)
    return rows.select("row_id", "official_name", "chamber", "source", "trade_type", "trade_date", "filing_date", "ticker", "amount_low", "amount_high", "doc_id", "filing_complete")


def _upsert_congress(s, d) -> upsert.Upsert:
    """Every order stored without a number but some with; all come in with numbers, and a third again without."""
    rows = _congress(s, d)
    number = F.lit("7")
    stored = rows.filter("row_id % 2 = 0").withColumn("source_row_id", F.when(F.col("row_id") % 8 == 0, number).otherwise("")).drop("row_id")
    first = rows.filter("row_id % 5 != 0").withColumn("source_row_id", number).withColumn("arrival", F.col("row_id") * 2)
    again = rows.filter("row_id % 3 = 0").withColumn("source_row_id", F.lit("")).withColumn("arrival", F.col("row_id") * 2 + 1)
    return upsert.upsert_congress(stored, first.unionByName(again).drop("row_id"))


def _progress(s, d) -> DataFrame:
    """Archive members by customer: those below 100 have been read, every seventh failed; now all are tried, every third fails."""
    orders = b.table(s, d, "orders").selectExpr("cast(o_custkey % 10 AS string) AS archive_id", "'all' AS scope", "o_orderkey AS member")
    progress = orders.select("archive_id", "scope").distinct().withColumn("next_member", F.lit(100).cast("long"))
    retries = orders.filter("member < 100 AND member % 7 = 0")
    batch = orders.withColumn("failed", F.col("member") % 3 == 0)
    ahead, left = upsert.archive_progress(progress, retries, batch.filter("member >= 100 OR member % 7 = 0"))
    return ahead.join(left.groupBy("archive_id").agg(F.count(F.lit(1)).alias("retries")), "archive_id", "left").select("archive_id", "next_member", F.coalesce("retries", F.lit(0)).alias("retries"))


TODAY = date(1998, 6, 1)


def _scanned(s, d) -> DataFrame:
    return b.table(s, d, "lineitem").selectExpr(
        "CASE l_suppkey % 2 WHEN 0 THEN 'us' ELSE 'eu' END AS domain", "cast(l_suppkey AS string) AS identifier", "'x' AS source", "cast(l_shipdate AS date) AS first",
        "date_add(cast(l_shipdate AS date), l_linenumber) AS last", "l_orderkey AS covered_at",
    )


_SCANNED = """SELECT CASE l_suppkey % 2 WHEN 0 THEN 'us' ELSE 'eu' END AS domain, CAST(l_suppkey AS VARCHAR) AS identifier, 'x' AS source, CAST(l_shipdate AS DATE) AS first,
 CAST(l_shipdate AS DATE) + l_linenumber AS last, l_orderkey AS covered_at FROM lineitem"""


def _requests(s, d) -> DataFrame:
    """A request of every supplier, some long past, some up to today."""
    return b.table(s, d, "supplier").selectExpr(
        "CASE s_suppkey % 2 WHEN 0 THEN 'us' ELSE 'eu' END AS domain", "cast(s_suppkey AS string) AS identifier", "'x' AS source",
        "date_add(DATE'1998-03-01', cast(s_suppkey % 30 AS int)) AS start", "date_add(DATE'1998-05-01', cast(s_suppkey % 40 AS int)) AS end",
    )


def _refreshed(s, d) -> DataFrame:
    return b.table(s, d, "supplier").selectExpr(
        "CASE s_suppkey % 2 WHEN 0 THEN 'us' ELSE 'eu' END AS domain", "cast(s_suppkey AS string) AS identifier", "'x' AS source",
        "timestampadd(HOUR, -cast(s_suppkey % 48 AS int), TIMESTAMP_NTZ'1998-06-01 12:00:00') AS refreshed_at",
    )


def _ingested(s, d) -> DataFrame:
    """The order in which members' trades came in."""
    rows = b.congress_trades(s, d).select("row_id", F.col("trade_date").alias("day"))
    return timeline.ingestion_sequence(rows, ["day", "row_id"], "day").select(F.lit("Congress").alias("market"), "row_id", "sequence")


def _rules() -> tuple[alerts.AlertStore, alerts.WatchStore]:
    store = alerts.AlertStore().put(alerts.Rule("large", FeedCriteria(value_min=100001.0), seen=500)).put(alerts.Rule("sales", FeedCriteria(directions=("Sell",))))
    store = store.put(alerts.Rule("watched", FeedCriteria(value_min=1e12), watchlist="mine")).put(alerts.Rule("lost", watchlist="none")).put(alerts.Rule("off", enabled=False))
    lists = alerts.WatchStore().put("Mine", [alerts.WatchEntry("company", "Congress", "t7"), alerts.WatchEntry("insider", "Congress", "customer#000000003")])
    return store, lists


def _membership(s, d) -> DataFrame:
    """Members, the committees they sit on (one a subcommittee), and the committees' names."""
    customer = b.table(s, d, "customer")
    who = customer.selectExpr("cast(c_custkey AS string) AS bioguide_id")
    sits = customer.selectExpr("cast(c_custkey AS string) AS member_id", "explode(array(concat('C00', c_custkey % 6), concat('C00', (c_custkey + 3) % 6, '01'), 'ZZZZ')) AS committee_id").withColumn("position", F.length("committee_id"))
    names = s.createDataFrame([(f"C00{i}", n) for i, n in enumerate(("Armed Services", "Energy", "Banking", "Science", "Health", "Rules"))], "committee_id string, committee string")
    return members.with_committees(who, sits, names)


QUERIES = {
    "german_date": lambda s, d: _texts(s, d, GERMAN_DATES).select("row_id", loc.german_date(F.col("raw")).alias("day")),
    "french_date": lambda s, d: _texts(s, d, FRENCH_DATES).select("row_id", loc.french_date(F.col("raw")).alias("day")),
    "uk_date": lambda s, d: _texts(s, d, UK_DATES).select("row_id", loc.uk_date(F.col("raw")).alias("day")),
    "dutch_date": lambda s, d: _texts(s, d, DUTCH_DATES).select("row_id", loc.dutch_date(F.col("raw")).alias("day")),
    **{name: (lambda s, d, f=f, v=v: _texts(s, d, v).select("row_id", f(F.col("raw")).alias("kind"))) for name, (f, v, _) in KINDS.items()},
    "french_price": lambda s, d: _texts(s, d, PRICES).select("row_id", loc.french_price(F.col("raw")).alias("p")).select("row_id", "p.*"),
    "uk_price_volume": lambda s, d: _texts(s, d, CELLS).select("row_id", loc.uk_price_volume(F.col("raw")).alias("p")).select("row_id", "p.*"),
    "decimal_text": lambda s, d: _texts(s, d, DECIMALS).select("row_id", loc.decimal_text(F.col("raw")).alias("shown")),
    "relationship_roles": lambda s, d: _texts(s, d, ROLES).select("row_id", loc.relationship_roles(F.col("raw")).alias("r")).select("row_id", "r.*"),
    "insider_title": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), loc.insider_title(F.when(F.col("o_orderkey") % 2 == 0, F.lit("CFO")), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 11 == 0, F.lit("")).alias("title")),
    "derived_value": lambda s, d: b.table(s, d, "lineitem").select(loc.derived_value(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")), F.lit(2.0), F.when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))).alias("v")).groupBy(F.col("v.error").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v.value").cast("decimal(20,2)")).alias("value")),
    "owner_ciks": lambda s, d: _owners(s, d).select("row_id", F.array_join(loc.owner_ciks(loc.detail_of(F.col("json")), F.col("cik")), ",").alias("owners")),
    "row_provenance": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.array_join(loc.provenance_of(F.when(F.col("o_orderkey") % 2 == 0, '["b","a"]').otherwise("[1"), F.lit("c")), ",").alias("provenance")),
    "index_years": lambda s, d: _ranges(s, d).select("row_id", F.array_join(loc.index_years(F.col("since"), F.col("until")), ",").alias("years")),
    "required_quarters": lambda s, d: _ranges(s, d).select("row_id", F.size(loc.required_quarters(F.date_add("since", 3650), F.date_add("until", 3650))).alias("quarters"), F.element_at(loc.required_quarters(F.date_add("since", 3650), F.date_add("until", 3650)), -1).alias("last")).filter("quarters > 0"),
    "daily_index_path": lambda s, d: _ranges(s, d).select("row_id", loc.daily_index_path(F.col("since")).alias("path")),
    "quarter_gaps": lambda s, d: datasets.quarter_plan(b.table(s, d, "orders").filter("month(o_orderdate) < 7").selectExpr("trunc(date_add(cast(o_orderdate AS date), 3650), 'quarter') AS quarter"), _ranges(s, d).selectExpr("date_add(since, 3650) AS since", "date_add(until, 3650) AS until"))[1],
    "scan_days": lambda s, d: datasets.scan_requests(s, ["abc", "def ", "ABC"], date(2024, 2, 27), date(2024, 3, 2)),
    "describe_incomplete": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), loc.describe_incomplete(F.when(F.col("o_orderkey") % 3 == 0, "complete").otherwise("partial"), F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: F.struct(F.lit("x").alias("source"), i.cast("string").alias("identifier"), F.lit("missing_table").alias("reason")))).alias("text")),
    "upsert_us": lambda s, d: _upsert_us(s, d).counts(),
    "upsert_congress": lambda s, d: _upsert_congress(s, d).counts(),
    "upsert_congress_rows": lambda s, d: _upsert_congress(s, d).rows.groupBy((F.col("source_row_id") != "").alias("numbered")).agg(F.count(F.lit(1)).alias("n")),
    "archive_progress": _progress,
    "coverage_add": lambda s, d: timeline.add_coverage(_scanned(s, d).filter("covered_at % 2 = 0"), _scanned(s, d).filter("covered_at % 2 = 1"), TODAY).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("covered_at").alias("oldest")),
    "scan_gaps": lambda s, d: timeline.plan_scan(_requests(s, d), _scanned(s, d), _refreshed(s, d), "1998-06-01 12:00:00", 24),
    "uncovered": lambda s, d: timeline.uncovered(_requests(s, d), _scanned(s, d), ["domain", "identifier", "source"]),
    "alerts_evaluate": lambda s, d: alerts.evaluate(b.feed(s, d), _ingested(s, d), *_rules()),
    "investigation": lambda s, d: feeds.investigation(b.feed(s, d), "congress:7").select("section", "market", "row_id", "person", "identifier"),
    "member_committees": lambda s, d: _membership(s, d).select("bioguide_id", F.array_join("committees", ";").alias("committees"), F.array_join("sectors", ";").alias("sectors")),
    "merged_order": lambda s, d: trades.merged_order(b.us_trades(s, d).withColumn("trade_date", F.when(F.col("batch") % 7 == 0, None).otherwise(F.col("trade_date"))), "row_id", 100).select("row_id", "trade_date"),
}

_FIRST_DAYS = "generate_series(date_trunc('quarter', since), date_trunc('quarter', until), INTERVAL 3 MONTH)"
_QUARTERS = f"""SELECT row_id, since, until, CASE WHEN until >= date_trunc('quarter', until) + INTERVAL 3 MONTH - INTERVAL 8 DAY THEN date_trunc('quarter', until) + INTERVAL 3 MONTH
 ELSE date_trunc('quarter', until) END AS last, greatest(since, DATE '2006-01-01') AS start FROM (SELECT row_id, since + 3650 AS since, until + 3650 AS until FROM ({_RANGES})) WHERE until >= DATE '2006-01-01'"""
_ASKED = """SELECT CASE s_suppkey % 2 WHEN 0 THEN 'us' ELSE 'eu' END AS domain, CAST(s_suppkey AS VARCHAR) AS identifier, 'x' AS source, s_suppkey,
 DATE '1998-03-01' + CAST(s_suppkey % 30 AS INT) AS start, DATE '1998-05-01' + CAST(s_suppkey % 40 AS INT) AS "end" FROM supplier"""


def _open_days(until: str, more: str) -> str:
    """Days of requests that no interval covers (or that ``more`` adds), as intervals."""
    return f"""SELECT domain, identifier, source{more and ''}, CAST(min(d) AS DATE) AS first, CAST(max(d) AS DATE) AS last FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY identifier ORDER BY d) AS INT) AS g FROM (
 SELECT a.domain, a.identifier, a.source, CAST(t.d AS DATE) AS d FROM a, LATERAL (SELECT unnest(generate_series(a.start, a."end", INTERVAL 1 DAY)) AS d) t
 WHERE ({until} AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.identifier = a.identifier AND CAST(t.d AS DATE) BETWEEN cov.first AND cov.last)) {more})) GROUP BY domain, identifier, source, g"""


SQL = {
    "german_date": _told(["DATE '2024-03-05'"] * 3 + ["NULL", "NULL"], "day"),
    "french_date": _told(["DATE '2024-03-05'", "DATE '2023-08-12'", "DATE '2024-03-05'", "NULL", "NULL"], "day"),
    "uk_date": _told(["DATE '2026-03-06'"] * 5 + ["NULL"], "day"),
    "dutch_date": _told(["DATE '2024-03-05'"] * 3 + ["NULL"], "day"),
    **{name: _told(results, "kind") for name, (_, _, results) in KINDS.items()},
    "french_price": f"SELECT o_orderkey AS row_id, {_cases(['12.5', '1234.5', '3.0', 'NULL'])}::DOUBLE AS price, {_cases([repr(x) for x in ('EUR', 'USD', 'GBP', 'EUR')])} AS currency FROM orders",
    "uk_price_volume": f"SELECT o_orderkey AS row_id, {_cases(['0.065', '1.5', 'NULL', '1020000.5'])}::DOUBLE AS price, {_cases(['12345', 'NULL', 'NULL', 'NULL'])}::DOUBLE AS volume, {_cases([repr(x) for x in ('EUR', 'GBP', '', 'USD')])} AS currency FROM orders",
    "decimal_text": _told(["'10.5'", "'10.5'", "'100'", "'0'", "'100'", "'none'"], "shown"),
    "relationship_roles": "SELECT o_orderkey AS row_id, " + ", ".join(f"{_cases(v)} AS {n}" for n, v in {
        "is_director": ["true", "false", "false", "true", "false"], "is_officer": ["true", "false", "false", "false", "false"], "is_ten_percent_owner": ["false", "true", "false", "false", "true"],
        "is_other": ["false", "false", "false", "false", "true"], "error": ["NULL", "NULL", "'no known role'", "'unknown role'", "NULL"]}.items()) + " FROM orders",
    "insider_title": """SELECT o_orderkey AS row_id, concat_ws(', ', CASE WHEN o_orderkey % 2 = 0 THEN 'CFO' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Director' END,
 CASE WHEN o_orderkey % 5 != 0 AND o_orderkey % 2 != 0 THEN 'Officer' END, CASE WHEN o_orderkey % 7 = 0 THEN '10% Owner' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Other' END) AS title FROM orders""",
    "derived_value": """SELECT CASE WHEN l_linenumber = 2 THEN 'value is not finite' END AS error, count(*) AS n,
 sum(CASE WHEN l_linenumber != 2 THEN CAST(l_quantity * 2 AS DECIMAL(20,2)) END) AS value FROM lineitem GROUP BY 1""",
    "owner_ciks": """SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN array_to_string(list_sort(list_distinct([lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '0000000007'])), ',')
 WHEN 1 THEN '' ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS owners FROM orders""",
    "row_provenance": "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b,c' ELSE 'c' END AS provenance FROM orders",
    "index_years": f"SELECT row_id, array_to_string(range(year(since), year(until) + 1), ',') AS years FROM ({_RANGES})",
    "required_quarters": f"""SELECT row_id, CAST(datediff('quarter', start, last) + 1 AS INT) AS quarters, CAST(last AS DATE) AS last FROM ({_QUARTERS}) WHERE start <= last""",
    "daily_index_path": f"SELECT row_id, 'edgar/daily-index/' || year(since) || '/QTR' || quarter(since) || '/master.' || strftime(since, '%Y%m%d') || '.idx' AS path FROM ({_RANGES})",
    "quarter_gaps": f"""SELECT DISTINCT CAST(q AS DATE) AS quarter FROM (SELECT unnest(generate_series(date_trunc('quarter', start), last, INTERVAL 3 MONTH)) AS q FROM ({_QUARTERS}))
 WHERE CAST(q AS DATE) NOT IN (SELECT CAST(date_trunc('quarter', CAST(o_orderdate AS DATE) + 3650) AS DATE) FROM orders WHERE month(o_orderdate) < 7)""",
    "scan_days": "SELECT t AS ticker, CAST(d AS DATE) AS day FROM (SELECT unnest(['ABC', 'DEF']) AS t), range(DATE '2024-02-27', DATE '2024-03-03', INTERVAL 1 DAY) x(d)",
    "describe_incomplete": """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Incomplete results (' || (['x 1: missing table', 'x 1: missing table; x 2: missing table',
 'x 1: missing table; x 2: missing table; x 3: missing table', 'x 1: missing table; x 2: missing table; x 3: missing table; 1 more issue',
 'x 1: missing table; x 2: missing table; x 3: missing table; 2 more issues'])[o_orderkey % 5 + 1] || ')' END AS text FROM orders""",
    "archive_progress": """SELECT CAST(o_custkey % 10 AS VARCHAR) AS archive_id, greatest(100, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey >= 100 OR o_orderkey % 7 = 0) + 1, 0)) AS next_member,
 count(DISTINCT o_orderkey) FILTER (WHERE (o_orderkey >= 100 OR o_orderkey % 7 = 0) AND o_orderkey % 3 = 0) AS retries FROM orders GROUP BY 1""",
    "coverage_add": f"""WITH cov AS (SELECT domain, identifier AS key, first, CASE WHEN domain = 'us' AND covered_at % 2 = 1 THEN least(last, DATE '1998-05-31') ELSE last END AS last, covered_at FROM ({_SCANNED})
 WHERE NOT (domain = 'us' AND covered_at % 2 = 1 AND first > DATE '1998-05-31')),
 marked AS (SELECT *, sum(fresh) OVER (PARTITION BY domain, key ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY domain, key
 ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM cov)), islands AS (SELECT domain, key, island, min(first) AS first, max(last) AS last,
 min(covered_at) AS covered_at FROM marked GROUP BY domain, key, island) SELECT domain, count(*) AS n, min(first) AS first, max(last) AS last, sum(covered_at)::BIGINT AS oldest FROM islands GROUP BY domain""",
    "scan_gaps": f"WITH cov AS ({_SCANNED}), a AS ({_ASKED}) " + _open_days("CAST(t.d AS DATE) < DATE '1998-05-26'", "OR (CAST(t.d AS DATE) >= DATE '1998-05-26' AND a.s_suppkey % 48 >= 24)"),
    "uncovered": f"WITH cov AS ({_SCANNED}), a AS ({_ASKED}) SELECT o.domain, o.identifier, o.source, a.start, a.\"end\", o.first, o.last FROM (" + _open_days("true", "") + ") o JOIN a USING (domain, identifier, source)",
    "alerts_evaluate": sql("""SELECT rule, count(*) OVER (PARTITION BY rule) AS matches, market, row_id, sequence FROM hits QUALIFY row_number() OVER (PARTITION BY rule ORDER BY sequence) <= 100""",
        """seq AS (SELECT *, row_number() OVER (ORDER BY trade_date, row_id) AS sequence FROM congress), hits AS (SELECT 'large' AS rule, 'Congress' AS market, row_id, sequence FROM seq WHERE amount_low >= 100001 AND sequence > 500
 UNION ALL SELECT 'sales', 'Congress', row_id, sequence FROM seq WHERE trade_type = 'Sale' UNION ALL SELECT 'watched', 'Congress', row_id, sequence FROM seq WHERE ticker = 'T7' OR lower(official_name) = 'customer#000000003')"""),
    "investigation": sql("""SELECT 'anchor' AS section, market, row_id, person, identifier FROM feed WHERE market = 'Congress' AND row_id = 7
 UNION ALL (SELECT 'person', market, row_id, person, identifier FROM feed WHERE lower(person) = (SELECT lower(official_name) FROM congress WHERE row_id = 7) AND NOT (market = 'Congress' AND row_id = 7)
 ORDER BY transaction_date DESC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 8)
 UNION ALL (SELECT 'issuer', market, row_id, person, identifier FROM feed WHERE identifier = (SELECT ticker FROM congress WHERE row_id = 7) AND NOT (market = 'Congress' AND row_id = 7)
 ORDER BY transaction_date DESC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 8)"""),
    "member_committees": """SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id, n[c_custkey % 6 + 1] || ';' || n[(c_custkey + 3) % 6 + 1] AS committees,
 array_to_string(list_filter(['Defense', 'Energy', 'Finance', 'Technology', 'Healthcare'], lambda x: x IN (t[c_custkey % 6 + 1], t[(c_custkey + 3) % 6 + 1])), ';') AS sectors FROM customer,
 (SELECT ['Armed Services', 'Energy', 'Banking', 'Science', 'Health', 'Rules'] AS n, ['Defense', 'Energy', 'Finance', 'Technology', 'Healthcare', 'Other'] AS t)""",
    "merged_order": sql("SELECT row_id, CASE WHEN batch % 7 = 0 THEN NULL ELSE trade_date END AS trade_date FROM us ORDER BY 2 DESC NULLS LAST, row_id LIMIT 100"),
}
