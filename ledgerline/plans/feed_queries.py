"""Registered feed, list and search queries with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerline.functions.text import fold
from ledgerline.operators import feed as feeds
from ledgerline.operators import trades
from ledgerline.operators.feed import Cursor, FeedCriteria
from ledgerline.plans import bridge as b
from ledgerline.plans.bridge import sql

FROM, TO = date(1997, 1, 1), date(1998, 6, 30)
ORDER = "transaction_date DESC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id"
_SLIM = ("market", "row_id", "transaction_date", "filing_date", "trade_type", "identifier", "person", "value")
SLIM = ", ".join(_SLIM)
CURSOR = Cursor(date(1998, 1, 5), date(1998, 1, 7), 0, 500, {"US": 10**15, "Congress": 10**6, "Europe": 10**15})
SEARCH = " OR ".join(f"contains(lower({c}), '0000000{{n}}')" for c in feeds.SEARCHED)



def _numbered(s, d):
    """US rows whose value is their order's number: rows of one number are the same."""
    return b.us_trades(s, d).select("row_id", "batch", F.col("batch").cast("double").alias("value"))


def _us_query(s, d):
    from ledgerline.plans.domain_queries import near_copies

    rows = near_copies(s, d)
    asked = trades.filter_us(rows, ticker="brand11")
    return trades.query_us(rows, trades.duplicate_links(asked), ticker="brand11", since=FROM, until=TO).select("row_id", "source")


QUERIES = {
    "feed_page": lambda s, d: feeds.page(b.feed(s, d)).select(*_SLIM),
    "feed_projection": lambda s, d: b.feed(s, d),
    "feed_detail": lambda s, d: feeds.detail(b.feed(s, d), "congress:7").select(*_SLIM, "display_value"),
    "feed_by_market": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(markets=("Europe",))).select(*_SLIM),
    "feed_by_direction": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(directions=("Buy", "Other"))).select(*_SLIM),
    "feed_date_range": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(date_from=FROM, date_to=TO)).select(*_SLIM),
    "feed_value_range": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(value_min=1000, value_max=30000)).select(*_SLIM),
    "feed_search": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(search="SUPPLIER#00")).select(*_SLIM),
    "feed_count": lambda s, d: feeds.apply_criteria(b.feed(s, d), FeedCriteria(date_from=FROM)).groupBy("market").agg(F.count(F.lit(1)).alias("n")),
    "feed_snapshot": lambda s, d: feeds.snapshot(b.feed(s, d)),
    "feed_offset": lambda s, d: feeds.page(b.feed(s, d), limit=50, offset=100).select(*_SLIM),
    "feed_cursor": lambda s, d: feeds.page(b.feed(s, d), cursor=CURSOR).select(*_SLIM),
    "feed_sort_issuer": lambda s, d: feeds.page(b.feed(s, d), FeedCriteria(sort_field="issuer", descending=False), 100).select(*_SLIM),
    "feed_sort_person": lambda s, d: feeds.page(b.feed(s, d), FeedCriteria(sort_field="person"), 100).select(*_SLIM),
    "feed_sort_value": lambda s, d: feeds.page(b.feed(s, d), FeedCriteria(sort_field="value"), 100).select(*_SLIM),
    "feed_sort_market": lambda s, d: feeds.page(b.feed(s, d), FeedCriteria(sort_field="market", descending=False), 100).select(*_SLIM),
    "feed_freshness": lambda s, d: trades.freshness(b.table(s, d, "events"), "event_type", "ts", "2024-01-30 12:00:00"),
    "recent_by_person": lambda s, d: feeds.recent(b.feed(s, d), "person", " supplier#000000003 ", 8).select(*_SLIM),
    "recent_by_issuer": lambda s, d: feeds.recent(b.feed(s, d), "identifier", "brand11", 8).select(*_SLIM),
    "search_companies": lambda s, d: feeds.search_companies(b.feed(s, d), "an"),
    "search_people": lambda s, d: feeds.search_people(b.feed(s, d), "customer#00"),
    "entity_summary": lambda s, d: feeds.entity_summary(b.feed(s, d), "identifier"),
    "us_filter": lambda s, d: trades.filter_us(b.us_trades(s, d), ticker="brand11", trade_type="Buy", min_value=20000, since=FROM, until=TO).select("row_id", "ticker", "value", "filing_date"),
    "eu_filter": lambda s, d: trades.filter_eu(b.eu_trades(s, d), country="DE", trade_type="All", min_value=1000, since=FROM, until=TO).select("row_id", "isin", "total_value", "trade_date"),
    "us_latest": lambda s, d: trades.latest(b.us_trades(s, d), ("filing_date", "trade_date"), 100).select("row_id", "filing_date", "trade_date"),
    "eu_latest": lambda s, d: trades.latest(b.eu_trades(s, d), ("trade_date", "filing_date"), 100).select("row_id", "filing_date", "trade_date"),
    "us_by_provenance": lambda s, d: trades.by_provenance(b.us_trades(s, d).withColumn("provenance", F.when(F.col("batch") % 2 == 0, F.array("source", F.lit("openinsider")))), ["openinsider"]).select("row_id", "source"),
    "us_query": lambda s, d: _us_query(s, d),
    "us_query_raw": lambda s, d: trades.query_us(b.us_trades(s, d), None, ticker="brand11", since=FROM, until=TO).select("row_id", "source"),
    "congress_query": lambda s, d: trades.query_congress(b.congress_trades(s, d), official="000000007, Customer", chamber="House").select("row_id", "official_name"),
    "congress_scan_order": lambda s, d: trades.congress_scan_order(b.congress_trades(s, d), 100).select("row_id", "filing_date", "trade_date", "official_name"),
    "eu_query": lambda s, d: trades.query_eu(b.eu_trades(s, d).withColumn("provenance", F.when(F.col("volume") > 20, F.array(F.lit("bafin")))), isin="fr0000000042", country="FR", since=date(1995, 1, 1), until=date(2001, 12, 31), sources=["bafin"]).select("row_id", "isin"),
    "eu_scan_order": lambda s, d: trades.eu_scan_order(b.eu_trades(s, d), 100).select("row_id", "trade_date", "filing_date", "source"),
    "eu_multi_source": lambda s, d: trades.last_wins(b.eu_trades(s, d), ["isin", "insider_name", "trade_type"], ["arrival", "row_id"]).select("isin", "insider_name", "trade_type", "row_id"),
    "eu_verify_isin": lambda s, d: trades.verify_isin(b.eu_trades(s, d), " de0000000042 ").select("row_id", "isin"),
    "overlay_trades": lambda s, d: trades.overlay(b.us_trades(s, d), b.congress_trades(s, d), ["BRAND11", "T7"], FROM, TO),
    "watch_symbols": lambda s, d: trades.ordered_distinct(b.us_trades(s, d), fold(F.col("ticker")), "row_id"),
    "house_search": lambda s, d: trades.search_house(b.congress_trades(s, d).withColumn("filing_type", F.when(F.col("is_amendment"), "A").otherwise("P")), name="00001", kind="P", since=FROM, until=TO).select("row_id", "official_name", "filing_date"),
    "reject_rows": lambda s, d: trades.reject_rows(b.us_trades(s, d).withColumns({"shares": F.when(F.col("batch") % 10 == 0, -F.col("shares")).otherwise(F.col("shares")), "trade_type": F.when(F.col("batch") % 10 == 1, "Gift").otherwise(F.col("trade_type")), "ticker": F.when(F.col("batch") % 10 == 2, None).otherwise(F.col("ticker"))})).groupBy("error").agg(F.count(F.lit(1)).alias("n")),
    "upsert_counts": lambda s, d: trades.upsert_outcomes(_numbered(s, d).filter("batch % 2 = 0").dropDuplicates(["row_id"]), _numbered(s, d).withColumn("value", F.when(F.col("batch") % 4 == 0, F.col("value") + 1).otherwise(F.col("value"))), "row_id", ["value"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
}

_AFTER = """(transaction_date IS NULL OR transaction_date < DATE '1998-01-05' OR (transaction_date = DATE '1998-01-05' AND
 (filing_date IS NULL OR filing_date < DATE '1998-01-07' OR (filing_date = DATE '1998-01-07' AND (market_rank > 0 OR row_id > 500)))))
 AND CASE market WHEN 'US' THEN row_id <= 1000000000000000 WHEN 'Congress' THEN row_id <= 1000000 ELSE row_id <= 1000000000000000 END"""
_RANGE = "BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"
_WAY = "CASE WHEN lower(trim(trade_type)) IN ('buy', 'purchase', 'exercise') THEN 'Buy' WHEN lower(trim(trade_type)) IN ('sell', 'sale') THEN 'Sell' ELSE 'Other' END"
_ANY = " OR ".join(f"contains(lower({c}), 'supplier#00')" for c in feeds.SEARCHED)

SQL = {
    "feed_page": sql(f"SELECT {SLIM} FROM feed ORDER BY {ORDER} LIMIT 200"),
    "feed_projection": sql("SELECT * FROM feed"),
    "feed_detail": sql(f"SELECT {SLIM}, display_value FROM feed WHERE market = 'Congress' AND row_id = 7"),
    "feed_by_market": sql(f"SELECT {SLIM} FROM feed WHERE market = 'Europe'"),
    "feed_by_direction": sql(f"SELECT {SLIM} FROM feed WHERE {_WAY} IN ('Buy', 'Other')"),
    "feed_date_range": sql(f"SELECT {SLIM} FROM feed WHERE transaction_date {_RANGE}"),
    "feed_value_range": sql(f"SELECT {SLIM} FROM feed WHERE sort_value BETWEEN 1000 AND 30000"),
    "feed_search": sql(f"SELECT {SLIM} FROM feed WHERE {_ANY}"),
    "feed_count": sql("SELECT market, count(*) AS n FROM feed WHERE transaction_date >= DATE '1997-01-01' GROUP BY market"),
    "feed_snapshot": sql("SELECT market, max(row_id) AS last_row FROM feed GROUP BY market"),
    "feed_offset": sql(f"SELECT {SLIM} FROM feed ORDER BY {ORDER} LIMIT 50 OFFSET 100"),
    "feed_cursor": sql(f"SELECT {SLIM} FROM feed WHERE {_AFTER} ORDER BY {ORDER} LIMIT 200"),
    "feed_sort_issuer": sql(f"SELECT {SLIM} FROM feed ORDER BY lower(issuer) ASC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 100"),
    "feed_sort_person": sql(f"SELECT {SLIM} FROM feed ORDER BY lower(person) DESC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 100"),
    "feed_sort_value": sql(f"SELECT {SLIM} FROM feed ORDER BY sort_value DESC NULLS LAST, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 100"),
    "feed_sort_market": sql(f"SELECT {SLIM} FROM feed ORDER BY market ASC, filing_date DESC NULLS LAST, market_rank, row_id LIMIT 100"),
    "feed_freshness": """SELECT event_type AS domain, max(ts) AS refreshed_at,
 max(ts) > TIMESTAMP '2024-01-30 12:00:00' OR max(ts) < TIMESTAMP '2024-01-29 12:00:00' AS stale FROM events GROUP BY event_type""",
    "recent_by_person": sql(f"SELECT {SLIM} FROM feed WHERE lower(trim(person)) = 'supplier#000000003' ORDER BY {ORDER} LIMIT 8"),
    "recent_by_issuer": sql(f"SELECT {SLIM} FROM feed WHERE upper(trim(identifier)) = 'BRAND11' ORDER BY {ORDER} LIMIT 8"),
    "search_companies": sql("""SELECT issuer, identifier, market FROM (SELECT DISTINCT issuer, identifier, market, market_rank FROM feed
 WHERE identifier != '' AND (contains(lower(issuer), 'an') OR contains(lower(identifier), 'an')))
 ORDER BY lower(issuer), lower(identifier), market_rank, issuer, identifier LIMIT 8"""),
    "search_people": sql("""SELECT person, market FROM (SELECT DISTINCT person, market, market_rank FROM feed WHERE contains(lower(person), 'customer#00'))
 ORDER BY lower(person), market_rank, person LIMIT 8"""),
    "entity_summary": sql(f"""SELECT identifier, count(*) AS trades, count(*) FILTER (WHERE {_WAY} = 'Buy') AS buys, count(*) FILTER (WHERE {_WAY} = 'Sell') AS sells,
 max(coalesce(transaction_date, filing_date)) AS latest FROM feed GROUP BY identifier"""),
    "us_filter": sql(f"SELECT row_id, ticker, value, filing_date FROM us WHERE ticker = 'BRAND11' AND trade_type = 'Buy' AND NOT value_missing AND abs(value) >= 20000 AND filing_date {_RANGE}"),
    "eu_filter": sql(f"SELECT row_id, isin, total_value, trade_date FROM eu WHERE country = 'DE' AND coalesce(total_value, 0) >= 1000 AND trade_date {_RANGE}"),
    "us_latest": sql("SELECT row_id, filing_date, trade_date FROM us ORDER BY filing_date DESC NULLS LAST, trade_date DESC NULLS LAST, row_id LIMIT 100"),
    "eu_latest": sql("SELECT row_id, filing_date, trade_date FROM eu ORDER BY trade_date DESC NULLS LAST, filing_date DESC NULLS LAST, row_id LIMIT 100"),
    "us_by_provenance": sql("SELECT row_id, source FROM us WHERE source = 'openinsider' OR batch % 2 = 0"),
    "us_query": sql(f"""SELECT row_id, source FROM copies WHERE ticker = 'BRAND11' AND filing_date {_RANGE}
 AND NOT EXISTS (SELECT 1 FROM links WHERE links.row_id = copies.row_id)""", "__COPIES__, links AS (SELECT row_id FROM (__LINKS__))"),
    "us_query_raw": sql(f"SELECT row_id, source FROM us WHERE ticker = 'BRAND11' AND filing_date {_RANGE}"),
    "congress_query": sql("SELECT row_id, official_name FROM congress WHERE lower(official_name) = 'customer#000000007' AND chamber = 'House'"),
    "congress_scan_order": sql("SELECT row_id, filing_date, trade_date, official_name FROM congress ORDER BY filing_date DESC NULLS LAST, trade_date DESC NULLS LAST, official_name, row_id LIMIT 100"),
    "eu_query": sql(f"SELECT row_id, isin FROM eu WHERE isin = 'FR0000000042' AND country = 'FR' AND trade_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND volume > 20"),
    "eu_scan_order": sql("SELECT row_id, trade_date, filing_date, source FROM eu ORDER BY trade_date DESC NULLS LAST, filing_date DESC NULLS LAST, source DESC, row_id LIMIT 100"),
    "eu_multi_source": sql("""SELECT isin, insider_name, trade_type, row_id FROM (SELECT *, row_number() OVER (PARTITION BY isin, insider_name, trade_type
 ORDER BY arrival DESC, row_id DESC) AS k FROM eu) WHERE k = 1"""),
    "eu_verify_isin": sql("SELECT row_id, isin FROM eu WHERE isin = 'DE0000000042'"),
    "overlay_trades": sql(f"""SELECT 'US' AS market, row_id, ticker, trade_date, trade_type FROM us WHERE ticker IN ('BRAND11', 'T7') AND trade_date {_RANGE}
 UNION ALL SELECT 'Congress', row_id, ticker, trade_date, trade_type FROM congress WHERE ticker IN ('BRAND11', 'T7') AND trade_date {_RANGE}"""),
    "watch_symbols": sql("SELECT key, row_number() OVER (ORDER BY first) AS position FROM (SELECT lower(ticker) AS key, min(row_id) AS first FROM us GROUP BY 1)"),
    "house_search": sql(f"SELECT row_id, official_name, filing_date FROM congress WHERE chamber = 'House' AND contains(lower(official_name), '00001') AND NOT is_amendment AND (filing_date IS NULL OR filing_date {_RANGE})"),
    "reject_rows": sql("SELECT CASE batch % 10 WHEN 0 THEN 'shares is negative or not a number' WHEN 1 THEN 'trade_type is not known' WHEN 2 THEN 'ticker is missing' END AS error, count(*) AS n FROM us GROUP BY 1"),
    "upsert_counts": sql("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN batch % 2 != 0 THEN 'inserted' WHEN batch % 4 = 0 THEN 'updated' ELSE 'skipped' END AS outcome
 FROM us) GROUP BY outcome"""),
}
