"""Disclosure tables as views over the driver's relational tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.feed import feed_union


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def us_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.selectExpr(
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id",
        "upper(replace(p_brand, '#', '')) AS ticker", "p_name AS company", "s_name AS insider_name",
        "CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' ELSE CASE l_linestatus WHEN 'F' THEN 'Exercise' ELSE 'Other' END END AS trade_type",
        "cast(l_shipdate AS date) AS trade_date",
        "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE date_add(cast(l_shipdate AS date), l_linenumber) END AS filing_date",
        "l_quantity AS shares", "l_extendedprice AS value",
        "CASE l_linenumber % 3 WHEN 0 THEN 'sec_edgar' WHEN 1 THEN 'openinsider' ELSE 'secform4' END AS source",
        "l_tax = 0 AS value_missing", "l_discount = 0 AS shares_missing",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_orderkey AS string) ELSE '' END AS accession_number",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_linenumber AS string) ELSE '' END AS sec_row_id",
        "l_linenumber % 6 = 0 AS is_amendment", "l_partkey % 97 AS cik", "l_orderkey AS batch", "l_partkey % 40 = 0 AS is_derivative",
        "l_quantity * 2 AS price", "l_partkey % 50 = 0 AS price_missing",
        "CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE CASE l_linestatus WHEN 'F' THEN 'M' ELSE 'G' END END AS transaction_code",
    )


def congress_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).selectExpr(
        "o_orderkey AS row_id", "c_name AS official_name", "c_custkey", "c_mktsegment AS segment",
        "CASE o_orderstatus WHEN 'F' THEN 'House' ELSE 'Senate' END AS chamber",
        "CASE o_orderstatus WHEN 'F' THEN 'house' ELSE 'senate' END AS source",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Purchase' WHEN '2' THEN 'Sale' WHEN '3' THEN 'Exchange' ELSE 'Other' END AS trade_type",
        "cast(o_orderdate AS date) AS trade_date",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE date_add(cast(o_orderdate AS date), 45) END AS filing_date",
        "concat('T', cast(o_custkey % 50 AS string)) AS ticker",
        "cast(o_orderkey AS string) AS doc_id",
        "CASE WHEN o_totalprice < 15000 THEN 1001D WHEN o_totalprice < 50000 THEN 15001D WHEN o_totalprice < 100000 THEN 50001D ELSE 100001D END AS amount_low",
        "CASE WHEN o_totalprice < 15000 THEN 15000D WHEN o_totalprice < 50000 THEN 50000D WHEN o_totalprice < 100000 THEN 100000D ELSE 250000D END AS amount_high",
        "CASE WHEN o_totalprice < 15000 THEN '$1,001 - $15,000' WHEN o_totalprice < 50000 THEN '$15,001 - $50,000' WHEN o_totalprice < 100000 THEN '$50,001 - $100,000' ELSE '$100,001 - $250,000' END AS amount_range",
        "o_orderkey % 5 = 0 AS is_amendment", "o_orderkey % 17 != 0 AS filing_complete",
    )


def eu_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return joined.selectExpr(
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id",
        "concat(CASE n_nationkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'NL' END, lpad(cast(l_partkey AS string), 10, '0')) AS isin",
        "n_name AS issuer_name", "CASE n_nationkey % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'NL' END AS country",
        "CASE n_nationkey % 4 WHEN 0 THEN 'rns' WHEN 1 THEN 'bafin' WHEN 2 THEN 'amf' ELSE 'afm' END AS source",
        "s_name AS insider_name", "CASE WHEN l_linenumber % 2 = 0 THEN 'Director' ELSE '' END AS position",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_shipdate AS date) END AS trade_date",
        "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE date_add(cast(l_shipdate AS date), 2) END AS filing_date",
        "CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' ELSE 'Other' END AS trade_type",
        "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS volume", "l_extendedprice AS price",
        "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity * l_extendedprice END AS total_value",
        "CASE n_nationkey % 4 WHEN 0 THEN 'GBP' ELSE 'EUR' END AS currency", "n_nationkey % 4 AS arrival",
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_union(us_trades(spark, sf_dir), congress_trades(spark, sf_dir), eu_trades(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: lowest and highest price, and those of the first and last row of the day."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).selectExpr(
        "upper(replace(p_brand, '#', '')) AS symbol", "cast(l_shipdate AS date) AS price_date", "l_extendedprice AS x",
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS k",
    )
    return rows.groupBy("symbol", "price_date").agg(
        F.min_by("x", "k").alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by("x", "k").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


# The same views for the oracle.
US = """SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id,
 upper(replace(p_brand, '#', '')) AS ticker, p_name AS company, s_name AS insider_name,
 CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' ELSE CASE l_linestatus WHEN 'F' THEN 'Exercise' ELSE 'Other' END END AS trade_type,
 CAST(l_shipdate AS DATE) AS trade_date,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + l_linenumber END AS filing_date,
 l_quantity AS shares, l_extendedprice AS value,
 CASE l_linenumber % 3 WHEN 0 THEN 'sec_edgar' WHEN 1 THEN 'openinsider' ELSE 'secform4' END AS source,
 l_tax = 0 AS value_missing, l_discount = 0 AS shares_missing,
 CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS accession_number,
 CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS sec_row_id,
 l_linenumber % 6 = 0 AS is_amendment, l_partkey % 97 AS cik, l_orderkey AS batch, l_partkey % 40 = 0 AS is_derivative,
 l_quantity * 2 AS price, l_partkey % 50 = 0 AS price_missing,
 CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE CASE l_linestatus WHEN 'F' THEN 'M' ELSE 'G' END END AS transaction_code
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
CONGRESS = """SELECT o_orderkey AS row_id, c_name AS official_name, c_custkey, c_mktsegment AS segment,
 CASE o_orderstatus WHEN 'F' THEN 'House' ELSE 'Senate' END AS chamber,
 CASE o_orderstatus WHEN 'F' THEN 'house' ELSE 'senate' END AS source,
 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Purchase' WHEN '2' THEN 'Sale' WHEN '3' THEN 'Exchange' ELSE 'Other' END AS trade_type,
 CAST(o_orderdate AS DATE) AS trade_date,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 45 END AS filing_date,
 'T' || CAST(o_custkey % 50 AS VARCHAR) AS ticker, CAST(o_orderkey AS VARCHAR) AS doc_id,
 CASE WHEN o_totalprice < 15000 THEN 1001 WHEN o_totalprice < 50000 THEN 15001 WHEN o_totalprice < 100000 THEN 50001 ELSE 100001 END::DOUBLE AS amount_low,
 CASE WHEN o_totalprice < 15000 THEN 15000 WHEN o_totalprice < 50000 THEN 50000 WHEN o_totalprice < 100000 THEN 100000 ELSE 250000 END::DOUBLE AS amount_high,
 CASE WHEN o_totalprice < 15000 THEN '$1,001 - $15,000' WHEN o_totalprice < 50000 THEN '$15,001 - $50,000' WHEN o_totalprice < 100000 THEN '$50,001 - $100,000' ELSE '$100,001 - $250,000' END AS amount_range,
 o_orderkey % 5 = 0 AS is_amendment, o_orderkey % 17 != 0 AS filing_complete
 FROM orders JOIN customer ON o_custkey = c_custkey"""
EU = """SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id,
 CASE n_nationkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'NL' END || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS isin,
 n_name AS issuer_name, CASE n_nationkey % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'NL' END AS country,
 CASE n_nationkey % 4 WHEN 0 THEN 'rns' WHEN 1 THEN 'bafin' WHEN 2 THEN 'amf' ELSE 'afm' END AS source,
 s_name AS insider_name, CASE WHEN l_linenumber % 2 = 0 THEN 'Director' ELSE '' END AS position,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS trade_date,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + 2 END AS filing_date,
 CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN 'A' THEN 'Buy' ELSE 'Other' END AS trade_type,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS volume, l_extendedprice AS price,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity * l_extendedprice END AS total_value,
 CASE n_nationkey % 4 WHEN 0 THEN 'GBP' ELSE 'EUR' END AS currency, n_nationkey % 4 AS arrival
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
FEED = """SELECT 'US' AS market, 0 AS market_rank, row_id, trade_date AS transaction_date, filing_date, trade_type, company AS issuer,
 ticker AS identifier, insider_name AS person, '' AS role, CASE WHEN shares_missing THEN NULL ELSE shares END AS quantity,
 CAST(NULL AS DOUBLE) AS price, CASE WHEN value_missing THEN NULL ELSE value END AS value, '' AS display_value, 'USD' AS currency,
 source, '' AS url, CASE WHEN value_missing THEN NULL ELSE value END AS sort_value FROM us
UNION ALL SELECT 'Congress', 1, row_id, trade_date, filing_date, trade_type, '', ticker, official_name, chamber, NULL, NULL, NULL,
 amount_range, 'USD', source, '', amount_low FROM congress
UNION ALL SELECT 'Europe', 2, row_id, trade_date, filing_date, trade_type, issuer_name, isin, insider_name, position, volume, price,
 total_value, '', currency, source, '', total_value FROM eu"""
PRICES = """SELECT symbol, price_date, min_by(x, k) AS open, max(x) AS high, min(x) AS low, max_by(x, k) AS close, count(*) AS volume
 FROM (SELECT upper(replace(p_brand, '#', '')) AS symbol, CAST(l_shipdate AS DATE) AS price_date, l_extendedprice AS x,
 ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
 GROUP BY symbol, price_date"""


def sql(body: str, extra: str = "") -> str:
    """A query over the views us, congress, eu, feed and prices."""
    more = f", {extra}" if extra else ""
    return f"WITH us AS ({US}), congress AS ({CONGRESS}), eu AS ({EU}), feed AS ({FEED}), prices AS ({PRICES}){more} {body}"
