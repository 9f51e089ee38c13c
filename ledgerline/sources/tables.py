"""Readers of prices, directories, registers, HTML tables and legacy exports, and the sinks."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import classify_trade, export_label, parse_date, parse_number, strip
from ledgerline.operators.timeline import valid_bar
from ledgerline.operators.trades import reject_rows


def read_columnar_prices(spark: SparkSession, path: str) -> DataFrame:
    """Bars from charts with parallel arrays; days are those of the exchange's time zone, bars with a null are dropped."""
    quote = "open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, close: ARRAY<DOUBLE>, volume: ARRAY<BIGINT>"
    kind = (
        "chart STRUCT<result: ARRAY<STRUCT<meta: STRUCT<symbol: STRING, exchangeTimezoneName: STRING>, timestamp: ARRAY<BIGINT>,"
        f" indicators: STRUCT<quote: ARRAY<STRUCT<{quote}>>, adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>>>>"
    )
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", kind)["chart"]["result"][0].alias("r"))
    q = F.col("r.indicators.quote")[0]
    bars = F.arrays_zip(
        F.col("r.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"),
        q["volume"].alias("volume"), F.coalesce(F.get("r.indicators.adjclose", F.lit(0))["adjclose"], F.array().cast("array<double>")).alias("adjusted_close"),
    )
    rows = one.select(F.col("r.meta.symbol").alias("symbol"), F.col("r.meta.exchangeTimezoneName").alias("zone"), F.explode(bars).alias("b"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.t"), F.coalesce("zone", F.lit("UTC"))))
    names = ("open", "high", "low", "close", "adjusted_close", "volume")
    return rows.select("symbol", day.alias("price_date"), *(F.col(f"b.{n}").alias(n) for n in names)).filter(valid_bar())


def read_row_prices(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from a list of objects."""
    kind = "ARRAY<STRUCT<date: STRING, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: BIGINT, adjClose: DOUBLE>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("b"))
    return rows.select(
        F.lit(symbol).alias("symbol"), parse_date(F.col("b.date")).alias("price_date"), "b.open", "b.high", "b.low", "b.close",
        F.col("b.adjClose").alias("adjusted_close"), "b.volume",
    ).filter(valid_bar())


def read_ticker_directory(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) from an object of entries; of a ticker the last entry counts."""
    entry = F.from_json("value", "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING, title: STRING>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(entry)).alias("e")).select(
        F.col("e.key").cast("long").alias("n"), F.upper(F.trim("e.value.ticker")).alias("ticker"), F.lpad("e.value.cik_str", 10, "0").alias("cik"), "e.value.title"
    )
    good = rows.filter(F.col("cik").rlike("^[0-9]{10}$") & (F.coalesce("ticker", F.lit("")) != ""))
    return good.groupBy("ticker").agg(F.max_by("cik", "n").alias("cik"), F.max_by("title", "n").alias("title"))


def cik_from_lookup(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``cik``: the first identifier a lookup page links to, ten digits, or null."""
    found = F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?i)[?&](?:amp;)?CIK=(\d{1,10})\b", 1)
    return pages.withColumn("cik", F.when(found != "", F.lpad(found, 10, "0")))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a text list, upper case; blank lines and comments are skipped."""
    text = strip(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(F.upper(text).alias("entry")).filter("entry != ''")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    kind = "first_name STRING, last_name STRING, official_name STRING, name STRING, bioguide_id STRING, openstates_id STRING, chamber STRING, sector ARRAY<STRING>, committees ARRAY<STRING>"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    return rows.filter("coalesce(official_name, name, last_name, '') != ''").withColumn(
        "member", F.coalesce(F.concat(F.lit("bioguide:"), F.upper("bioguide_id")), F.concat(F.lit("openstates:"), "openstates_id"), "official_name", "name")
    )


def read_register_csv(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> DataFrame:
    """A ``;``-separated register; each output column takes the first of its names that the file has."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    have = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
    return df.select(*(pick(names).alias(out) for out, names in columns.items()))


def read_legacy_json(spark: SparkSession, path: str) -> DataFrame:
    """(kind, record, error) of exported arrays; the kind follows from the keys of a record."""
    items = spark.read.text(path, wholetext=True).select(F.explode_outer(F.from_json("value", "ARRAY<STRING>")).alias("record"))
    keys = F.json_object_keys("record")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(has("official_name"), "congress").when(has("isin"), "european").when(has("ticker") & has("insider_name"), "us")
    return items.select(kind.alias("kind"), "record", F.when(keys.isNull(), "not a JSON object").when(kind.isNull(), "unknown record").alias("error"))


# Fields of exported records by kind, with their types.
LEGACY = {
    "us": "ticker STRING, company STRING, insider_name STRING, insider_title STRING, trade_type STRING, trade_date STRING, filing_date STRING, shares DOUBLE, price DOUBLE, value DOUBLE, source STRING, edgar_url STRING",
    "congress": "official_name STRING, chamber STRING, party STRING, filing_date STRING, doc_id STRING, trade_date STRING, asset_description STRING, ticker STRING, trade_type STRING, owner STRING, amount_range STRING, amount_low DOUBLE, amount_high DOUBLE, source STRING",
    "european": "isin STRING, issuer_name STRING, country STRING, insider_name STRING, position STRING, trade_date STRING, filing_date STRING, trade_type STRING, volume DOUBLE, price DOUBLE, currency STRING, total_value DOUBLE, source STRING",
}
LEGACY_MARKETS = {"us": "US", "congress": "Congress", "european": "Europe"}


def import_legacy(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> tuple[dict[str, DataFrame], DataFrame]:
    """(typed rows by kind, errors) of exported JSON below ``path``, also in folders.

    Errors are (file, record, error): files that are too large or no array,
    records of no kind, with a field of another type, an unreadable day, or a
    value its market does not allow.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    large = files.filter(F.col("length") > max_bytes).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("record"), F.lit("file is too large").alias("error"))
    texts = files.filter(F.col("length") <= max_bytes).select(F.col("path").alias("file"), F.col("content").cast("string").alias("value"))
    texts = texts.withColumn("items", F.from_json("value", "ARRAY<STRING>"))
    no_array = texts.filter("items IS NULL").select("file", F.lit(None).cast("string").alias("record"), F.lit("not a JSON array").alias("error"))
    items = texts.select("file", F.explode("items").alias("record"))
    keys = F.json_object_keys("record")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(has("official_name"), "congress").when(has("isin"), "european").when(has("ticker") & has("insider_name"), "us")
    items = items.withColumn("kind", kind)
    out, bad = {}, [large, no_array, items.filter("kind IS NULL").select("file", "record", F.when(F.json_object_keys("record").isNull(), "not a JSON object").otherwise("unknown record").alias("error"))]
    for name, schema in LEGACY.items():
        rows = items.filter(F.col("kind") == name).withColumn("x", F.from_json("record", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        fields = [f.split()[0] for f in schema.split(", ")]
        days = [c for c in fields if c.endswith("_date")]
        typed = rows.select("file", "record", F.col("x._corrupt").isNotNull().alias("corrupt"), *(F.col(f"x.{c}").alias(c) for c in fields))
        odd = None
        for c in days:
            test = (F.coalesce(F.trim(c), F.lit("")) != "") & parse_date(F.col(c)).isNull()
            odd = F.when(test, f"{c} is no day") if odd is None else odd.when(test, f"{c} is no day")
        typed = typed.withColumn("day_error", odd).withColumns({c: parse_date(F.col(c)) for c in days})
        judged = reject_rows(typed, LEGACY_MARKETS[name])
        judged = judged.withColumn("error", F.coalesce(F.when(F.col("corrupt"), "a field has another type"), "day_error", "error")).drop("corrupt", "day_error")
        out[name] = judged.filter("error IS NULL").drop("file", "record", "error")
        bad.append(judged.filter("error IS NOT NULL").select("file", "record", "error"))
    errors = bad[0]
    for more in bad[1:]:
        errors = errors.unionByName(more)
    return out, errors


class TableReader(HTMLParser):
    """Tables of a page as rows of cells; ``<br>`` splits a cell's text by a line feed, links keep their target."""

    def __init__(self, css: str = ""):
        super().__init__(convert_charrefs=True)
        self.css, self.depth, self.cell = css, 0, None
        self.rows: list[list[str]] = []
        self.links: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "table" and (self.depth or not self.css or self.css in a.get("class", "").split()):
            self.depth += 1
        if not self.depth:
            return
        if tag == "tr":
            self.rows.append([])
            self.links.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")
        elif tag == "a" and self.links:
            self.links[-1].append(a.get("href", ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None:
            text = "".join(self.cell)
            self.rows[-1].append("\n".join(" ".join(line.split()) for line in text.split("\n")).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_table_rows(pages: DataFrame, html_col: str = "html", key: str = "page_id", css: str = "") -> DataFrame:
    """(key, row, header, cells, links) of every table row with as many cells as its header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, html in zip(pdf["key"], pdf["html"], strict=True):
                reader = TableReader(css)
                reader.feed(html or "")
                reader.close()
                filled = [(r, a) for r, a in zip(reader.rows, reader.links, strict=True) if r]
                head = filled[0][0] if filled else []
                out += [(k, i, head, r, a) for i, (r, a) in enumerate(filled[1:]) if len(r) == len(head)]
            yield pd.DataFrame(out, columns=["key", "row", "header", "cells", "links"], dtype=object)

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "key string, row int, header array<string>, cells array<string>, links array<string>")


# Words in a screener's headings, in the order they are tried.
SCREENER_HEADINGS = (
    ("filing date", "filed"), ("trade date", "traded"), ("ticker", "ticker"), ("insider name", "insider_name"), ("insider", "insider_name"), ("title", "insider_title"),
    ("trade type", "kind"), ("transaction", "kind"), ("price", "price"), ("qty", "shares"), ("shares", "shares"), ("owned", "owned"), ("value", "value"), ("company", "company"),
)


def _holds(word: str, heading: Column) -> Column:
    return F.contains(heading, F.lit(word))


def screener_trades(rows: DataFrame) -> DataFrame:
    """Trades from screener rows by words in their headings; a row without ticker, name or a day has ``error``."""
    names = F.transform("header", lambda h: F.lower(F.trim(F.regexp_replace(h, r"\s+", " "))))

    def cell(field: str) -> Column:
        found = None
        for word, name in SCREENER_HEADINGS:
            if name == field:
                holds = functools.partial(_holds, word)
                at = F.array_position(F.transform(names, lambda h: holds(h)), True)  # noqa: B023
                got = F.when(at > 0, F.get("cells", (at - 1).cast("int")))
                found = got if found is None else F.coalesce(found, got)
        return found

    out = rows.select(
        F.upper(cell("ticker")).alias("ticker"), F.coalesce(cell("company"), F.lit("")).alias("company"), cell("insider_name").alias("insider_name"), cell("insider_title").alias("insider_title"),
        cell("kind").alias("raw_type"), classify_trade(cell("kind")).alias("trade_type"), parse_date(cell("traded")).alias("trade_date"), parse_date(cell("filed")).alias("filing_date"),
        parse_number(cell("shares")).alias("shares"), parse_number(cell("price")).alias("price"), parse_number(cell("value")).alias("value"), parse_number(cell("owned")).alias("shares_owned_after"),
        F.lit("openinsider").alias("source"),
    )
    whole = (F.coalesce("ticker", F.lit("")) != "") & (F.coalesce("insider_name", F.lit("")) != "") & F.col("trade_date").isNotNull()
    return out.withColumn("error", F.when(~whole, "malformed_trade_row"))


def screener_issues(trades: DataFrame, cap: int = 1000) -> DataFrame:
    """(source, identifier, reason) of what a screener answer lacks: broken rows, and rows beyond the number it shows."""
    broken = trades.filter("error IS NOT NULL").select("source", F.coalesce("ticker", F.lit("")).alias("identifier"), F.col("error").alias("reason"))
    many = trades.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap)
    return broken.unionByName(many.select("source", F.lit("").alias("identifier"), F.lit("result_limit").alias("reason")))


def write_results(df: DataFrame, folder: str, label: str) -> list[str]:
    """One CSV and one JSON file for a result, each there whole or not at all; the label is made safe for a path.

    Files are written beside their place and moved there; an older file of the
    name is replaced.  For results that a person reads.
    """
    spark = df.sparkSession
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", label).strip(".") or "results"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    out = []
    for kind in ("csv", "json"):
        aside, place = f"{folder.rstrip('/')}/.{safe}.{kind}.{uuid.uuid4().hex}", f"{folder.rstrip('/')}/{safe}.{kind}"
        writer = df.coalesce(1).write.option("encoding", "UTF-8")
        (writer.option("header", True).csv if kind == "csv" else writer.json)(aside)
        fs = path(aside).getFileSystem(conf)
        (part,) = [x.getPath() for x in fs.listStatus(path(aside)) if x.getPath().getName().startswith("part-")]
        if fs.exists(path(place)):
            fs.delete(path(place), True)
        fs.rename(part, path(place))
        fs.delete(path(aside), True)
        out.append(place)
    return out


class SnapshotStore:
    """Tables as numbered Parquet snapshots; a write becomes visible when its marker file is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def versions(self, table: str) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/{table}")
        found = fs.listStatus(folder) if fs.exists(folder) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def write(self, table: str, df: DataFrame) -> int:
        version = (self.versions(table) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v{version}")
        return version

    def read(self, table: str, version: int | None = None) -> DataFrame:
        have = self.versions(table)
        if not have:
            raise FileNotFoundError(f"{table} has no snapshot")
        return self.spark.read.parquet(f"{self.root}/{table}/v{version or have[-1]}")


class AppendStore:
    """Tables as folders of batches; a batch is visible when its marker file is there, and is never written twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(conf).exists(path)

    def _batches(self, table: str) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = folder.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if self.has(table, n))

    def has(self, table: str, batch: str) -> bool:
        return self._exists(f"{table}/{batch}/_SUCCESS")

    def append(self, table: str, batch: str, df: DataFrame) -> None:
        """Write a batch whole; what an interrupted try left behind is replaced."""
        if not self.has(table, batch):
            df.write.mode("overwrite").parquet(f"{self.root}/{table}/{batch}")

    def read(self, table: str) -> DataFrame | None:
        """All finished batches, None before the first."""
        have = self._batches(table)
        return self.spark.read.parquet(*(f"{self.root}/{table}/{b}" for b in have)) if have else None


__all__ = [n for n in dir() if n.startswith(("read_", "html_", "screener", "write_", "import_", "Snapshot", "Append"))] + ["export_label"]
