"""Rules for quarterly data sets: selection, integrity, footnotes, quarters, scan plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.localized import footnote_references, relationship_roles, required_quarters
from ledgerline.functions.text import dataset_date, normalize_cik

# Key columns of a data set's child tables.
KEYS = {
    "SUBMISSION": ("ACCESSION_NUMBER",), "REPORTINGOWNER": ("ACCESSION_NUMBER", "RPTOWNERCIK"), "NONDERIV_TRANS": ("ACCESSION_NUMBER", "NONDERIV_TRANS_SK"),
    "DERIV_TRANS": ("ACCESSION_NUMBER", "DERIV_TRANS_SK"), "FOOTNOTES": ("ACCESSION_NUMBER", "FOOTNOTE_ID"),
}
MAX_FILING_BYTES = 10_000_000


def select_filings(tables: Mapping[str, DataFrame], since: date | None = None, until: date | None = None, ciks: Sequence[str] | None = None) -> DataFrame:
    """(accession) of submissions filed in a range whose issuer or any owner is asked for."""
    sub = tables["SUBMISSION"].select(
        F.col("ACCESSION_NUMBER").alias("accession"), dataset_date(F.col("FILING_DATE")).alias("filed"), normalize_cik(F.col("ISSUERCIK")).alias("issuer")
    ).filter("filed IS NOT NULL")
    if since is not None:
        sub = sub.filter(F.col("filed") >= F.lit(since))
    if until is not None:
        sub = sub.filter(F.col("filed") <= F.lit(until))
    if ciks is None:
        return sub.select("accession")
    asked = tables["SUBMISSION"].sparkSession.createDataFrame([(c,) for c in ciks], "cik string").select(normalize_cik(F.col("cik")).alias("cik")).distinct()
    by_owner = tables["REPORTINGOWNER"].select(F.col("ACCESSION_NUMBER").alias("accession"), normalize_cik(F.col("RPTOWNERCIK")).alias("cik")).join(asked, "cik", "left_semi")
    by_issuer = sub.join(asked, F.col("issuer") == F.col("cik"), "left_semi").select("accession")
    return by_issuer.union(sub.join(by_owner.select("accession"), "accession", "left_semi").select("accession")).distinct()


def filing_bytes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(accession, bytes): the size of all values of a filing in all tables."""
    parts = []
    for df in tables.values():
        size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in df.columns))
        parts.append(df.select(F.col("ACCESSION_NUMBER").alias("accession"), size.cast("long").alias("size")))
    return reduce(DataFrame.unionByName, parts).groupBy("accession").agg(F.sum("size").alias("bytes"))


def dataset_errors(tables: Mapping[str, DataFrame], max_bytes: int = MAX_FILING_BYTES) -> DataFrame:
    """(accession, error) of filings that must not be used, one row for each thing that is wrong.

    Repeated keys, rows without a submission, missing footnotes, owners without
    a name or with an unknown relationship, unreadable days, and filings above
    ``max_bytes``.
    """
    out = []
    for name, df in tables.items():
        key = [c for c in KEYS.get(name, ()) if c in df.columns]
        if key:
            twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            out.append(twice.select(F.col("ACCESSION_NUMBER").alias("accession"), F.lit(f"{name}: repeated key").alias("error")))
        if name != "SUBMISSION":
            lost = df.join(tables["SUBMISSION"].select("ACCESSION_NUMBER"), "ACCESSION_NUMBER", "left_anti")
            out.append(lost.select(F.col("ACCESSION_NUMBER").alias("accession"), F.lit(f"{name}: no submission").alias("error")).distinct())
    day = tables["SUBMISSION"].filter(dataset_date(F.col("FILING_DATE")).isNull())
    out.append(day.select(F.col("ACCESSION_NUMBER").alias("accession"), F.lit("unreadable filing date").alias("error")))
    role = relationship_roles(F.col("RPTOWNER_RELATIONSHIP"))["error"]
    owner = tables["REPORTINGOWNER"].withColumn("error", F.coalesce(role, F.when(F.coalesce(F.trim("RPTOWNERNAME"), F.lit("")) == "", "owner without a name")))
    out.append(owner.filter("error IS NOT NULL").select(F.col("ACCESSION_NUMBER").alias("accession"), "error"))
    out.append(missing_footnotes(tables).select("accession", F.concat(F.lit("missing footnote "), "footnote").alias("error")))
    large = filing_bytes(tables).filter(F.col("bytes") > max_bytes)
    out.append(large.select("accession", F.lit("filing is too large").alias("error")))
    return reduce(DataFrame.unionByName, out).distinct()


def missing_footnotes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(accession, table, row, footnote) of references to footnotes that a filing does not have, from all ``*_FN`` columns."""
    known = tables["FOOTNOTES"].groupBy(F.col("ACCESSION_NUMBER").alias("note_accession")).agg(F.collect_set("FOOTNOTE_ID").alias("known"))
    out = []
    for name in ("NONDERIV_TRANS", "DERIV_TRANS"):
        df = tables[name]
        named = [c for c in df.columns if c.endswith("_FN")]
        if not named:
            continue
        rows = df.select(F.col("ACCESSION_NUMBER").alias("accession"), F.col(KEYS[name][1]).alias("row"), F.concat_ws(" ", *named).alias("refs"))
        met = rows.join(known, F.col("accession") == F.col("note_accession"), "left")
        lacking = footnote_references(F.col("refs"), F.coalesce("known", F.array().cast("array<string>")))["missing"]
        out.append(met.select("accession", F.lit(name).alias("table"), "row", F.explode(lacking).alias("footnote")))
    if not out:
        return tables["FOOTNOTES"].select(F.col("ACCESSION_NUMBER").alias("accession"), F.lit("").alias("table"), F.lit("").alias("row"), F.col("FOOTNOTE_ID").alias("footnote")).limit(0)
    return reduce(DataFrame.unionByName, out)


def with_owner_roles(owners: DataFrame) -> DataFrame:
    """Owners with role flags from their relationship text."""
    r = relationship_roles(F.col("RPTOWNER_RELATIONSHIP"))
    return owners.withColumns({c: r[c] for c in ("is_director", "is_officer", "is_ten_percent_owner", "is_other")})


def quarter_plan(published: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(available, missing) quarters, as their first days, that ranges (since, until) of filing dates need of the published ones (quarter)."""
    needed = ranges.select(F.explode(required_quarters(F.col("since"), F.col("until"))).alias("quarter")).distinct()
    have = published.select("quarter").distinct()
    return needed.intersect(have).orderBy("quarter"), needed.exceptAll(have).orderBy("quarter")


def scan_requests(spark: SparkSession, tickers: Sequence[str], since: date, until: date) -> DataFrame:
    """(ticker, day) for every ticker and every day of a range."""
    if since > until:
        raise ValueError("since is after until")
    names = list(dict.fromkeys(t.strip().upper() for t in tickers))
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until))).alias("day"))
    return days.select(F.explode(listed).alias("ticker"), "day")
