"""Command line over landed files: nothing is downloaded; sources are read from folders, tables kept in a store.

    python -m ledgerline.cli --store DIR --landing DIR COMMAND ...

The landing folder has a subfolder for each source.  Exit codes: 0 done, 1
failed, 2 wrong arguments, 3 done in part (something could not be read), 130
interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.localized import describe_incomplete, fetch_status
from ledgerline.functions.text import classify_trade
from ledgerline.operators import compare, members, timeline, trades, upsert
from ledgerline.operators.datasets import dataset_errors, scan_requests
from ledgerline.sources import filings, national, tables

OK, FAILED, USAGE, PARTIAL, INTERRUPTED = 0, 1, 2, 3, 130
RECENT_COUNT, RECENT_OVERLAP = 100, 200
US_COLUMNS = ("ticker", "company", "insider_name", "insider_title", "trade_type", "trade_date", "filing_date", "shares", "price", "value", "shares_owned_after", "source", "url")


class Session:
    """A Spark session, the landing folder and the store of one call."""

    def __init__(self, spark: SparkSession, landing: str, store: str):
        self.spark, self.landing, self.store = spark, landing.rstrip("/"), tables.SnapshotStore(spark, store)

    def landed(self, name: str) -> str | None:
        """The folder of a source, None where nothing has landed."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.landing}/{name}")
        return str(path) if path.getFileSystem(conf).exists(path) else None

    def table(self, name: str) -> DataFrame | None:
        return self.store.read(name) if self.store.versions(name) else None

    def pages(self, name: str) -> DataFrame | None:
        """(key, html) of landed pages; the key is the file's name without its ending."""
        path = self.landed(name)
        if path is None:
            return None
        files = self.spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
        return files.select(F.regexp_extract("file", r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("key"), F.col("value").alias("html"))


def day(text: str) -> date:
    return date.fromisoformat(text)


def checked_range(since: date | None, until: date | None, default_days: int | None = None) -> tuple[date | None, date | None]:
    """Both ends or neither, in order; by default the days up to today."""
    if default_days is not None and since is None and until is None:
        until = date.today()
        since = until - timedelta(days=default_days)
    if (since is None) != (until is None):
        raise SystemExit(USAGE)
    if since is not None and since > until:
        print("--since is after --until", file=sys.stderr)
        raise SystemExit(USAGE)
    return since, until


def full_us(rows: DataFrame) -> DataFrame:
    """Rows of a source in the columns a store of US trades has."""
    flags = [(F.col(f"{c}_missing") if f"{c}_missing" in rows.columns else F.lit(False)).alias(f"{c}_missing") for c in trades.NUMBERS]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in rows.columns else F.lit(0.0).alias(c)
    days = [F.col(c) if c in rows.columns else F.lit(None).cast("date").alias(c) for c in ("trade_date", "filing_date")]
    return rows.select(
        *(text(c) for c in ("ticker", "company", "insider_name", "insider_title")), F.coalesce("trade_type", F.lit("Other")).alias("trade_type"), *days,
        *(number(c) for c in trades.NUMBERS), *flags, *(text(c) for c in ("source", "url", "accession_number", "sec_row_id", "transaction_code", "sec_detail_json")),
        (F.coalesce("is_derivative", F.lit(False)) if "is_derivative" in rows.columns else F.lit(False)).alias("is_derivative"),
    )


def store_us(s: Session, rows: DataFrame) -> DataFrame:
    """Upsert into the store; returns (outcome, n)."""
    stored = s.table("us")
    incoming = full_us(rows).withColumn("arrival", F.monotonically_increasing_id())
    if stored is None:
        stored = trades.merge_us(incoming.limit(0), "arrival").drop("observations")
    done = upsert.upsert_us(stored, incoming)
    counts = done.counts().collect()
    s.store.write("us", done.rows)
    return s.spark.createDataFrame(counts, "outcome string, n long")


def say(counts: DataFrame) -> None:
    print(" ".join(f"{r['outcome']}={r['n']}" for r in counts.orderBy("outcome").collect()) or "nothing new")


def finish(rows: DataFrame | None, issues: DataFrame | None) -> int:
    """Exit code of a read: 3 with a description when something is missing."""
    n = issues.count() if issues is not None else 0
    if not n:
        return OK
    first = issues.limit(3).groupBy().agg(F.collect_list(F.struct("source", "identifier", "reason")).alias("first"))
    # The description shows three issues and counts the rest.
    listed = F.concat("first", F.array_repeat(F.get("first", F.lit(0)), F.greatest(F.lit(n) - F.size("first"), F.lit(0))))
    told = first.select(describe_incomplete(fetch_status(F.lit(rows.count() if rows is not None else 0), F.lit(n)), listed).alias("t")).first()["t"]
    print(told, file=sys.stderr)
    return PARTIAL


def screener_rows(s: Session, sources: Sequence[str], ticker: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(trades, issues) of the landed screener pages."""
    rows, issues = None, None
    for source in sources:
        pages = s.pages(source)
        if pages is None:
            continue
        pages = pages.filter(F.upper("key") == ticker.upper()) if ticker else pages
        found = national.read_compound_screener(pages, "key") if source == "secform4" else tables.screener_trades(tables.html_table_rows(pages, key="key", css="tinytable"))
        good, bad = found.filter("error IS NULL"), tables.screener_issues(found)
        good = full_us(good)
        rows = good if rows is None else rows.unionByName(good)
        issues = bad if issues is None else issues.unionByName(bad)
    return rows, issues


def _listed(s: Session, args: argparse.Namespace, rows: DataFrame, label: str) -> None:
    shown = [c for c in US_COLUMNS if c in rows.columns]
    if args.save:
        print("\n".join(tables.write_results(rows.select(*shown), f"{s.store.root}/exports", label)))
    rows.select(*shown).show(20, truncate=32)


def scan(s: Session, args: argparse.Namespace) -> int:
    since, until = checked_range(args.since, args.until, 183)
    rows, issues = screener_rows(s, args.source or ("secform4", "openinsider"), args.ticker)
    if rows is not None:
        say(store_us(s, rows))
    held = s.table("us")
    if held is None:
        print("no trades")
        return OK if rows is not None else FAILED
    held = held.withColumns({"row_id": F.xxhash64("identity"), "source": F.split_part("provenance", F.lit(","), F.lit(1))})
    links = trades.duplicate_links(trades.filter_us(held, ticker=args.ticker))
    found = trades.query_us(held, links, args.ticker, since, until)
    if s.landed("members"):
        who = members.flag(found.select("row_id", F.col("insider_name").alias("name")), tables.read_members(s.spark, s.landed("members")))
        found = found.join(who.select("row_id", F.lit(True).alias("is_congress")), "row_id", "left").withColumn("is_congress", F.coalesce("is_congress", F.lit(False)))
    elif args.congress_only:
        found = found.withColumn("is_congress", F.lit(False))
    found = trades.filter_us(found, trade_type=args.type or "", min_value=args.min_value, congress_only=args.congress_only)
    _listed(s, args, found.orderBy(F.desc_nulls_last("trade_date"), "row_id"), f"scan_{args.ticker}")
    return finish(rows, issues)


def latest(s: Session, args: argparse.Namespace) -> int:
    rows, issues = screener_rows(s, args.source or ("secform4", "openinsider"), None)
    if rows is not None:
        say(store_us(s, rows))
    held = s.table("us")
    if held is None:
        return FAILED
    held = held.withColumn("row_id", F.xxhash64("identity"))
    _listed(s, args, trades.latest(held, ("filing_date", "trade_date"), args.count), "latest")
    return finish(rows, issues)


def resolve_cik(s: Session, args: argparse.Namespace) -> int:
    path = s.landed("company_tickers.json")
    found = tables.read_ticker_directory(s.spark, path).filter(F.col("ticker") == args.ticker.upper()).head(1) if path else []
    if not found and (pages := s.pages("lookup")) is not None:
        found = tables.cik_from_lookup(pages.filter(F.upper("key") == args.ticker.upper())).filter("cik IS NOT NULL").head(1)
    if not found:
        print(f"{args.ticker}: unknown", file=sys.stderr)
        return FAILED
    print(found[0]["cik"])
    return OK


def init_congress(s: Session, args: argparse.Namespace) -> int:
    if s.table("members") is not None and not args.force:
        print("members are there; --force replaces them")
        return OK
    path = s.landed("members")
    if path is None:
        print("no members have landed", file=sys.stderr)
        return FAILED
    print(f"members v{s.store.write('members', tables.read_members(s.spark, path))}")
    return OK


def eu_scan(s: Session, args: argparse.Namespace) -> int:
    since, until = checked_range(args.since, args.until)
    readers: dict[str, Callable[[DataFrame], DataFrame]] = {
        "rns": lambda p: national.read_uk_announcements(p, "key"), "bafin": lambda p: national.read_german_pages(p, "key"),
        "amf": lambda p: national.read_french_texts(p, "html"), "afm": lambda p: national.read_dutch_json(p, "html"),
    }
    rows = None
    for rank, (source, read) in enumerate(readers.items()):
        pages = s.pages(source)
        if pages is not None:
            part = read(pages).withColumn("arrival", F.lit(rank))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        print("no registers have landed", file=sys.stderr)
        return FAILED
    good = rows.filter("error IS NULL")
    if args.watchlist:
        asked = tables.read_watchlist(s.spark, args.watchlist).withColumnRenamed("entry", "isin")
        good = good.join(asked, "isin", "left_semi")
    found = trades.filter_eu(good, args.isin, args.country, args.type or "All", args.min_value, since, until)
    found = trades.merged_order(found.withColumn("row", F.monotonically_increasing_id()), "row", 1_000_000)
    if args.save:
        print("\n".join(tables.write_results(found, f"{s.store.root}/exports", f"eu_{args.isin or 'all'}")))
    found.select("isin", "issuer_name", "insider_name", "trade_type", "trade_date", "volume", "price", "currency", "source").show(20, truncate=32)
    return finish(good, rows.filter("error IS NOT NULL").select("source", F.coalesce("url", F.lit("")).alias("identifier"), F.col("error").alias("reason")))


def import_legacy(s: Session, args: argparse.Namespace) -> int:
    kinds, errors = tables.import_legacy(s.spark, args.path, args.max_file_size_mib << 20)
    for kind, rows in kinds.items():
        print(f"{kind}: {rows.count()}")
    rows = kinds["us"]
    if rows.limit(1).count():
        say(store_us(s, rows.withColumnRenamed("edgar_url", "url").withColumn("trade_type", F.coalesce("trade_type", classify_trade(F.lit(""))))))
    bad = errors.select(F.lit("import").alias("source"), F.coalesce("file", F.lit("")).alias("identifier"), F.col("error").alias("reason"))
    return finish(rows, bad)


def price(s: Session, args: argparse.Namespace) -> int:
    since, until = checked_range(args.since, args.until, 365)
    path = s.landed(f"prices/{args.ticker.upper()}.json")
    if path is None:
        print("no prices have landed", file=sys.stderr)
        return FAILED
    fetched = tables.read_columnar_prices(s.spark, path).withColumn("symbol", F.lit(args.ticker.upper()))
    held = s.table("prices")
    if held is not None:
        mine = held.filter(F.col("symbol") == args.ticker.upper())
        plan = timeline.refresh_decision(mine, fetched, fetched, since, until, date.today())
        fetched = timeline.refreshed_bars(mine, fetched.select(*mine.columns), fetched.select(*mine.columns), plan).unionByName(held.filter(F.col("symbol") != args.ticker.upper()))
    s.store.write("prices", fetched)
    bars = s.table("prices").filter((F.col("symbol") == args.ticker.upper()) & F.col("price_date").between(F.lit(since), F.lit(until)))
    bars.orderBy("price_date").show(20)
    return OK


def _store_filings(s: Session, rows: DataFrame, outcomes: DataFrame) -> int:
    say(store_us(s, rows))
    fresh = outcomes.select("accession_number", "status", F.lit(1).cast("long").alias("attempts"))
    before = s.table("ledger")
    entries = fresh.withColumn("seq", F.lit(2)) if before is None else before.withColumn("seq", F.lit(1)).unionByName(fresh.withColumn("seq", F.lit(2)))
    s.store.write("ledger", trades.best_ledger(entries))
    failed = outcomes.filter("status LIKE '%failure'")
    return finish(rows, failed.select(F.lit("sec_edgar").alias("source"), F.col("accession_number").alias("identifier"), F.coalesce("error", "status").alias("reason")))


def sec_daily(s: Session, args: argparse.Namespace) -> int:
    """Filings of the landed daily indexes in the range whose documents have landed and that the ledger has not finished."""
    since, until = checked_range(args.since, args.until, 7)
    index, documents = s.landed("daily-index"), s.landed("documents")
    if index is None or documents is None:
        print("no indexes or documents have landed", file=sys.stderr)
        return FAILED
    listed = filings.read_master_index(s.spark, index).filter(F.col("filing_date").between(F.lit(since), F.lit(until)))
    docs = filings.read_ownership_documents(s.spark, documents)
    outcomes = filings.filing_outcomes(docs, s.table("ledger")).join(listed.select(F.col("accession").alias("accession_number"), F.col("filing_date").alias("filed")), "accession_number")
    rows = filings.explode_filings(docs).join(outcomes.filter("status = 'success'").select("accession_number", F.col("filed").alias("filing_date")), "accession_number")
    return _store_filings(s, rows, outcomes)


def sec_backfill(s: Session, args: argparse.Namespace) -> int:
    """Members of a landed bulk archive from where the last run stopped; an archive that changed starts anew."""
    if not args.confirm_full_backfill and args.since is None:
        print("a full backfill needs --confirm-full-backfill, or a range", file=sys.stderr)
        return USAGE
    since, until = checked_range(args.since, args.until)
    archive = filings.archive_fingerprint(args.zip)
    none = s.spark.createDataFrame([], "archive_id string, scope string, next_member long")
    progress, retries = s.table("archive_progress"), s.table("archive_retries")
    progress = progress if progress is not None else none
    retries = retries if retries is not None else s.spark.createDataFrame([], "archive_id string, scope string, member long")
    scope = f"{since}:{until}"
    every = s.spark.createDataFrame([(archive, scope, i) for i in range(filings.member_count(args.zip))], "archive_id string, scope string, member long")
    todo = upsert.members_to_read(every, progress, retries)
    found = filings.read_bulk_archive(s.spark, args.zip, todo)
    broken = found.filter("error IS NOT NULL").select("member").distinct()
    batch = todo.join(broken.withColumn("failed", F.lit(True)), "member", "left").select("archive_id", "scope", "member", F.coalesce("failed", F.lit(False)).alias("failed"))
    ahead, left = upsert.archive_progress(progress, retries, batch)
    listed = found.filter("error IS NULL")
    if since is not None:
        listed = listed.filter(F.col("filing_date").between(F.lit(since), F.lit(until)))
    s.store.write("discovered", listed.select("cik", "accession", "filing_date", "form", "document"))
    print(f"discovered={listed.count()}")
    s.store.write("archive_progress", ahead)
    s.store.write("archive_retries", left)
    return finish(listed, found.filter("error IS NOT NULL").select(F.lit("bulk").alias("source"), F.col("member").cast("string").alias("identifier"), F.col("error").alias("reason")))


def sec_backfill_dataset(s: Session, args: argparse.Namespace) -> int:
    since, until = checked_range(args.since, args.until)
    parts = filings.read_dataset_archives(s.spark, args.zip)
    errors = dataset_errors(parts)
    rows = filings.dataset_transactions(parts, since, until, args.cik, errors)
    rows = rows.withColumns({
        "insider_name": F.get("owners", F.lit(0))["name"], "accession_number": F.col("accession"), "source": F.lit("sec_edgar"), "value": F.col("shares") * F.col("price"),
        "shares_missing": F.col("shares").isNull(), "price_missing": F.col("price").isNull(), "value_missing": (F.col("shares") * F.col("price")).isNull(), "transaction_code": F.col("code"),
    })
    done = rows.select("accession_number", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error")).distinct()
    bad = errors.select(F.col("accession").alias("accession_number"), F.lit("permanent_failure").alias("status"), "error").dropDuplicates(["accession_number"])
    return _store_filings(s, rows, done.unionByName(bad))


def sec_compare(s: Session, args: argparse.Namespace) -> int:
    held = s.table("us")
    if held is None:
        return FAILED
    since, until = (args.date, args.date) if args.date else checked_range(args.since, args.until)
    if since is None:
        print("a --date or a range is needed", file=sys.stderr)
        return USAGE
    asked = scan_requests(s.spark, args.ticker, since, until).select("ticker", F.col("day").alias("filing_date"))
    rows = held.withColumns({"row_id": F.xxhash64("identity"), "ticker": F.upper("ticker")}).join(asked, ["ticker", "filing_date"], "left_semi")
    own = F.split("provenance", ",")
    if args.legacy_source:
        rows = rows.filter((F.col("accession_number") != "") | F.exists(own, lambda x: x.isin(*args.legacy_source)))
    text = compare.render(compare.compare_lots(rows), args.format)
    if args.output:
        with open(f"{args.output}.part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{args.output}.part", args.output)
    else:
        print(text)
    return OK


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline", description=__doc__.splitlines()[0])
    p.add_argument("--store", default="ledgerline-store")
    p.add_argument("--landing", default="landing")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[Session, argparse.Namespace], int], *aliases: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, aliases=list(aliases))
        c.set_defaults(run=run)
        return c

    def ranged(c: argparse.ArgumentParser) -> argparse.ArgumentParser:
        c.add_argument("--since", type=day)
        c.add_argument("--until", type=day)
        return c

    def filtered(c: argparse.ArgumentParser) -> argparse.ArgumentParser:
        c.add_argument("--type")
        c.add_argument("--min-value", type=float, default=0.0)
        c.add_argument("--save", action="store_true")
        return c

    c = filtered(ranged(command("scan", scan)))
    c.add_argument("ticker")
    c.add_argument("--congress-only", action="store_true")
    c.add_argument("--source", action="append", choices=["secform4", "openinsider"])
    c = filtered(command("latest", latest))
    c.add_argument("--count", type=int, default=RECENT_COUNT)
    c.add_argument("--source", action="append", choices=["secform4", "openinsider"])
    command("resolve-cik", resolve_cik, "cik").add_argument("ticker")
    command("init-congress", init_congress).add_argument("--force", action="store_true")
    c = filtered(ranged(command("eu-scan", eu_scan)))
    c.add_argument("isin", nargs="?")
    c.add_argument("--country", default="All", choices=["All", "UK", "DE", "FR", "NL"])
    c.add_argument("--watchlist")
    c = command("import-legacy", import_legacy)
    c.add_argument("path")
    c.add_argument("--max-file-size-mib", type=int, default=64)
    ranged(command("price", price)).add_argument("ticker")
    for name in ("sec-daily", "sec-catchup"):
        ranged(command(name, sec_daily))
    c = ranged(command("sec-backfill", sec_backfill))
    c.add_argument("--zip", required=True)
    c.add_argument("--confirm-full-backfill", action="store_true")
    c = ranged(command("sec-backfill-dataset", sec_backfill_dataset))
    c.add_argument("--zip", required=True)
    c.add_argument("--cik", action="append")
    c = ranged(command("sec-compare", sec_compare))
    c.add_argument("--ticker", action="append", required=True)
    c.add_argument("--date", type=day)
    c.add_argument("--legacy-source", action="append")
    c.add_argument("--format", choices=["text", "markdown", "json"], default="text")
    c.add_argument("--output")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = build_parser().parse_args(argv)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else USAGE
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        return args.run(Session(spark, args.landing, args.store), args)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else USAGE
    except KeyboardInterrupt:
        return INTERRUPTED
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)[:2000]}), file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
