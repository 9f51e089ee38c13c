"""Readers of filing indexes, archives, ownership documents and quarterly data sets.

Every reader takes a path that Spark reads and returns a typed DataFrame; rows
that do not parse are dropped or reported as the reader says, never guessed.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from datetime import date
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.checkpoints import cut
from ledgerline.functions.localized import derived_value, insider_title
from ledgerline.functions.text import dataset_date, normalize_cik, normalize_issuer_symbol
from ledgerline.operators.datasets import select_filings
from ledgerline.schemas import OWNERSHIP_FORMS, TRANSACTION_CODES, TRANSACTION_FORMS

# Tables and required columns of a quarterly data set.
DATASET_TABLES = {
    "SUBMISSION": "ACCESSION_NUMBER FILING_DATE PERIOD_OF_REPORT DATE_OF_ORIG_SUB DOCUMENT_TYPE ISSUERCIK ISSUERNAME ISSUERTRADINGSYMBOL REMARKS",
    "REPORTINGOWNER": "ACCESSION_NUMBER RPTOWNERCIK RPTOWNERNAME RPTOWNER_RELATIONSHIP RPTOWNER_TITLE RPTOWNER_TXT",
    "NONDERIV_TRANS": "ACCESSION_NUMBER NONDERIV_TRANS_SK SECURITY_TITLE TRANS_DATE TRANS_CODE TRANS_SHARES TRANS_PRICEPERSHARE"
    " TRANS_ACQUIRED_DISP_CD SHRS_OWND_FOLWNG_TRANS DIRECT_INDIRECT_OWNERSHIP",
    "DERIV_TRANS": "ACCESSION_NUMBER DERIV_TRANS_SK SECURITY_TITLE TRANS_DATE TRANS_CODE TRANS_SHARES TRANS_PRICEPERSHARE"
    " TRANS_ACQUIRED_DISP_CD SHRS_OWND_FOLWNG_TRANS DIRECT_INDIRECT_OWNERSHIP",
    "FOOTNOTES": "ACCESSION_NUMBER FOOTNOTE_ID FOOTNOTE_TXT",
}
MAX_MEMBER_BYTES = 1 << 30
MAX_XML_CHARS = 5_000_000
MAX_XML_DEPTH = 64


def read_master_index(spark: SparkSession, path: str) -> DataFrame:
    """(cik, company, form, filing_date, archive_path, accession) of a pipe-delimited daily index.

    Header noise and rows with a bad field are skipped; of an accession the
    first line counts.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("line"))
    part = F.split("value", r"\|")
    rows = lines.filter(F.size(part) == 5).select(
        "line", normalize_cik(part[0]).alias("cik"), F.trim(part[1]).alias("company"), F.trim(part[2]).alias("form"),
        F.coalesce(F.try_to_date(F.trim(part[3]), "yyyy-MM-dd"), F.try_to_date(F.trim(part[3]), "yyyyMMdd")).alias("filing_date"),
        F.trim(part[4]).alias("archive_path"),
    )
    rows = rows.withColumn("accession", F.regexp_extract("archive_path", r"^edgar/data/\d+/(\d{10}-\d{2}-\d{6})\.txt$", 1))
    rows = rows.filter("cik != '' AND filing_date IS NOT NULL AND accession != ''")
    first = F.row_number().over(Window.partitionBy("accession").orderBy("line"))
    return rows.withColumn("k", first).filter("k = 1").drop("k", "line")


def archive_fingerprint(path: str) -> str:
    """SHA-256 over an archive's directory, to tell whether a resumed run reads the same one."""
    h = hashlib.sha256()
    with zipfile.ZipFile(path) as z:
        for i in z.infolist():
            h.update(f"{i.filename}\0{i.CRC}\0{i.file_size}\0{i.compress_size}\n".encode())
    return h.hexdigest()


def check_members(z: zipfile.ZipFile, max_ratio: int = 200) -> list[zipfile.ZipInfo]:
    """Members that are safe to extract; anything odd is an error."""
    seen = set()
    for i in z.infolist():
        parts = i.filename.replace("\\", "/").split("/")
        if i.filename in seen or i.filename.startswith("/") or ".." in parts or ":" in parts[0]:
            raise ValueError(f"unsafe member {i.filename!r}")
        if i.flag_bits & 1 or (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"encrypted member or link {i.filename!r}")
        if i.file_size > MAX_MEMBER_BYTES or i.file_size > max_ratio * max(i.compress_size, 1) + (1 << 20):
            raise ValueError(f"member {i.filename!r} is too large")
        seen.add(i.filename)
    return [i for i in z.infolist() if not i.is_dir()]


def read_dataset_archives(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of quarterly archives at ``path``, in any store Spark reads; one task reads one archive.

    An archive with an unsafe member, a repeated or missing table, or a table
    without a required column is an error.  All columns are texts; ``*_FN``
    columns come along as one, ``REFS_FN``.  Rows are written to the shared
    folder once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(MAX_XML_CHARS)
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for table, member in _dataset_members(z).items():
                        with z.open(member) as raw:
                            lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter="\t", quotechar='"')
                            head = next(lines, [])
                            if lacking := set(DATASET_TABLES[table].split()) - set(head):
                                raise ValueError(f"{table} lacks {sorted(lacking)}")
                            while block := list(itertools.islice(lines, 4096)):
                                yield pd.DataFrame({"table": table, "fields": [dict(zip(head, x, strict=False)) for x in block]})

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = cut(files.mapInPandas(run, "table string, fields map<string,string>"))
    out = {}
    for table, columns in DATASET_TABLES.items():
        names = columns.split()
        refs = F.array_join(F.map_values(F.map_filter("fields", lambda k, v: F.endswith(k, F.lit("_FN")) & (v != ""))), " ")
        fields = [F.try_element_at("fields", F.lit(c)).alias(c) for c in names]
        out[table] = rows.filter(F.col("table") == table).select(*fields, *([refs.alias("REFS_FN")] if "TRANS" in table else []))
    return out


def _dataset_members(z: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """Table to member; exactly one file of each required table."""
    out: dict[str, zipfile.ZipInfo] = {}
    for i in check_members(z):
        table = re.sub(r"\.tsv$", "", i.filename.rsplit("/", 1)[-1], flags=re.I).upper()
        if table in DATASET_TABLES:
            if table in out:
                raise ValueError(f"two files of {table}")
            out[table] = i
    if missing := set(DATASET_TABLES) - set(out):
        raise ValueError(f"missing tables {sorted(missing)}")
    return out


def stage_dataset(path: str, folder: str) -> dict[str, str]:
    """Unpack a quarterly archive into a folder that executors share with the driver. Returns table to path."""
    with zipfile.ZipFile(path) as z:
        return {table: z.extract(member, folder) for table, member in _dataset_members(z).items()}


def read_dataset(spark: SparkSession, tables: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables as strings; a missing required column is an error."""
    out = {}
    for name, columns in DATASET_TABLES.items():
        df = spark.read.csv(tables[name], sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
        if missing := set(columns.split()) - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
        out[name] = df
    return out


def dataset_transactions(
    tables: Mapping[str, DataFrame], since: date | None = None, until: date | None = None, ciks: Sequence[str] | None = None, errors: DataFrame | None = None
) -> DataFrame:
    """Transactions of a data set with their submission, owners and whether they are derivative.

    Only filings in the range of dates about one of the issuers or owners, and
    none with ``errors`` (accession, error).
    """
    sub = tables["SUBMISSION"].select(
        F.col("ACCESSION_NUMBER").alias("accession"), dataset_date(F.col("FILING_DATE")).alias("filing_date"), F.col("DOCUMENT_TYPE").alias("form"),
        normalize_cik(F.col("ISSUERCIK")).alias("cik_issuer"), F.col("ISSUERNAME").alias("company"), normalize_issuer_symbol(F.col("ISSUERTRADINGSYMBOL")).alias("ticker"),
    ).filter(F.col("form").isin(*OWNERSHIP_FORMS))
    owners = tables["REPORTINGOWNER"].groupBy(F.col("ACCESSION_NUMBER").alias("owner_accession")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("RPTOWNERCIK").alias("cik"), F.col("RPTOWNERNAME").alias("name"), F.col("RPTOWNER_RELATIONSHIP").alias("relationship")))).alias("owners")
    )
    parts = []
    for table, key, derivative in (("NONDERIV_TRANS", "NONDERIV_TRANS_SK", False), ("DERIV_TRANS", "DERIV_TRANS_SK", True)):
        parts.append(tables[table].select(
            F.col("ACCESSION_NUMBER").alias("row_accession"), F.concat(F.lit("derivative:" if derivative else "non-derivative:"), F.col(key)).alias("sec_row_id"),
            F.col("SECURITY_TITLE").alias("security"), dataset_date(F.col("TRANS_DATE")).alias("trade_date"), F.col("TRANS_CODE").alias("code"),
            F.col("TRANS_SHARES").try_cast("double").alias("shares"), F.col("TRANS_PRICEPERSHARE").try_cast("double").alias("price"),
            F.lit(derivative).alias("is_derivative"),
        ))
    rows = parts[0].unionByName(parts[1])
    if since is not None or until is not None or ciks is not None:
        sub = sub.join(select_filings(tables, since, until, ciks), "accession", "left_semi")
    if errors is not None:
        sub = sub.join(errors.select("accession"), "accession", "left_anti")
    joined = rows.join(sub, F.col("row_accession") == F.col("accession")).join(owners, F.col("accession") == F.col("owner_accession"), "left")
    return joined.withColumn("trade_type", trade_type(F.col("code"), F.col("is_derivative"))).drop("row_accession", "owner_accession")


def orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, accession) of child rows without a submission."""
    sub = tables["SUBMISSION"].select("ACCESSION_NUMBER")
    parts = [
        df.join(sub, "ACCESSION_NUMBER", "left_anti").select(F.lit(name).alias("table"), F.col("ACCESSION_NUMBER").alias("accession"))
        for name, df in tables.items() if name != "SUBMISSION"
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def code_category(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TRANSACTION_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(F.coalesce(code, F.lit(""))))), F.lit("other"))


def trade_type(code: Column, derivative: Column) -> Column:
    """Purchases, sales and exercises outside derivatives; all else is Other."""
    kind = code_category(code)
    plain = F.when(kind == "purchase", "Buy").when(kind == "sale", "Sell").when(kind == "exercise", "Exercise").otherwise("Other")
    return F.when(derivative, "Other").otherwise(plain)


def read_bulk_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(cik, accession, filing_date, form, document) from company JSON files with parallel arrays.

    Arrays of different lengths are padded with nulls; rows without an
    accession or of another form are dropped, files that are no JSON give none.
    """
    arrays = "accessionNumber ARRAY<STRING>, filingDate ARRAY<STRING>, form ARRAY<STRING>, primaryDocument ARRAY<STRING>"
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    main, more = F.from_json("value", f"filings STRUCT<recent: STRUCT<{arrays.replace(' ARRAY', ': ARRAY')}>>"), F.from_json("value", arrays)
    picked = raw.select(F.regexp_extract("file", r"CIK(\d{10})", 1).alias("cik"), F.coalesce(main["filings"]["recent"], more).alias("r"))
    zipped = F.arrays_zip(*(F.col(f"r.{c}") for c in ("accessionNumber", "filingDate", "form", "primaryDocument")))
    rows = picked.filter("cik != '' AND r.accessionNumber IS NOT NULL").select("cik", F.explode(zipped).alias("x")).select(
        "cik", F.col("x.accessionNumber").alias("accession"), F.try_to_date(F.col("x.filingDate"), "yyyy-MM-dd").alias("filing_date"),
        F.col("x.form").alias("form"), F.col("x.primaryDocument").alias("document"),
    )
    return rows.filter(F.col("form").isin(*OWNERSHIP_FORMS) & (F.coalesce(F.trim("accession"), F.lit("")) != ""))


def member_count(path: str) -> int:
    """How many members an archive has, that :func:`check_members` lets pass."""
    with zipfile.ZipFile(path) as z:
        return len(check_members(z))


def read_bulk_archive(spark: SparkSession, path: str, members: DataFrame | None = None) -> DataFrame:
    """(member, cik, accession, filing_date, form, document, error) of the company files in bulk archives.

    A member that does not read gives one row with ``error`` and nothing else;
    the others are not touched by it.  ``members`` (member) chooses which to
    read, as a resumed run does.
    """
    wanted = None if members is None else {r["member"] for r in members.select("member").distinct().limit(2_000_001).collect()}
    if wanted is not None and len(wanted) > 2_000_000:
        raise ValueError("more than 2,000,000 members to choose")
    names = ["member", "cik", "accession", "filing_date", "form", "document", "error"]

    def rows_of(index: int, name: str, raw: bytes) -> list[dict]:
        data = json.loads(raw)
        recent = data["filings"]["recent"] if "filings" in data else data
        columns = [recent.get(c) for c in ("accessionNumber", "filingDate", "form", "primaryDocument")]
        if not all(isinstance(c, list) for c in columns):
            raise ValueError("no parallel arrays")
        cik = re.search(r"CIK(\d{10})", name)
        out = []
        for accession, day, form, document in itertools.zip_longest(*columns):
            if form in OWNERSHIP_FORMS and isinstance(accession, str) and accession.strip():
                out.append({"member": index, "cik": cik[1] if cik else None, "accession": accession, "filing_date": day, "form": form, "document": document})
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for index, info in enumerate(check_members(z)):
                        if (wanted is not None and index not in wanted) or not re.search(r"CIK\d{10}.*\.json$", info.filename):
                            continue
                        try:
                            found = rows_of(index, info.filename, z.read(info))
                        except (ValueError, KeyError, TypeError, AttributeError, zipfile.BadZipFile) as e:
                            found = [{"member": index, "error": f"{type(e).__name__}: {e}"}]
                        yield pd.DataFrame([{c: r.get(c) for c in names} for r in found], columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(run, "member long, cik string, accession string, filing_date string, form string, document string, error string")
    return rows.withColumn("filing_date", F.try_to_date("filing_date", "yyyy-MM-dd"))


OWNER_TYPE = "struct<cik:string,name:string,officer_title:string,is_director:boolean,is_officer:boolean,is_ten_percent_owner:boolean,is_other:boolean,other_text:string>"
ROW_TYPE = (
    "struct<security:string,trade_date:string,code:string,shares:string,price:string,total:string,owned_after:string,acquired:string,direct:string,derivative:boolean,"
    "exercise_price:string,exercise_date:string,expiration_date:string,underlying_title:string,underlying_shares:string,footnote_ids:array<string>>"
)
FILING_TYPE = (
    "accession string, error string, document_type string, period string, original_date string, cik_issuer string, company string, ticker string,"
    f" owners array<{OWNER_TYPE}>, rows array<{ROW_TYPE}>, footnotes map<string,string>, remarks string, sha256 string"
)
MAX_XML_ELEMENTS = 100_000
MAX_XML_TEXT = 100_000


def decode_document(raw: bytes) -> str:
    """Text of a document in the encoding its declaration or byte order mark names, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    told = re.search(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]{1,40})[\"']", raw[:2000] if raw.lstrip().startswith(b"<?xml") else raw)
    try:
        return raw.decode(told[1].decode() if told else "utf-8", "replace")
    except LookupError:
        raise ValueError(f"unknown encoding {told[1]!r}") from None


def select_ownership_xml(text: str) -> str:
    """The ownership document inside a submission: of the documents of an ownership type, else the only one there is."""
    blocks = re.findall(r"<DOCUMENT>(.*?)</DOCUMENT>", text, re.S | re.I)
    typed = [b for b in blocks if (t := re.search(r"<TYPE>\s*([^\s<]+)", b, re.I)) and t[1].upper() in OWNERSHIP_FORMS]
    found = [m for b in typed or [text] for m in re.findall(r"<ownershipDocument\b.*?</ownershipDocument>", b, re.S)]
    if len(found) != 1:
        raise ValueError("no ownership document" if not found else "several ownership documents")
    return found[0]


def parse_ownership_xml(text: str) -> dict:
    """One ownership document, possibly inside a submission envelope; raises ValueError when unsafe or odd.

    Declarations of types and entities, and documents above the bounds of
    size, depth, elements and text are refused before the tree is built.
    """
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("document type declarations are not allowed")
    document = select_ownership_xml(text)
    if len(document) > MAX_XML_CHARS:
        raise ValueError("the ownership document is too large")
    depth = elements = 0
    for event, node in ElementTree.iterparse(io.BytesIO(document.encode()), ("start", "end")):
        depth += 1 if event == "start" else -1
        elements += event == "start"
        if depth > MAX_XML_DEPTH or elements > MAX_XML_ELEMENTS:
            raise ValueError("elements are nested too deep, or too many")
        if event == "end" and len(node.text or "") > MAX_XML_TEXT:
            raise ValueError("a text is too long")
    root = ElementTree.fromstring(document)

    def of(node: ElementTree.Element, path: str) -> str | None:
        found = node.find(path)
        text_ = "".join(found.itertext()).strip() if found is not None else ""
        return text_ or None

    def yes(node: ElementTree.Element, path: str) -> bool:
        return (of(node, path) or "").lower() in ("1", "true")

    def day(value: str | None) -> str | None:
        return (value or "")[:10] or None

    rows = []
    for tag, derivative in (("nonDerivativeTable/nonDerivativeTransaction", False), ("derivativeTable/derivativeTransaction", True)):
        for t in root.findall(tag):
            amounts, post = "transactionAmounts/", "postTransactionAmounts/"
            rows.append({
                "security": of(t, "securityTitle/value"), "trade_date": day(of(t, "transactionDate/value")),
                "code": of(t, "transactionCoding/transactionCode"), "shares": of(t, amounts + "transactionShares/value"),
                "price": of(t, amounts + "transactionPricePerShare/value"), "total": of(t, amounts + "transactionTotalValue/value"),
                "owned_after": of(t, post + "sharesOwnedFollowingTransaction/value"), "acquired": of(t, amounts + "transactionAcquiredDisposedCode/value"),
                "direct": of(t, "ownershipNature/directOrIndirectOwnership/value"), "derivative": derivative,
                "exercise_price": of(t, "conversionOrExercisePrice/value"), "exercise_date": day(of(t, "exerciseDate/value")),
                "expiration_date": day(of(t, "expirationDate/value")), "underlying_title": of(t, "underlyingSecurity/underlyingSecurityTitle/value"),
                "underlying_shares": of(t, "underlyingSecurity/underlyingSecurityShares/value"),
                "footnote_ids": list(dict.fromkeys(n.get("id", "") for n in t.iter("footnoteId") if n.get("id"))),
            })
    owners = []
    for o in root.findall("reportingOwner"):
        r = "reportingOwnerRelationship/"
        owners.append({
            "cik": of(o, "reportingOwnerId/rptOwnerCik"), "name": of(o, "reportingOwnerId/rptOwnerName"), "officer_title": of(o, r + "officerTitle"),
            "is_director": yes(o, r + "isDirector"), "is_officer": yes(o, r + "isOfficer"), "is_ten_percent_owner": yes(o, r + "isTenPercentOwner"),
            "is_other": yes(o, r + "isOther"), "other_text": of(o, r + "otherText"),
        })
    notes = {f.get("id", ""): "".join(f.itertext()).strip() for f in root.findall("footnotes/footnote")}
    if missing := {i for r in rows for i in r["footnote_ids"]} - set(notes):
        raise ValueError(f"missing footnotes {sorted(missing)}")
    return {
        "document_type": of(root, "documentType"), "period": of(root, "periodOfReport"), "original_date": of(root, "dateOfOriginalSubmission"),
        "cik_issuer": of(root, "issuer/issuerCik"), "company": of(root, "issuer/issuerName"), "ticker": of(root, "issuer/issuerTradingSymbol"),
        "owners": owners, "rows": rows, "footnotes": notes, "remarks": of(root, "remarks"), "sha256": hashlib.sha256(document.encode()).hexdigest(),
    }


def read_ownership_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a document that fails has ``error`` and nothing else."""

    def run(frames):
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", FILING_TYPE)]
        for pdf in frames:
            out = []
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = (re.search(r"\d{10}-\d{2}-\d{6}", file) or [file.rsplit("/", 1)[-1]])[0]
                try:
                    out.append({"accession": name, "error": None} | parse_ownership_xml(decode_document(raw)))
                except (ValueError, ElementTree.ParseError) as e:
                    out.append({"accession": name, "error": str(e)})
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in out], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FILING_TYPE)


def filing_outcomes(filings: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(accession_number, status, error, rows) of every document: success, permanent_failure, or unsupported for filings without transactions."""
    kind = F.upper(F.coalesce("document_type", F.lit("")))
    status = F.when(F.col("error").isNotNull(), "permanent_failure").when(~kind.isin(*TRANSACTION_FORMS), "unsupported").otherwise("success")
    out = filings.select(F.col("accession").alias("accession_number"), status.alias("status"), "error", F.coalesce(F.size("rows"), F.lit(0)).alias("rows"))
    if ledger is None:
        return out
    done = ledger.filter(F.col("status").isin("success", "permanent_failure", "unsupported")).select("accession_number")
    return out.join(done, "accession_number", "left_anti")


def explode_filings(filings: DataFrame) -> DataFrame:
    """Transactions of parsed documents in the columns of the US model, with their detail object."""
    rows = filings.filter("error IS NULL").select("*", F.posexplode("rows").alias("i", "r"))
    number = lambda c: F.col(f"r.{c}").try_cast("double")
    value = derived_value(number("shares"), number("price"), number("total"))
    owner = F.get("owners", F.lit(0))
    ids = F.col("r.footnote_ids")
    used = F.map_filter("footnotes", lambda k, v: F.array_contains(ids, k))
    detail = F.to_json(F.struct(
        F.lit(True).alias("narrative_complete"), "remarks", ids.alias("footnote_ids"), used.alias("footnotes"), F.col("r.security").alias("security_title"),
        F.col("r.exercise_date").alias("exercise_date"), F.col("r.expiration_date").alias("expiration_date"), F.col("r.exercise_price").alias("conversion_or_exercise_price"),
        F.col("r.underlying_title").alias("underlying_security_title"), F.col("owners").alias("reporting_owners"),
    ))
    title = insider_title(*(owner[c] for c in ("officer_title", "is_director", "is_officer", "is_ten_percent_owner", "is_other", "other_text")))
    missing = {c: number(n).isNull() for c, n in (("shares", "shares"), ("price", "price"), ("shares_owned_after", "owned_after"))}
    return rows.select(
        F.col("accession").alias("accession_number"), "accession", "document_type", F.col("document_type").alias("form_type"), normalize_cik(F.col("cik_issuer")).alias("cik_issuer"),
        normalize_cik(owner["cik"]).alias("cik_insider"), "company", normalize_issuer_symbol(F.col("ticker")).alias("ticker"), owner["name"].alias("insider_name"), title.alias("insider_title"),
        F.concat(F.when(F.col("r.derivative"), "derivative:").otherwise("non-derivative:"), F.col("i").cast("string")).alias("sec_row_id"),
        F.try_to_date(F.col("r.trade_date"), "yyyy-MM-dd").alias("trade_date"), trade_type(F.col("r.code"), F.col("r.derivative")).alias("trade_type"),
        F.coalesce(number("shares"), F.lit(0.0)).alias("shares"), F.coalesce(number("price"), F.lit(0.0)).alias("price"), F.coalesce(value["value"], F.lit(0.0)).alias("value"),
        F.coalesce(number("owned_after"), F.lit(0.0)).alias("shares_owned_after"), *(m.alias(f"{c}_missing") for c, m in missing.items()), value["value"].isNull().alias("value_missing"),
        value["error"].alias("row_error"), F.col("r.derivative").alias("is_derivative"), F.endswith(F.coalesce("document_type", F.lit("")), F.lit("/A")).alias("is_amendment"),
        F.try_to_date(F.substring("period", 1, 10), "yyyy-MM-dd").alias("period_of_report"), F.try_to_date(F.substring("original_date", 1, 10), "yyyy-MM-dd").alias("original_submission_date"),
        F.coalesce("r.code", F.lit("")).alias("transaction_code"), F.coalesce("r.acquired", F.lit("")).alias("acquired_disposed"), F.coalesce("r.direct", F.lit("")).alias("direct_or_indirect"),
        F.col("sha256").alias("document_sha256"), detail.alias("sec_detail_json"), F.lit("sec_edgar").alias("source"),
    )


def read_house_index(spark: SparkSession, path: str) -> DataFrame:
    """Yearly index of representatives' filings."""
    kind = "Prefix STRING, Last STRING, First STRING, Suffix STRING, FilingType STRING, StateDst STRING, Year STRING, FilingDate STRING, DocID STRING"
    df = spark.read.format("xml").option("rowTag", "Member").schema(kind).load(path)
    return df.select(
        F.concat_ws(" ", "First", "Last").alias("official_name"), F.col("FilingType").alias("filing_type"), F.col("StateDst").alias("district"),
        F.coalesce(F.try_to_date("FilingDate", "M/d/yyyy"), F.try_to_date("FilingDate", "yyyy-MM-dd")).alias("filing_date"), F.col("DocID").alias("doc_id"),
    ).filter("coalesce(doc_id, '') != ''")
