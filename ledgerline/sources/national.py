"""Readers of national registers, Senate reports and the second US screener, from landed pages, texts and JSON.

Each takes a DataFrame of raw content and returns typed rows; what cannot be
read comes back as a row with ``error`` where the source tells rows apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import localized as loc
from ledgerline.functions.text import classify_trade, congress_owner, congress_type, extract_ticker, amount_range, normalize_position, parse_date, parse_number, strip

# Names under which registers and forms give a field, first come first.
DUTCH_FIELDS = {
    "isin": ("isin", "ISIN"), "position": ("function", "position", "functie"), "insider_name": ("personName", "name", "naam", "managerName"),
    "issuer_name": ("issuerName", "emittent", "uitgevende", "companyName"), "volume": ("volume", "aantal", "quantity"),
    "price": ("price", "prijs", "unitPrice"), "total": ("totalValue", "totaalBedrag", "amount"), "currency": ("currency", "valuta"),
    "kind": ("transactionType", "typeTransactie", "nature"), "instrument_type": ("instrumentType", "typeInstrument", "financialInstrument"),
    "url": ("url", "sourceUrl", "link"), "traded": ("transactionDate", "datumTransactie"), "filed": ("publicationDate", "datumPublicatie"),
}
FRENCH_LABELS = {
    "insider_and_position": r"NOM\s*/\s*FONCTION[^:\n]*:\s*(.+)", "issuer_name": r"NOM\s*:\s*(.+)", "lei": r"LEI\s*:\s*([A-Z0-9]{18,20})",
    "traded": r"DATE DE LA TRANSACTION\s*:\s*(.+)", "kind": r"NATURE DE LA TRANSACTION\s*:\s*(.+)",
    "instrument_type": r"DESCRIPTION DE L.INSTRUMENT[^:\n]*:\s*(.+)", "isin": r"CODE D.IDENTIFICATION[^:\n]*:\s*([A-Z]{2}[A-Z0-9]{10})",
    "price": r"PRIX(?: UNITAIRE)?\s*:\s*([0-9\s.,]+(?:Euro|EUR|€|GBP|USD)?)", "volume": r"VOLUME\s*:\s*([0-9 .,\x{A0}]+)", "filed": r"DATE DE RECEPTION[^:\n]*:\s*(.+)",
}
UK_LABELS = {
    "position": "position", "status": "position", "description of the financial": "instrument", "identification code": "instrument",
    "nature of the transaction": "kind", "price": "price", "volume": "price", "date of the transaction": "traded", "place of the transaction": "place", "lei": "lei",
}
GERMAN_FIELDS = {
    "insider_name": ("Meldepflichtiger", "Mitteilungspflichtiger", "Name"), "issuer_name": ("Emittent", "Issuer"), "isin": ("ISIN",),
    "position": ("Position / Status", "Position", "Status"), "instrument_type": ("Art des Instruments", "Instrument"), "kind": ("Art des Geschäfts", "Geschäftsart"),
    "price": ("Durchschnittspreis", "Preis"), "volume": ("Aggregiertes Volumen", "Volumen"), "traded": ("Datum des Geschäfts", "Handelstag"), "filed": ("Datum der Aktivierung", "Mitteilungsdatum"),
}
SCREENER_WORDS = (
    ("transaction", "transaction"), ("reported", "reported"), ("company", "company"), ("symbol", "symbol"), ("insider", "insider"), ("relationship", "insider"),
    ("traded", "shares"), ("price", "price"), ("amount", "value"), ("total", "value"), ("owned", "owned"), ("filing", "filing"),
)
SCREENER_NEEDED = ("transaction", "reported", "insider", "shares")


class PageTables(HTMLParser):
    """Tables of a page as rows of cells; a cell knows its parts between ``<br>``, its class, links and marked spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: dict | None = None
        self.meta: dict[str, str] = {}
        self.text: list[str] = []
        self.inside: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name"):
            self.meta[a["name"]] = a.get("content", "")
        elif tag == "table":
            table = {"id": a.get("id", ""), "class": a.get("class", "").split(), "rows": []}
            self.tables.append(table)
            self.open.append(table)
            self.cell = None
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
            self.cell = None
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.cell = {"tag": tag, "class": a.get("class", ""), "parts": [""], "links": [], "spans": {}}
            self.open[-1]["rows"][-1].append(self.cell)
            self.inside = []
        elif self.cell is not None:
            if tag == "br":
                self.cell["parts"].append("")
            elif tag == "a":
                self.cell["links"].append([a.get("href", ""), ""])
                self.inside.append((tag, ""))
            elif tag == "span":
                self.inside.append((tag, a.get("class", "")))

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
            self.cell = None
        elif tag in ("td", "th"):
            self.cell = None
        elif self.inside and self.inside[-1][0] == tag:
            self.inside.pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.cell is None:
            return
        self.cell["parts"][-1] += data
        for tag, name in self.inside:
            if tag == "a" and self.cell["links"]:
                self.cell["links"][-1][1] += data
            elif tag == "span":
                self.cell["spans"][name] = self.cell["spans"].get(name, "") + data


def _flat(text: str) -> str:
    return " ".join(text.split())


def _parts(cell: dict | None) -> list[str]:
    return [p for p in map(_flat, cell["parts"]) if p] if cell else []


def _whole(cell: dict | None) -> str:
    return _flat(" ".join(cell["parts"])) if cell else ""


def _read(page: str | None) -> PageTables:
    reader = PageTables()
    reader.feed(page or "")
    reader.close()
    return reader


def _map_pages(pages: DataFrame, key: str, html: str, columns: Mapping[str, str], parse: Callable[[str | None], list[dict]]) -> DataFrame:
    """(key, columns...) of every record ``parse`` finds in a page."""
    names = ["key", *columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [{"key": k} | r for k, page in zip(pdf["key"], pdf["page"], strict=True) for r in parse(page)]
            yield pd.DataFrame([{c: r.get(c) for c in names} for r in out], columns=names, dtype=object)

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).cast("string").alias("page"))
    return rows.mapInPandas(run, "key string, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


# Second US screener


def _compound_rows(page: str | None) -> list[dict]:
    reader = _read(page)
    table = next((t for t in reader.tables if t["id"] == "filing_table"), None)
    if table is None or not table["rows"]:
        return [{"error": "missing_trade_table"}]
    at: dict[str, int] = {}
    for i, cell in enumerate(table["rows"][0]):
        name = next((field for word, field in SCREENER_WORDS if word in _whole(cell).lower()), None)
        if name:
            at.setdefault(name, i)
    if not set(SCREENER_NEEDED) <= set(at):
        return [{"error": "missing_trade_headers"}]
    out = []
    for row in table["rows"][1:]:
        if not row or (len(row) == 1 and re.search(r"\bno (data|results|matching|transactions)\b", _whole(row[0]).lower())):
            continue
        if len(row) <= max(at[f] for f in SCREENER_NEEDED):
            out.append({"error": "malformed_trade_row"})
            continue
        cell = lambda f: row[at[f]] if f in at and at[f] < len(row) else None  # noqa: B023, E731
        deal, seen, who, filed = _parts(cell("transaction")), _parts(cell("reported")), cell("insider"), cell("filing")
        name = next((_flat(t) for _, t in who["links"] if _flat(t)), "")
        title, lines = _flat(who["spans"].get("pos", "")), _parts(who)
        if not name:
            name, title = (lines[0] if lines else ""), (lines[1] if len(lines) > 1 else title)
        out.append({
            "traded": deal[0] if deal else "", "kind": deal[1] if len(deal) > 1 else "", "css": cell("transaction")["class"], "reported": seen[0] if seen else "",
            "company": _whole(cell("company")), "symbol": _whole(cell("symbol")), "insider_name": name, "insider_title": title, "shares": _whole(cell("shares")),
            "price": _whole(cell("price")), "value": _whole(cell("value")), "owned": (_parts(cell("owned")) or [""])[0],
            "link": next((h for h, _ in filed["links"] if h), "") if filed else "",
        })
    return out


def read_compound_screener(pages: DataFrame, key: str = "ticker", html: str = "html", site: str = "") -> DataFrame:
    """Trades of the screener whose cells hold several facts; ``key`` is the ticker that was asked for.

    A page without its table or headings, and a row without name, ticker or
    dates, come back with ``error``.  The class of the first cell tells the
    kind where its text does not.  Relative links get ``site`` before them.
    """
    text = "traded kind css reported company symbol insider_name insider_title shares price value owned link error".split()
    rows = _map_pages(pages, key, html, dict.fromkeys(text, "string"), _compound_rows)
    kind = classify_trade(F.col("kind"))
    hint = F.when(F.contains("css", F.lit("S")), "Sell").when(F.contains("css", F.lit("P")), "Buy").when(F.contains("css", F.lit("M")), "Exercise").otherwise("Other")
    ticker = F.upper(F.when(F.coalesce("symbol", F.lit("")) != "", F.col("symbol")).otherwise(F.col("key")))
    out = rows.select(
        ticker.alias("ticker"), "company", "insider_name", "insider_title", F.when(kind == "Other", hint).otherwise(kind).alias("trade_type"),
        parse_date(F.col("traded")).alias("trade_date"), parse_date(F.col("reported")).alias("filing_date"), *(parse_number(F.col(c)).alias(c) for c in ("shares", "price", "value")),
        parse_number(F.col("owned")).alias("shares_owned_after"), F.lit("secform4").alias("source"),
        F.when(F.startswith("link", F.lit("/")), F.concat(F.lit(site), "link")).otherwise(F.col("link")).alias("url"), "error",
    )
    whole = (F.coalesce("insider_name", F.lit("")) != "") & F.col("trade_date").isNotNull() & F.col("filing_date").isNotNull() & (F.coalesce("ticker", F.lit("")) != "")
    return out.withColumn("error", F.coalesce("error", F.when(~whole, "malformed_trade_row")))


# Senate


def read_senate_search(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Reports from search answers whose rows are [first name, last name, filer, link, day]; rows of another length or without a link are left out."""
    row = F.explode(F.from_json(F.col(json_col), "data ARRAY<ARRAY<STRING>>")["data"])
    rows = raw.select(row.alias("r")).filter(F.size("r") >= 5)
    link = F.col("r")[3]
    href = F.regexp_extract(link, r"""<a\s[^>]*href\s*=\s*["']([^"']*)["']""", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(link, r"(?s)<a\b[^>]*>(.*?)</a>", 1), r"<[^>]*>", ""), r"\s+", " "))
    plain = F.trim(F.regexp_replace("report_title", r"(?i)\(\s*amendment\s*\)", ""))
    day = lambda c: F.try_to_date(c, "MM/dd/yyyy")
    out = rows.select(
        F.trim(F.col("r")[0]).alias("first_name"), F.trim(F.col("r")[1]).alias("last_name"), F.trim(F.col("r")[2]).alias("filer_type"), title.alias("report_title"),
        href.alias("report_url"), parse_date(F.col("r")[4]).alias("filing_date"), F.contains(link, F.lit("<a")).alias("linked"),
    ).filter("linked")
    return out.drop("linked").withColumns({
        "is_amendment": F.col("report_title").rlike(r"(?i)\(\s*amendment\s*\)"),
        "period_of_report": day(F.nullif(F.regexp_extract(plain, r"(?i)\bfor\s+(\d{2}/\d{2}/\d{4})\s*$", 1), F.lit(""))),
        "report_uuid": F.regexp_extract("report_url", r"/search/view/ptr/([a-f0-9-]+)/", 1),
        "is_paper": F.contains("report_url", F.lit("/search/view/paper/")),
    })


def _senate_columns(head: list[str]) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, h in enumerate(x.lower() for x in head):
        plain = {"#": "row", "id": "row", "owner": "owner", "ticker": "ticker", "type": "kind", "amount": "amount", "comment": "comment"}.get(h)
        both = next((f for words, f in ((("transaction", "date"), "traded"), (("asset", "name"), "asset"), (("asset", "type"), "asset_type")) if all(w in h for w in words)), None)
        if plain or both:
            at[plain or both] = i
    return at


def _senate_rows(page: str | None) -> list[dict]:
    reader = _read(page)
    words = [" ".join(_whole(c) for row in t["rows"] for c in row).lower() for t in reader.tables]
    table = next((t for t, w in zip(reader.tables, words, strict=True) if "asset" in w and any(x in w for x in ("transaction", "amount", "type"))), None)
    if table is None:
        empty = "no transactions to display" in _flat(" ".join(reader.text)).lower()
        return [] if empty else [{"error": "ptr_layout"}]
    at = _senate_columns([_whole(c) for c in table["rows"][0]])
    if not {"traded", "asset", "kind", "amount"} <= set(at):
        return [{"error": "ptr_headers"}]
    out = []
    for number, row in enumerate(table["rows"][1:], 1):
        if not any(c["tag"] == "td" for c in row):
            continue
        got = {f: _whole(row[i]) if i < len(row) else "" for f, i in at.items()}
        if got["asset"]:
            out.append(got | {"row": got.get("row") or f"row:{number}"})
        elif any(map(_whole, row)):
            out.append({"error": "ptr_row"})
    return out


def read_senate_reports(pages: DataFrame, key: str = "report_uuid", html: str = "html") -> DataFrame:
    """Transactions of periodic reports; a report without a table or its headings, and a row without an asset, come back with ``error``."""
    rows = _map_pages(pages, key, html, dict.fromkeys("row traded owner ticker asset asset_type kind amount comment error".split(), "string"), _senate_rows)
    r, listed = amount_range(F.col("amount")), F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    return rows.select(
        F.col("key").alias("doc_id"), F.col("row").alias("source_row_id"), parse_date(F.col("traded")).alias("trade_date"), congress_owner(F.col("owner")).alias("owner"),
        F.when(listed.isin("", "--", "-", "N/A"), extract_ticker(F.col("asset"))).otherwise(listed).alias("ticker"), F.col("asset").alias("asset_description"), "asset_type",
        congress_type(F.col("kind")).alias("trade_type"), F.col("amount").alias("amount_range"), r["low"].alias("amount_low"), r["high"].alias("amount_high"), "comment",
        F.lit("senate").alias("source"), "error",
    )


def house_transactions(tables: DataFrame) -> DataFrame:
    """Transactions of representatives' reports whose tables were extracted: (doc_id, page, row, cells as a map by heading).

    A scanned report has no cells at all and comes back as ``unsupported``; a
    row without an asset or without a day is an error of its page alone.
    """
    names = F.transform(F.map_keys("cells"), lambda k: F.lower(F.regexp_replace(k, r"\s+", " ")))
    cells = F.map_from_arrays(names, F.map_values("cells"))
    cell = lambda *words: F.coalesce(*(F.nullif(strip(F.try_element_at(cells, F.lit(w))), F.lit("")) for w in words), F.lit(""))
    r = amount_range(cell("amount"))
    out = tables.select(
        "doc_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(":"), F.col("row").cast("string")).alias("source_row_id"), congress_owner(cell("owner")).alias("owner"),
        cell("asset", "asset name", "description").alias("asset_description"), congress_type(cell("transaction type", "type")).alias("trade_type"),
        parse_date(cell("date", "transaction date")).alias("trade_date"), cell("amount").alias("amount_range"), r["low"].alias("amount_low"), r["high"].alias("amount_high"),
        F.coalesce(F.col("cells").isNull() | (F.size("cells") == 0), F.lit(True)).alias("scanned"),
    )
    broken = (F.col("asset_description") == "") | F.col("trade_date").isNull()
    out = out.withColumn("error", F.when(F.col("scanned"), "unsupported").when(broken, "ptr_row")).drop("scanned")
    return out.withColumns({"ticker": extract_ticker(F.col("asset_description")), "source": F.lit("house")})


# Europe


def _eu(country: str, body: str, source: str, **columns: Column) -> list[Column]:
    fixed = {"country": F.lit(country), "regulatory_body": F.lit(body), "source": F.lit(source)}
    order = "isin issuer_name country regulatory_body insider_name position trade_date filing_date trade_type instrument_type volume price currency total_value source url error".split()
    have = fixed | columns
    return [have.get(c, F.lit(None).cast("string")).alias(c) for c in order]


def read_dutch_json(raw: DataFrame, json_col: str = "value", isin: str = "") -> DataFrame:
    """Trades from answers of the Dutch register, an array of objects or one object."""
    text = F.col(json_col)
    listed = F.coalesce(F.from_json(text, "ARRAY<STRING>"), F.array(text))
    rows = raw.select(F.explode(listed).alias("j"))
    value = lambda f: F.coalesce(*(F.nullif(F.trim(F.get_json_object("j", f"$.{name}")), F.lit("")) for name in DUTCH_FIELDS[f]))
    number = lambda f: loc.dutch_number(value(f))
    rows = rows.select(*(value(f).alias(f) for f in DUTCH_FIELDS if f not in ("volume", "price", "total")), *(number(f).alias(f) for f in ("volume", "price", "total")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(*_eu(
        "NL", "AFM", "afm", isin=F.coalesce("isin", F.lit(isin)), issuer_name=blank("issuer_name"), insider_name=blank("insider_name"), position=normalize_position(F.col("position")),
        trade_date=loc.dutch_date(F.col("traded")), filing_date=loc.dutch_date(F.col("filed")), trade_type=loc.dutch_type(F.col("kind")),
        instrument_type=F.coalesce("instrument_type", F.lit("Share")), volume=F.col("volume"), price=F.col("price"), currency=F.coalesce("currency", F.lit("EUR")),
        total_value=F.coalesce("total", F.col("volume") * F.col("price")), url=blank("url"),
    ))


def read_french_texts(texts: DataFrame, text_col: str = "text", published: str | None = None, url: str | None = None) -> DataFrame:
    """Trades from the extracted texts of French declarations, one each; a text without a person has ``error``."""
    lines = F.array_join(F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"\R"), strip), lambda x: x != ""), "\n")
    rows = texts.withColumn("_t", lines)
    field = {f: F.trim(F.regexp_extract("_t", f"(?i){pattern}", 1)) for f, pattern in FRENCH_LABELS.items()}
    rows = rows.withColumns({f"_{f}": c for f, c in field.items()})
    cut = F.regexp_extract("_insider_and_position", r"^(.*),([^,]*)$", 0) != ""
    who = F.when(cut, F.regexp_extract("_insider_and_position", r"^(.*),([^,]*)$", 1)).otherwise(F.col("_insider_and_position"))
    role = F.when(cut, F.regexp_extract("_insider_and_position", r"^(.*),([^,]*)$", 2)).otherwise("")
    deal = loc.french_price(F.col("_price"))
    volume = loc.french_number(F.nullif("_volume", F.lit("")))
    filed = loc.french_date(F.col("_filed"))
    if published:
        filed = F.coalesce(F.try_to_date(F.substring(F.col(published).cast("string"), 1, 10), "yyyy-MM-dd"), filed)
    return rows.select(*_eu(
        "FR", "AMF", "amf", isin=F.col("_isin"), issuer_name=F.col("_issuer_name"), insider_name=F.trim(who), position=normalize_position(role),
        trade_date=loc.french_date(F.col("_traded")), filing_date=filed, trade_type=loc.french_type(F.col("_kind")),
        instrument_type=F.coalesce(F.nullif("_instrument_type", F.lit("")), F.lit("Share")), volume=volume, price=deal["price"], currency=deal["currency"],
        total_value=loc.money_total(volume, deal["price"]), url=F.col(url) if url else F.lit(""), error=F.when(F.trim(who) == "", "missing_person"),
    ))


def _announcement(page: str | None) -> list[dict]:
    reader = _read(page)
    if not reader.tables:
        return [{"error": "missing_form"}]
    got: dict[str, str] = {"filed": reader.meta.get("dateCreated", "")[:10]}
    section = 0
    for row in reader.tables[0]["rows"]:
        cells = [_whole(c) for c in row]
        if len(cells) < 2:
            continue
        if cells[0] in ("1", "2", "3", "4"):
            section = int(cells[0])
            continue
        label, value = (cells[1], cells[2]) if len(cells) > 2 else (cells[0], cells[1])
        label = label.lower()
        if not value:
            continue
        if "name" in label and len(label) < 10:
            got |= {"insider_name": value} if section == 1 else {"issuer_name": value} if section == 3 else {}
            continue
        field = next((f for words, f in UK_LABELS.items() if words in label), None)
        if field == "instrument":
            code = re.search(r"ISIN[\s:]+([A-Z]{2}[A-Z0-9]{10})\b", value) or re.search(r"\b([A-Z]{2}[A-Z0-9]{10})\b", value)
            if code:
                got["isin"] = code[1]
        if field:
            got[field] = value
    return [got if got.get("insider_name") else {"error": "missing_person"}]


def read_uk_announcements(pages: DataFrame, url: str = "url", html: str = "html", isin: str = "") -> DataFrame:
    """Trades from announcement pages with the standard form; the names in it belong to person or issuer by their section."""
    rows = _map_pages(pages, url, html, dict.fromkeys("insider_name issuer_name position instrument isin kind price traded place lei filed error".split(), "string"), _announcement)
    deal = loc.uk_price_volume(F.col("price"))
    before = F.when(F.col("isin").isNotNull(), F.regexp_replace(F.split_part("instrument", "isin", F.lit(1)), r"[\s,;:]+$", "")).otherwise(F.col("instrument"))
    shown = strip(F.regexp_replace(before, r"(?i)\s+(attached|isin|code)\s*$", ""))
    return rows.select(*_eu(
        "UK", "FCA", "rns", isin=F.coalesce("isin", F.lit(isin)), issuer_name=F.coalesce("issuer_name", F.lit("")), insider_name=F.col("insider_name"), position=normalize_position(F.col("position")),
        trade_date=loc.uk_date(F.col("traded")), filing_date=F.try_to_date("filed", "yyyy-MM-dd"), trade_type=loc.uk_type(F.col("kind")),
        instrument_type=F.coalesce(F.nullif(shown, F.lit("")), F.lit("Equity")), volume=deal["volume"], price=deal["price"],
        currency=F.coalesce(F.nullif(deal["currency"], F.lit("")), F.lit("GBP")), total_value=loc.money_total(deal["volume"], deal["price"]), url=F.col("key"), error=F.col("error"),
    ))


def _german_number(c: Column) -> Column:
    """1.234,56 and 1234.56 with a currency behind them."""
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d[\d.,\s]*)", 1)
    comma = F.regexp_replace(F.regexp_replace(digits, r"[.\s]", ""), ",", ".")
    plain = F.regexp_replace(digits, r"[,\s]", "")
    grouped = F.contains(digits, F.lit(",")) | digits.rlike(r"^\d{1,3}(\.\d{3})+$")
    return F.when(grouped, comma).otherwise(plain).try_cast("double")


def _german_rows(page: str | None) -> list[dict]:
    for table in _read(page).tables:
        head = [_whole(c).lower() for c in table["rows"][0]] if table["rows"] else []
        at = {f: next((i for n in names for i, h in enumerate(head) if h == n.lower()), None) for f, names in GERMAN_FIELDS.items()}
        if at["insider_name"] is not None and at["isin"] is not None:
            body = [row for row in table["rows"][1:] if any(c["tag"] == "td" for c in row)]
            return [{f: _whole(row[i]) for f, i in at.items() if i is not None and i < len(row)} for row in body]
    return [{"error": "missing_table"}]


def _german_trades(rows: DataFrame, error: Column) -> DataFrame:
    price, volume = _german_number(F.col("price")), _german_number(F.col("volume"))
    currency = F.regexp_extract(F.coalesce("price", F.lit("")), r"\b([A-Z]{3})\b", 1)
    # The register reports a volume in money, so shares follow from the price.
    return rows.select(*_eu(
        "DE", "BaFin", "bafin", isin=F.upper(F.trim("isin")), issuer_name=F.trim("issuer_name"), insider_name=F.trim("insider_name"), position=normalize_position(F.col("position")),
        trade_date=loc.german_date(F.col("traded")), filing_date=loc.german_date(F.col("filed")), trade_type=loc.german_type(F.col("kind")),
        instrument_type=loc.german_instrument(F.col("instrument_type")), volume=F.when(price > 0, volume / price), price=price,
        currency=F.when(currency != "", currency).otherwise("EUR"), total_value=volume, url=F.lit(""), error=error,
    ))


def read_german_pages(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Trades from result pages of the German register."""
    rows = _map_pages(pages, key, html, dict.fromkeys([*GERMAN_FIELDS, "error"], "string"), _german_rows)
    return _german_trades(rows, F.col("error"))


def german_register(table: DataFrame) -> DataFrame:
    """Trades from the register's ``;``-separated export, read with :func:`ledgerline.sources.tables.read_register_csv` and ``GERMAN_FIELDS``."""
    return _german_trades(table, F.when(F.coalesce(F.trim("insider_name"), F.lit("")) == "", "missing_person"))
