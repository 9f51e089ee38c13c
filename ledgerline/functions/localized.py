"""Column functions over national registers, filing details and reporting calendars; all stay inside the JVM."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import NUMBER, normalize_cik, strip

# French month names, words of transaction kinds in the order they are tried, currencies by sign.
FRENCH_MONTHS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
FRENCH_TYPES = {"acquisition": "Buy", "achat": "Buy", "cession": "Sell", "vente": "Sell", "exercice": "Buy", "attribution": "Buy"}
GERMAN_TYPES = {"kauf": "Buy", "verkauf": "Sell"}
GERMAN_INSTRUMENTS = {"aktie": "Share", "schuldtitel": "Debt Instrument", "derivat": "Derivative", "option": "Option", "zertifikat": "Certificate"}
UK_TYPES = {"Buy": ("acqui", "purchas", "buy", "bought", "award", "vest", "exercise"), "Sell": ("dispos", "sale", "sold", "sell")}
DUTCH_TYPES = {"Sell": ("verkoop", "sell", "disposal", "sale"), "Buy": ("koop", "buy", "purchase", "acquisition")}
FRENCH_CURRENCIES = {"euro": "EUR", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP", "usd": "USD", "$": "USD"}
SIGNS = {"€": "EUR", "£": "GBP", "$": "USD", "¥": "JPY"}
#: First day that quarterly data sets cover.
DATASET_START = date(2006, 1, 1)


def _first_word(text: Column, table: dict[str, str], default: str) -> Column:
    """The value of the first word of a table that a text holds."""
    out = None
    for word, value in table.items():
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def _lower(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _dates(c: Column, formats: dict[str, str]) -> Column:
    """The first format (pattern to date format) that a text fits."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(s.rlike(f"^{pattern}$"), F.try_to_date(s, form)) for pattern, form in formats.items()))


_ISO = {r"\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d"}


def german_date(c: Column) -> Column:
    """``DD.MM.YYYY``, also with a time behind it, or ISO."""
    day = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{1,2}\.\d{1,2}\.\d{4})(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?\s*$", 1)
    return F.coalesce(_dates(day, {r"\d{1,2}\.\d{1,2}\.\d{4}": "d.M.yyyy"}), _dates(c, _ISO))


def german_type(c: Column) -> Column:
    t = _lower(c)
    return reduce(lambda out, kv: out.when(t == kv[0], kv[1]), GERMAN_TYPES.items(), F.when(F.lit(False), "")).otherwise("Other")


def german_instrument(c: Column) -> Column:
    """English kind of an instrument; unknown ones stay as they are."""
    t = _lower(c)
    known = reduce(lambda out, kv: out.when(t == kv[0], kv[1]), GERMAN_INSTRUMENTS.items(), F.when(F.lit(False), ""))
    return known.otherwise(strip(F.coalesce(c, F.lit(""))))


def french_date(c: Column) -> Column:
    """ISO, also with more behind it, or day, month name and year."""
    t = _lower(c)
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})\s+(\p{L}+)\s+(\d{4})", k)
    months = F.create_map(*(F.lit(x) for kv in FRENCH_MONTHS.items() for x in kv))
    month = F.try_element_at(months, part(2))
    named = F.when(month.isNotNull(), F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(1)), "yyyy-M-d"))
    return F.coalesce(_dates(F.substring(t, 1, 10), {r"\d{4}-\d{2}-\d{2}": "yyyy-MM-dd"}), named)


def french_type(c: Column) -> Column:
    return _first_word(_lower(c), FRENCH_TYPES, "Other")


def french_number(c: Column) -> Column:
    """Digits with , or . before the decimals; spaces group. Null when there is no number."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.,]", ""), ",", ".")
    return F.when(digits.rlike(NUMBER), digits.try_cast("double"))


def french_price(c: Column) -> Column:
    """struct(price, currency); euros without a sign."""
    return F.struct(french_number(c).alias("price"), _first_word(_lower(c), FRENCH_CURRENCIES, "EUR").alias("currency"))


def uk_date(c: Column) -> Column:
    return _dates(c, {
        r"\d{1,2} [A-Za-z]+ \d{4}": "d MMMM yyyy", r"[A-Za-z]+ \d{1,2}, \d{4}": "MMMM d, yyyy", **_ISO,
        r"\d{1,2}/\d{1,2}/\d{4}": "d/M/yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}": "d.M.yyyy",
    })


def _by_words(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return _first_word(_lower(c), {word: kind for kind, words in table.items() for word in words}, "Other")


def uk_type(c: Column) -> Column:
    return _by_words(c, UK_TYPES)


def uk_price_volume(c: Column) -> Column:
    """struct(price, volume, currency) of a cell with both; the first number is the price, spaces group digits."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), " ", " ")
    found = F.transform(
        F.regexp_extract_all(s, F.lit(r"(\d[\d\s]*(?:[,.]\d+)?)"), 1),
        lambda n: F.replace(F.regexp_replace(n, r"\s", ""), F.lit(","), F.lit(".")).try_cast("double"),
    )
    found = F.filter(found, lambda n: n.isNotNull())
    sign = F.regexp_extract(s, "[€£$¥]", 0)
    currency = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), sign), F.lit(""))
    return F.struct(F.get(found, F.lit(0)).alias("price"), F.get(found, F.lit(1)).alias("volume"), currency.alias("currency"))


def dutch_date(c: Column) -> Column:
    day = F.regexp_extract(F.coalesce(c, F.lit("")), r"^[^T]*", 0)
    return _dates(day, {**_ISO, r"\d{1,2}-\d{1,2}-\d{4}": "d-M-yyyy", r"\d{1,2}/\d{1,2}/\d{4}": "d/M/yyyy"})


def dutch_type(c: Column) -> Column:
    """A sale ("verkoop") holds the word for a purchase ("koop"), so sales are tried first."""
    return _by_words(c, DUTCH_TYPES)


def dutch_number(c: Column) -> Column:
    s = F.replace(c, F.lit(","), F.lit("."))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def money_total(volume: Column, price: Column) -> Column:
    """Volume times price in decimal, rounded half up to cents."""
    return F.round(volume.cast("decimal(18,6)") * price.cast("decimal(18,6)"), 2).cast("double")


# Filing details


def decimal_text(c: Column) -> Column:
    """One spelling for equal decimal numbers: without leading signs, zeros and empty decimals; other texts stay."""
    s = strip(c.cast("string"))
    number = F.when(s.rlike(NUMBER), s.try_cast("decimal(38,12)"))
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(shown == "-0", "0").otherwise(shown), s)


def insider_title(officer_title: Column, director: Column, officer: Column, ten_percent: Column, other: Column, other_text: Column) -> Column:
    """Roles as one text; an officer with a title shows it."""
    titled = F.coalesce(officer_title, F.lit("")) != ""
    return F.concat_ws(
        ", ", F.when(titled, officer_title), F.when(director, "Director"), F.when(officer & ~titled, "Officer"), F.when(ten_percent, "10% Owner"),
        F.when(other, F.when(F.coalesce(other_text, F.lit("")) != "", other_text).otherwise("Other")),
    )


_ROLES = {"is_director": "DIRECTOR", "is_officer": "OFFICER", "is_ten_percent_owner": r"TEN\s*PERCENT\s*OWNER|10\s*%\s*OWNER", "is_other": "OTHER"}


def relationship_roles(c: Column) -> Column:
    """struct of role flags and ``error``: a text that names no role, or holds anything besides roles and separators."""
    up = F.upper(F.coalesce(c, F.lit("")))
    # An owner of ten percent is no "other", and an officer no director: roles are cut out from the longest on.
    order = ("is_ten_percent_owner", "is_officer", "is_director", "is_other")
    rest, flags = up, {}
    for role in order:
        flags[role] = rest.rlike(_ROLES[role])
        rest = F.regexp_replace(rest, _ROLES[role], " ")
    none = ~reduce(lambda a, b: a | b, flags.values())
    odd = F.regexp_replace(rest, r"[\s,;|/]+", "") != ""
    error = F.when(none, "no known role").when(odd, "unknown role")
    return F.struct(*(flags[r].alias(r) for r in _ROLES), error.alias("error"))


def derived_value(shares: Column, price: Column, total: Column) -> Column:
    """struct(value, error): shares times price where both are known, else the reported total."""
    value = F.coalesce(shares * price, total)
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.struct(F.when(~odd, value).alias("value"), F.when(odd, "value is not finite").alias("error"))


def provenance_of(json: Column, source: Column) -> Column:
    """Sources a row came from; text that is no JSON array leaves the row's own."""
    listed = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_append(F.filter(listed, lambda x: x.isNotNull()), source)))


DETAIL = (
    "narrative_complete BOOLEAN, remarks STRING, footnote_ids ARRAY<STRING>, footnotes MAP<STRING, STRING>, security_title STRING,"
    " exercise_date STRING, expiration_date STRING, conversion_or_exercise_price STRING, underlying_security_title STRING,"
    " reporting_owners ARRAY<STRUCT<cik: STRING>>"
)


def detail_of(json: Column) -> Column:
    """The detail object of a filing row; null for anything else."""
    return F.from_json(json, DETAIL)


def owner_ciks(detail: Column, cik: Column) -> Column:
    """Sorted owners of a filing row: all listed ones if every one is valid, else none; without a list the row's own."""
    listed = F.transform(detail["reporting_owners"], lambda o: normalize_cik(o["cik"]))
    fine = F.forall(listed, lambda x: x != "") & (F.size(listed) > 0)
    none, own = F.array().cast("array<string>"), normalize_cik(cik)
    alone = F.when(own != "", F.array(own)).otherwise(none)
    return F.when(listed.isNull(), alone).when(fine, F.array_sort(F.array_distinct(listed))).otherwise(none)


def footnote_references(c: Column, known: Column) -> Column:
    """struct(ids, missing): the different footnotes a field names, and those that do not exist."""
    ids = F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;|]+"), lambda x: x != ""))
    return F.struct(ids.alias("ids"), F.array_except(ids, known).alias("missing"))


# Calendars and addresses


def quarter_of(c: Column) -> Column:
    return F.struct(F.year(c).alias("year"), F.quarter(c).alias("quarter"))


def daily_index_path(day: Column) -> Column:
    return F.concat(F.lit("edgar/daily-index/"), F.year(day).cast("string"), F.lit("/QTR"), F.quarter(day).cast("string"), F.lit("/master."), F.date_format(day, "yyyyMMdd"), F.lit(".idx"))


def filing_path(cik: Column, accession: Column) -> Column:
    """Folder of a filing: the number without leading zeros, the accession without dashes."""
    return F.concat(F.lit("edgar/data/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))


def query_address(base: str, parameters: dict[str, Column]) -> Column:
    """An address with encoded parameters; null ones are left out."""
    parts = [F.concat(F.lit(f"{name}="), F.url_encode(value)) for name, value in parameters.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def index_years(since: Column, until: Column) -> Column:
    """Years whose index covers a range of dates; none for an inverted one."""
    return F.when(since <= until, F.sequence(F.year(since), F.year(until))).otherwise(F.array().cast("array<int>"))


def required_quarters(since: Column, until: Column) -> Column:
    """Quarterly data sets that a range of filing dates needs, as first days of quarters.

    A range that ends in a quarter's last eight days needs the next quarter
    too, which may publish them.
    """
    start = F.greatest(since, F.lit(DATASET_START))
    end = F.add_months(F.trunc(until, "quarter"), 3)
    last = F.when(F.datediff(end, until) <= 8, end).otherwise(F.trunc(until, "quarter"))
    none = F.array().cast("array<date>")
    return F.when((until < F.lit(DATASET_START)) | (start > last), none).otherwise(F.sequence(F.trunc(start, "quarter"), last, F.expr("interval 3 months")))


def describe_incomplete(status: Column, issues: Column) -> Column:
    """What a partial result lacks: its first three issues (source, identifier, reason) and how many more; '' when complete."""
    label = lambda i: F.concat_ws(" ", F.when(i["source"] != "", i["source"]), F.when(i["identifier"] != "", i["identifier"]))
    said = F.transform(F.slice(issues, 1, 3), lambda i: F.concat_ws(": ", F.when(label(i) != "", label(i)), F.replace(i["reason"], F.lit("_"), F.lit(" "))))
    more = F.size(issues) - 3
    rest = F.when(more > 0, F.array(F.concat(more.cast("string"), F.when(more == 1, " more issue").otherwise(" more issues")))).otherwise(F.array().cast("array<string>"))
    detail = F.array_join(F.concat(said, rest), "; ")
    text = F.when(detail != "", detail).otherwise(F.replace(status, F.lit("_"), F.lit(" ")))
    return F.when(status.isin("complete", "empty"), "").otherwise(F.concat(F.lit("Incomplete results ("), text, F.lit(")")))


def fetch_status(rows: Column, issues: Column) -> Column:
    """State of a fetch by its rows and issues; only ``complete`` and ``empty`` prove coverage."""
    return F.when(issues > 0, F.when(rows > 0, "partial").otherwise("transient_failure")).when(rows > 0, "complete").otherwise("empty")


def recent_days(until: date, days: int = 7) -> date:
    """First day of the trailing window that is always read again."""
    return until - timedelta(days=days - 1)
