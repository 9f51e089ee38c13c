"""Column functions over disclosure text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.schemas import BUY_WORDS, SELL_WORDS

# White space that str.split() knows inside ASCII, and name parts that are no names.
TITLES = ("hon", "honorable", "sen", "senator", "rep", "representative", "mr", "mrs", "ms", "dr")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
# Position categories in the order they are tried.
POSITION_KEYWORDS = {
    "Executive": (
        "chief executive", "ceo", "cfo", "coo", "cto", "chief financial", "chief operating", "chief technology",
        "chief information", "chief risk", "managing director", "executive director", "executive chairman",
        "executive chair", "directeur général", "directeur general", "dirigeant", "président directeur",
        "president directeur", "administrateur délégué", "vorstandsvorsitzender", "vorstandsmitglied", "vorstand",
        "geschäftsführer", "geschäftsführerin", "generaldirektor", "uitvoerend bestuurder", "bestuurder",
        "algemeen directeur",
    ),
    "Non-Executive": (
        "non-executive", "non executive", "independent director", "supervisory board", "aufsichtsratsvorsitzender",
        "aufsichtsratsmitglied", "aufsichtsrat", "commissaris", "raad van commissarissen",
        "administrateur indépendant", "censeur",
    ),
    "Board Member": (
        "board member", "member of the board", "raad van bestuur", "conseil d'administration", "director",
        "administrateur", "conseil",
    ),
    "Major Shareholder": (
        "major shareholder", "significant shareholder", "actionnaire", "aandeelhouder", "aktionär",
        "person closely associated", "pca",
    ),
}


def fold(c: Column) -> Column:
    """Caseless form of a text; null is empty. Upper case and back, so sharp s of either case is ss; both small sigmas are one.

    The replacement between also keeps the optimizer from taking lower(upper(x)) for lower(x).
    """
    upper = F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(upper), "ς", "σ")


def collapse_ws(c: Column) -> Column:
    """Trimmed, with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_folded(columns: list[Column], needle: str) -> Column:
    """Literal, caseless substring search over several columns, folded together once; a unit separator keeps them apart."""
    return F.contains(fold(F.concat_ws("\u001f", *columns)), fold(F.lit(needle)))


_CLOCK = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?"


def parse_date(c: Column) -> Column:
    """ISO dates and whole ISO timestamps, and month-first dates with / or -; all else is null.

    Two-digit years are 1969 to 2068.
    """
    s = strip(c)
    iso = F.when(s.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}([T ]{_CLOCK})?$"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    plain = F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
    found = [iso, plain]
    for sep in "/-":
        found.append(F.when(s.rlike(rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{4}}$"), F.try_to_date(s, f"M{sep}d{sep}yyyy")))
        short = F.when(s.rlike(rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{2}}$"), F.try_to_date(s, f"M{sep}d{sep}yy"))
        found.append(F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short))
    return F.coalesce(*found)


NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def parse_number(c: Column) -> Column:
    """Numbers with $ , + and accounting parentheses around the whole; anything else is 0."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[$,+]", "")
    negative = s.rlike(r"^\(.*\)$")
    inner = F.when(negative, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    number = F.when(inner.rlike(NUMBER), inner.try_cast("double"))
    return F.coalesce(F.when(negative, 0 - number).otherwise(number), F.lit(0.0))


def classify_trade(c: Column) -> Column:
    """Buy, Sell, Exercise or Other; a leading one-letter code decides over words."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    code = F.regexp_extract(t, r"^([a-z])(\s*-\s*.*)?$", 1)
    by_code = F.when(code == "p", "Buy").when(code == "s", "Sell").when(code.isin("m", "x"), "Exercise").otherwise("Other")
    by_word = (
        F.when(t.rlike("purchase|buy"), "Buy").when(t.rlike("sale|sell"), "Sell").when(t.rlike("exercise|option"), "Exercise").otherwise("Other")
    )
    return F.when(code != "", by_code).otherwise(by_word)


def classify_direction(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*BUY_WORDS), "Buy").when(t.isin(*SELL_WORDS), "Sell").otherwise("Other")


def congress_type(c: Column) -> Column:
    """Purchase, Sale, Exchange or Other from codes and labels, without (partial) and (full)."""
    t = F.regexp_replace(fold(strip(c)), r"\s*\((?:partial|full)\)\s*$", "")
    return (
        F.when(t.isin("p", "purchase"), "Purchase").when(t.isin("s", "sale"), "Sale").when(t.isin("e", "exchange"), "Exchange").otherwise("Other")
    )


def congress_owner(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    t = F.lower(s)
    return F.when(t == "", "Self").when(t == "sp", "Spouse").when(t == "dc", "Dependent Child").when(t == "jt", "Joint").otherwise(F.upper(s))


_AMOUNT = r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"


def amount_range(c: Column) -> Column:
    """struct(low, high) of a disclosed range; ``Over $X`` is (X, X); what does not parse is (0, 0)."""
    s = strip(F.coalesce(c, F.lit("")))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_replace(F.regexp_extract(s, pattern, group), ",", "").try_cast("double")

    over, band = rf"(?i)^(?:.*\s)?over\s+\$\s*{_AMOUNT}$", rf"^\$?\s*{_AMOUNT}\s*[-–—]\s*\$?\s*{_AMOUNT}$"
    top, low, high = number(over, 1), number(band, 1), number(band, 2)
    ordered = low <= high
    return F.struct(
        F.coalesce(top, F.when(ordered, low), F.lit(0.0)).alias("low"), F.coalesce(top, F.when(ordered, high), F.lit(0.0)).alias("high")
    )


def extract_ticker(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([A-Z]{1,5}(?:[.-][A-Z])?)\)", 1)


def normalize_position(c: Column) -> Column:
    """Category of a position text by the first keyword found; short ones count as whole words only.

    "non-executive director" is Non-Executive although "executive director"
    comes first in the list.
    """
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(t.rlike(r"non[- ]executive"), "Non-Executive")
    for category, words in POSITION_KEYWORDS.items():
        for w in words:
            short = len(w) <= 4 and w.isascii() and w.isalpha()
            out = out.when(t.rlike(rf"\b{w}\b") if short else F.contains(t, F.lit(w)), category)
    return out.otherwise("Other")


def normalize_cik(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s.rlike(r"^[0-9]{1,10}$"), F.lpad(s, 10, "0")).otherwise("")


def normalize_issuer_symbol(c: Column) -> Column:
    s = F.upper(F.regexp_extract(strip(c), r"^[^,\s]+", 0))
    whole = F.upper(strip(c))
    return F.when(whole.isin("NONE", "N/A", "NA", "-", "NOT APPLICABLE", "") | (s == ""), None).otherwise(s)


def valid_symbol(c: Column) -> Column:
    return F.upper(strip(c)).rlike(r"^[A-Z0-9^][A-Z0-9._^-]{0,31}$")


def subtract_months(c: Column, months: int | Column) -> Column:
    """The day is clamped to the month's end."""
    return F.add_months(c, -months)


def name_text(c: Column) -> Column:
    """Caseless words of a name, single-spaced, without quoted nicknames, leading titles and trailing suffixes."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"\"[^\"]*\"|“[^”]*”", "")
    words = F.regexp_extract_all(fold(plain), F.lit(r"([\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*)"), 1)
    text = F.regexp_replace(F.array_join(words, " "), rf"^(?:(?:{'|'.join(TITLES)})(?: |$))+", "")
    return F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", "")


def name_tokens(c: Column) -> Column:
    """The words of :func:`name_text`."""
    return F.filter(F.split(name_text(c), " "), lambda w: w != "")


def digest(*parts: Column) -> Column:
    """SHA-256 over parts with a separator that no part holds; null differs from empty."""
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *shown), 256)


def format_reported(c: Column, missing: Column) -> Column:
    return F.when(missing | c.isNull(), "N/A").otherwise(F.format_number(c, 0))


def export_label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def dataset_date(c: Column) -> Column:
    """``DD-MON-YYYY`` or ISO."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd-MMM-yyyy"))
