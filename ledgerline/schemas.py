"""Row models and closed vocabularies of the disclosure tables."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(),
    "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()),
}


def _fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(","))])


FEED_SCHEMA = _fields(
    """market string, market_rank int, row_id bigint, transaction_date date, filing_date date, trade_type string,
    issuer string, identifier string, person string, role string, quantity double, price double, value double,
    display_value string, currency string, source string, url string, sort_value double"""
)

# Market names in tie order, trade types, form kinds.
MARKETS = ("US", "Congress", "Europe")
US_TYPES = ("Buy", "Sell", "Exercise", "Other")
CONGRESS_TYPES = ("Purchase", "Sale", "Exchange", "Other")
EU_TYPES = ("Buy", "Sell", "Other")
OWNERSHIP_FORMS = ("3", "3/A", "4", "4/A", "5", "5/A")
TRANSACTION_FORMS = ("4", "4/A", "5", "5/A")
CHAMBERS = ("", "House", "Senate")
EU_COUNTRIES = ("", "UK", "DE", "FR", "NL")
BUY_WORDS = ("buy", "purchase", "exercise")
SELL_WORDS = ("sell", "sale")
# Transaction codes of ownership filings.
TRANSACTION_CODES = {
    "P": "purchase", "S": "sale", "A": "award", "C": "exercise", "M": "exercise", "O": "exercise", "X": "exercise",
    "F": "tax", "G": "gift", "D": "disposition_to_issuer", "E": "expiration", "H": "expiration", "I": "discretionary",
    "J": "other", "K": "equity_swap", "L": "small_acquisition", "U": "tender", "V": "voluntary_report",
    "W": "inheritance", "Z": "trust",
}
