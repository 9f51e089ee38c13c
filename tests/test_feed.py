"""Paging, cursors, keys and criteria."""

from datetime import date

import pytest

from ledgerline.operators import feed as f
from ledgerline.schemas import FEED_SCHEMA


@pytest.fixture(scope="module")
def rows(spark):
    def row(market, rank, n, day, filed, issuer, person, value):
        return (market, rank, n, day, filed, "Buy", issuer, "ID", person, "", 1.0, 1.0, value, "", "USD", "s", "", value)

    days = [date(2024, 1, 1), date(2024, 1, 1), None, date(2024, 2, 1)]
    data = [row("US", 0, i + 1, days[i % 4], days[(i + 1) % 4], f"Corp {i % 3}", "MÜLLER" if i % 2 else "Straße", [None, 5.0, 7.0][i % 3]) for i in range(13)]
    data += [row("Congress", 1, 1, days[0], None, "", "Ann", 9.0), row("Europe", 2, 1, None, days[3], "Corp 1", "Bo", None)]
    return spark.createDataFrame(data, FEED_SCHEMA)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("name", f.SORT_FIELDS)
def test_walk_by_cursor_sees_every_row_once(rows, name, descending):
    c = f.FeedCriteria(sort_field=name, descending=descending)
    full = [(r["market"], r["row_id"]) for r in f.page(rows, c, 200).collect()]
    assert len(full) == 15
    seen, cursor = [], None
    while True:
        part = f.page(rows, c, 4, cursor=cursor).withColumn("key", f.sort_key(name)).collect()
        if not part:
            break
        seen += [(r["market"], r["row_id"]) for r in part]
        cursor = f.Cursor(part[-1]["key"], part[-1]["filing_date"], part[-1]["market_rank"], part[-1]["row_id"])
    assert seen == full


def test_snapshot_hides_newer_rows(rows):
    start = f.Cursor(None, None, -1, 0, {"US": 3, "Congress": 1, "Europe": 0})
    got = f.after_cursor(rows, f.FeedCriteria(), start).collect()
    assert all(r["row_id"] <= {"US": 3, "Congress": 1, "Europe": 0}[r["market"]] for r in got)


def test_search_is_caseless_and_literal(rows):
    hit = lambda text: f.apply_criteria(rows, f.FeedCriteria(search=text)).count()
    assert hit("müller") == hit("MÜLLER") == 6
    assert hit("STRASSE") == 7
    assert hit("%") == hit("_") == 0


def test_keys_and_criteria_are_strict():
    assert f.parse_key("us:12") == ("US", 12)
    for bad in ("us:012", "us:0", "us:-1", "us", "xx:1", "us:1:2"):
        with pytest.raises(ValueError):
            f.parse_key(bad)
    for bad in ({"sort_field": "x"}, {"value_min": float("nan")}, {"value_min": 2, "value_max": 1}, {"directions": ("Up",)}):
        with pytest.raises(ValueError):
            f.FeedCriteria(**bad)
    assert f.FeedCriteria(search="a").is_nontrivial and not f.FeedCriteria(sort_field="issuer").is_nontrivial
