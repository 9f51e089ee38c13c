"""Every registered query against its SQL."""

import pytest
from conftest import SF, table

from ledgerline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(cursor.fetchall(), columns)


def test_filters_reach_the_scan_and_the_market_filter_prunes(spark):
    from ledgerline.operators.feed import FeedCriteria, apply_criteria
    from ledgerline.plans import bridge

    df = apply_criteria(bridge.feed(spark, SF), FeedCriteria(markets=("Congress",)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_page_is_a_top_k(spark):
    plan = registry.QUERIES["feed_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
