"""Every named query against the SQL that states its rows."""

from __future__ import annotations

import pytest

from oracle import connect, rows_of, rows_of_sql
from tallyfield.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.limit(5).collect()
    else:
        assert rows_of(df) == rows_of_sql(con, sql, df.columns)


def test_names_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.FLAGSHIP in catalogue.queries()


def test_filters_and_columns_reach_the_scan(spark, data):
    from tallyfield.flow import Flow
    from tallyfield.functions.predicates import where_equals, where_gt

    plan = Flow.from_parquet(spark, f"{data}/orders.parquet").filter(where_gt("o_totalprice", 1000), where_equals("o_orderstatus", "F")).select("o_orderkey").explain()
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan and "EqualTo(o_orderstatus,F)" in plan
    none = Flow.from_parquet(spark, f"{data}/orders.parquet").query("not (o_totalprice > 1000 or o_orderstatus in ['F', 'O'])").explain()
    assert "LessThanOrEqual(o_totalprice" in none and "Not(In(o_orderstatus" in none
    read = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "o_orderdate" not in read


def _stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return con


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_the_best_of_equal_views_is_the_latest(spark, tmp_path):
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)
    con = _stored(spark, tmp_path, [(k, at(m), 1, "view", v) for k, (m, v) in enumerate([(1, 2.0), (9, 2.0), (5, 2.0), (20, None), (30, 1.0)])], EVENTS)
    df = catalogue.queries()["agg_filter_clause"](spark, str(tmp_path))
    assert [r["best_view"] for r in df.collect()] == [at(9)]
    assert rows_of(df) == rows_of_sql(con, catalogue.oracle_sql()["agg_filter_clause"], df.columns)


def test_odds_at_half_a_thousandth_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    import random

    rows = []
    for user in range(300):  # means of 0.01 more than a multiple of 0.02, each an odd number of half thousandths
        values = [float(f"{x:.2f}") for x in random.Random(user).sample([k / 100 for k in range(1000, 9000)], 39)]
        for kind in range(3):
            cents = [round(v * 100) for v in values]
            cents.append((40 * (2 * (user + 2500 + kind) + 1)) - sum(cents))
            rows += [(3 * len(rows) + kind, None, user, "view", c / 100) for c in cents]
    _stored(spark, tmp_path, rows, EVENTS)
    from tallyfield.plans.market_queries import _triples

    for r in _triples(spark, str(tmp_path)).collect():
        assert r["odds"] == [(1200 + (2 * (r["user_id"] + 2500 + kind) + 1 + 1) // 2) / 1000 for kind in range(3)]
    con = _stored(spark, tmp_path / "again", rows[::-1], EVENTS)
    df = catalogue.queries()["value_and_arbitrage"](spark, str(tmp_path / "again"))
    assert rows_of(df) == rows_of_sql(con, catalogue.oracle_sql()["value_and_arbitrage"], df.columns)


def test_custom_aggregates_gather_no_group(spark, data):
    plan = catalogue.queries()["custom_aggregates"](spark, data)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
