"""Procedures called from SQL: with constants, row by row, and at the edges."""

import datetime as dt

from tendero.operators import table_functions

DAY = dt.datetime


def _tables(make_tables):
    line = lambda doc, no, part, supplier, units, price, flag="N": (doc, part, supplier, no, units, price, 0.0, 0.0, flag, "O", DAY(2020, 1, 5))
    return make_tables(
        orders=[(1, 7, "F", 10.0, DAY(2020, 1, 31), "1"), (2, 7, "F", 10.0, DAY(2020, 2, 1), "1"), (3, 8, "F", 10.0, DAY(2020, 2, 1), "1"), (4, 8, "F", 1.0, None, "1")],
        lineitem=[line(1, 1, 5, 1, 2.0, 10.0, "R"), line(1, 2, 5, 2, 1.0, 4.0, "R"), line(2, 1, 5, 1, 3.0, 6.0, "R"), line(3, 1, 6, 1, 1.0, 8.0), line(4, 1, 6, 1, 1.0, 8.0)],
        part=[(5, "a", "A", "STD", 1, 2.0), (6, "b", "B", "STD", 1, 3.0), (9, "c", "C", "STD", 1, 3.0)])


def _plain(df):
    return sorted((tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in df.collect()), key=str)


def test_calls_with_constants(spark, make_tables):
    table_functions.register(_tables(make_tables))
    assert _plain(spark.sql("SELECT * FROM stock_of(5)")) == [(1, 5.0), (2, 1.0)]
    assert [tuple(r)[:2] for r in spark.sql("SELECT * FROM sales_between(DATE'2020-02-01', DATE'2020-03-01')").collect()] == [(dt.date(2020, 2, 1), 2)]
    assert _plain(spark.sql("SELECT units, average_cost FROM avg_cost(5)")) == [(6.0, 2.0)]
    nothing = ("stock_of(6)", "stock_of(NULL)", "avg_cost(9)", "avg_cost(NULL)", "sales_between(NULL, DATE'2020-03-01')",
               "sales_between(DATE'2020-02-01', DATE'2020-02-01')", "sales_between(DATE'2020-03-01', DATE'2020-01-01')")
    assert all(spark.sql(f"SELECT * FROM {call}").count() == 0 for call in nothing)


def test_a_constant_reaches_the_scan(spark, make_tables):
    table_functions.register(_tables(make_tables))
    plan = spark.sql("SELECT * FROM stock_of(5)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_partkey,5)" in plan


def test_calls_for_every_row_are_one_join(spark, make_tables):
    t = _tables(make_tables)
    assert _plain(table_functions.stock_of_articles(t)) == [(5, 1, 5.0), (5, 2, 1.0)]
    assert [r[:2] for r in _plain(table_functions.cost_of_articles(t))] == [(5, 6.0), (6, 2.0), (9, None)]
    months = table_functions.sales_of_months(t)
    assert sorted((r.month, r.day, r.documents) for r in months.collect()) == [
        (dt.date(2020, 1, 1), dt.date(2020, 1, 31), 1), (dt.date(2020, 2, 1), dt.date(2020, 2, 1), 2)]
    for df in (months, table_functions.stock_of_articles(t), table_functions.cost_of_articles(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Subquery")) and plan.count("lineitem.parquet") <= 1


def test_overlapping_periods_and_repeated_calls(spark, make_tables):
    table_functions.register(_tables(make_tables))
    got = spark.sql("""
        SELECT p.k, s.day, s.documents FROM VALUES (1, DATE'2020-01-01', DATE'2020-03-01'), (2, DATE'2020-02-01', DATE'2020-02-02'),
            (2, DATE'2020-02-01', DATE'2020-02-02'), (3, DATE'2021-01-01', DATE'2021-02-01') AS p(k, a, b), LATERAL sales_between(p.a, p.b) AS s""")
    assert sorted(map(tuple, got.collect())) == [(1, dt.date(2020, 1, 31), 1), (1, dt.date(2020, 2, 1), 2), (2, dt.date(2020, 2, 1), 2), (2, dt.date(2020, 2, 1), 2)]
