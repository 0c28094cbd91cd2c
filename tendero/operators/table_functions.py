"""Procedures as table functions of SQL: called with constants, or for every row with LATERAL.

``register`` puts them into the session's catalog. Their bodies are plain selects, so the
optimizer sees through a call: constants become filters under the aggregates, and a call
for every row of a table becomes one join, without a job or a subquery for each row.

* ``stock_of(article)``: (warehouse_id, stock), TVF-1;
* ``sales_between(lo, hi)``: (day, documents, units, amount) of the days from ``lo`` to before ``hi``, TVF-2;
* ``avg_cost(article)``: (units, spent, average_cost), TVF-3.

Null arguments, unknown articles and periods without a day give no rows. A period
is spread over its days, which meet the sums of days on equal days: work grows with the days
of the periods asked for, not with pairs of periods and days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tendero.operators import sales
from tendero.sources.tables import Tables


def _returns(schema: StructType, *names: str) -> str:
    return ", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names)


def register(t: Tables) -> None:
    """The three functions over the tables of ``t``; a later call for other tables takes their place."""
    views = {"_stock": t.stock, "_days": sales.sales_between(t, None, None), "_costs": sales.avg_cost(t)}
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    stock, days, costs = (v.schema for v in views.values())
    t.spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION stock_of(article BIGINT) RETURNS TABLE ({_returns(stock, "warehouse_id", "stock")})
        RETURN SELECT warehouse_id, stock FROM _stock WHERE article_id = stock_of.article""")
    t.spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION sales_between(lo DATE, hi DATE) RETURNS TABLE ({_returns(days, "day", "documents", "units", "amount")})
        RETURN SELECT d.day, d.documents, d.units, d.amount
               FROM (SELECT explode(if(hi > lo, sequence(lo, date_sub(hi, 1)), array())) AS day) AS p JOIN _days AS d ON d.day = p.day""")
    t.spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION avg_cost(article BIGINT) RETURNS TABLE ({_returns(costs, "units", "spent", "average_cost")})
        RETURN SELECT units, spent, average_cost FROM _costs WHERE article_id = avg_cost.article""")


def stock_of_articles(t: Tables) -> DataFrame:
    """TVF-1 for every article of the dictionary."""
    register(t)
    t.articles.createOrReplaceTempView("_articles")
    return t.spark.sql("SELECT a.article_id, s.warehouse_id, s.stock FROM _articles AS a, LATERAL stock_of(a.article_id) AS s")


def sales_of_months(t: Tables) -> DataFrame:
    """TVF-2 for every month with a document."""
    register(t)
    t.headers.createOrReplaceTempView("_headers")
    return t.spark.sql("""
        SELECT m.month, s.day, s.documents, s.units, s.amount
        FROM (SELECT DISTINCT CAST(trunc(day, 'month') AS DATE) AS month FROM _headers WHERE day IS NOT NULL) AS m,
             LATERAL sales_between(m.month, CAST(add_months(m.month, 1) AS DATE)) AS s""")


def cost_of_articles(t: Tables) -> DataFrame:
    """TVF-3 for every article of the dictionary; those never bought stay, without figures."""
    register(t)
    t.articles.createOrReplaceTempView("_articles")
    return t.spark.sql("""
        SELECT a.article_id, c.units, c.spent, c.average_cost
        FROM _articles AS a LEFT JOIN LATERAL avg_cost(a.article_id) AS c""")
