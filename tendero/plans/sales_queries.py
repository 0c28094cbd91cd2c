"""Registered sales questions: query key -> DataFrame over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.functions.columns import exact, total
from tendero.functions.predicates import edge_case, is_system, real_article
from tendero.operators import baskets, ranking, sales, table_functions, widening
from tendero.operators.reads import page, preview
from tendero.sources.tables import Tables

Query = Callable[[Tables], DataFrame]
SYSTEM = ("rod", "widget")  # the system articles of the stored tables
Y0, Y1 = "2000-01-01", "2001-01-01"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _by_article(t: Tables, keep, how: str) -> DataFrame:
    per_article = t.lines.groupBy("article_id").agg(F.count("*").alias("lines"), total("units").alias("units"))
    named = per_article.join(t.articles.select("article_id", "article"), "article_id", how)
    return named.where(keep(F.col("article"))).select("article_id", "article", "lines", "units")


def _edge_cases(t: Tables) -> DataFrame:
    named = t.articles.select("article_id", "article", "code")
    return named.withColumn("excluded", edge_case(named, SYSTEM, ("ARTICLE",)))


def _widened(t: Tables) -> DataFrame:
    found = widening.widen_by_key(sales.sale_docs(t), "placed_at", ["customer_id"], t.as_of())
    return found.groupBy("customer_id").agg(
        F.max("days").alias("days"), F.count("*").alias("documents"),
        total("doc_total").alias("total"))


SALES_QUERIES: dict[str, Query] = {
    "article_sales_month": lambda t: sales.article_sales_month(t, "red plate", "2000-09-01", "2000-10-01"),
    "last_sale": lambda t: sales.last_sale(t, SYSTEM),
    "last_sale_in_period": lambda t: sales.last_sale_in_period(t, "1998-02-01", "1998-03-01", SYSTEM),
    "best_selling_article": lambda t: sales.best_selling_article(t, "1998-02-01", "1998-03-01", SYSTEM),
    "month_totals": lambda t: sales.month_totals(t, "2001-07-01", "2001-08-01"),
    "sales_by_customer": lambda t: sales.sales_by_customer(t, "2001-01-01"),
    "low_stock": sales.low_stock,
    "top_margin": lambda t: sales.top_margin(t, 20),
    "monthly_growth": lambda t: sales.monthly_growth(t, "1997-01-01"),
    "customer_trend": lambda t: sales.customer_trend(t, "2000-01-01"),
    "sales_today": sales.sales_today,
    "active_articles": sales.active_articles,
    "stock_of_article": lambda t: sales.stock_of_article(t, 100),
    "stock_of": lambda t: sales.stock_of(t, 100),
    "sales_between": lambda t: sales.sales_between(t, Y0, Y1),
    "avg_cost": sales.avg_cost,
    "stock_of_lateral": table_functions.stock_of_articles,
    "sales_between_lateral": table_functions.sales_of_months,
    "avg_cost_lateral": table_functions.cost_of_articles,
    "sales_detail": lambda t: sales.sales_detail(t, "2001-01-01"),
    "latest_invoices": sales.latest_invoices,
    "invoice_lines": sales.invoice_lines,
    "sale_filter_funnel": lambda t: sales.sale_filter_funnel(t, SYSTEM),
    "top_customers_year": lambda t: sales.top_customers(t, Y0, Y1),
    "sales_yoy_month": lambda t: sales.sales_yoy_month(t, 2000),
    "customer_ticket": lambda t: sales.customer_ticket(t, Y0, Y1),
    "top5_per_line": lambda t: sales.top5_per_line(t, Y0, Y1),
    "return_rate": sales.return_rate,
    "rotation": sales.rotation,
    "stock_value": sales.stock_value,
    "no_movement": sales.no_movement,
    "stock_by_wh_supplier": sales.stock_by_wh_supplier,
    "margin_by_line": sales.margin_by_line,
    "receivables": sales.receivables,
    "sales_vs_purchases": lambda t: sales.sales_vs_purchases(t, Y0, Y1),
    "discount_by_customer": lambda t: sales.discount_by_customer(t, Y0, Y1),
    "zone_stats": sales.zone_stats,
    "new_customers_month": sales.new_customers_month,
    "bought_now_not_before": sales.bought_now_not_before,
    "top_product_of_top_customers": lambda t: sales.top_product_of_top_customers(t),
    "inactive_customers": sales.inactive_customers,
    "purchases_by_supplier": lambda t: sales.purchases_by_supplier(t, Y0, Y1),
    "articles_per_supplier": sales.articles_per_supplier,
    "lead_time": sales.lead_time,
    "top_suppliers": sales.top_suppliers,
    "abc": ranking.abc,
    "cross_sell": baskets.cross_sell,
    "seller_performance": sales.seller_performance,
    "seasonality": sales.seasonality,
    "negative_margin": sales.negative_margin,
    "multi_criteria_articles": lambda t: sales.multi_criteria_articles(
        t, "ECONOMY", stock=10, price=1000, sales=1, months=12),
    "zone_big_buyers": lambda t: sales.zone_big_buyers(t, "EUROPE", 50000, Y0, Y1),
    "line_yoy": lambda t: sales.line_yoy(t, "2001-07-01"),
    "overdue_customers": sales.overdue_customers,
    "stock_evolution": sales.stock_evolution,
    "sales_drop_anomaly": lambda t: sales.sales_drop_anomaly(t, sigmas=2.0),
    "warehouse_ranking": sales.warehouse_ranking,
    "executive_cube": sales.executive_cube,
    "critical_stock": sales.critical_stock,
    "widened_last_sale": lambda t: widening.widened_last_sale(t, SYSTEM),
    "frequent_customers": sales.frequent_customers,
    "sales_by_category": sales.sales_by_category,
    "top5_buyers_month": sales.top_buyers_last_month,
    "preview_lines": lambda t: preview(t.lineitem.select(*LINE_KEYS), 1000, LINE_KEYS),
    "page_of_documents": lambda t: page(
        t.headers.select("doc_id", "day", "customer_id", exact("doc_total").alias("doc_total")), 100, 50,
        [F.col("day").desc(), F.col("doc_id").desc()]),
    "exclude_system_articles": lambda t: _by_article(t, lambda n: real_article(n, SYSTEM), "left"),
    "excluded_articles": lambda t: _by_article(t, lambda n: is_system(n, SYSTEM), "inner"),
    "edge_case_filter": _edge_cases,
    "widen_until_found": _widened,
}
