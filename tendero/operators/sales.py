"""Sales questions over header/detail documents.

Shared rules. A sale is a document of the sale type with positive lines. Measures
per document are summed before the join to the headers: the sum is partial on the
map side, so one huge document never lands in one task, and the number of
documents becomes a plain count. Names are joined after the aggregation, to the
few rows that are left. Dates of "today" come from the data (``Tables.as_of``).
Every top-k breaks ties on its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendero.functions.columns import (
    exact, halves, margin, percent, ratio, real, rolled, rolled_halves, total,
)
from tendero.functions.predicates import (
    SALE_EXCLUSIONS, in_period, is_sale, positive, real_article, trailing,
)
from tendero.sources.tables import Tables

Bound = str | Column | None
c = F.col


# --- building blocks -------------------------------------------------------

def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def sale_docs(t: Tables, lo: Bound = None, hi: Bound = None, any_type: bool = False) -> DataFrame:
    docs = t.headers.where(in_period(c("placed_at"), lo, hi))
    return docs if any_type else docs.where(is_sale())


def sale_lines(t: Tables, lo: Bound = None, hi: Bound = None, any_type: bool = False,
               checked: Sequence[str] = ("units", "net")) -> DataFrame:
    """Lines with their header, inner (JN-1); ``checked`` measures must be > 0."""
    lines = t.lines.where(positive(*checked)) if checked else t.lines
    return sale_docs(t, lo, hi, any_type).join(lines, "doc_id")


def doc_sales(t: Tables, lo: Bound = None, hi: Bound = None, any_type: bool = False,
              checked: Sequence[str] = ("units", "net")) -> DataFrame:
    """One row per sale document with its line sums, left as halves."""
    lines = t.lines.where(positive(*checked)) if checked else t.lines
    per_doc = lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), *halves("units", "net", "gross", "discount"))
    return sale_docs(t, lo, hi, any_type).join(per_doc, "doc_id")


def top(df: DataFrame, k: int, measure: str, *keys: str) -> DataFrame:
    """The k largest, ties by key: one bounded heap per task, no full sort (ORD-3)."""
    return df.orderBy(c(measure).desc(), *keys).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, measure: str, *keys: str,
                  rank: str = "place") -> DataFrame:
    """The k largest of each group (WIN-7).

    ``row_number`` under a ``<= k`` filter is cut to k rows per group before the
    shuffle, so a dominant group does not reach one task whole.
    """
    w = Window.partitionBy(group).orderBy(c(measure).desc(), *keys)
    return df.withColumn(rank, F.row_number().over(w)).where(c(rank) <= k)


def with_few(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Names for a bounded result: the k rows of a top-k are sent to the dimension.

    The left form first cuts the dimension to the keys of those rows, so neither
    form shuffles the dimension.
    """
    if how == "inner":
        return dim.join(F.broadcast(facts), key)
    named = dim.join(F.broadcast(facts.select(key)), key, "left_semi")
    return facts.join(F.broadcast(named), key, "left")


def unit_price(gross: str = "gross", units: str = "units") -> Column:
    """Price of a unit, in double."""
    return F.try_divide(real(gross) / 100, real(units) / 100)


# --- totals and details (BQ-1 .. BQ-17) --------------------------------------

def article_sales_month(t: Tables, article: str, lo: str, hi: str) -> DataFrame:
    """BQ-1: documents, units and amount of an article (by name) in a period."""
    named = t.articles.where(c("article") == article).select("article_id", "article")
    lines = t.lines.where(positive("units", "net")).join(named, "article_id")
    return (
        lines.join(sale_docs(t, lo, hi).select("doc_id"), "doc_id", "left_semi")
        .groupBy("article_id", "article")
        .agg(F.countDistinct("doc_id").alias("documents"), total("units").alias("units"),
             total("net").alias("amount"))
    )


_LINE_ORDER = ("line_no", "article_id", "warehouse_id", "units", "net")


def latest_lines(t: Tables, lines: DataFrame, k: int) -> DataFrame:
    """The newest k lines of real articles, then the warehouse name (ORD-1, ORD-2)."""
    newest = (
        lines.orderBy(c("day").desc(), c("doc_id").desc(), *_LINE_ORDER).limit(k)
        .select("doc_id", "day", "line_no", "warehouse_id", "article_id", "article",
                exact("units").alias("units"), exact("net").alias("amount"))
    )
    return with_few(newest, t.warehouses.select("warehouse_id", "warehouse"), "warehouse_id",
                    "left")


def real_lines(t: Tables, lines: DataFrame, exclusions: Sequence[str]) -> DataFrame:
    named = lines.join(t.articles.select("article_id", "article"), "article_id", "left")
    return named.where(real_article(c("article"), exclusions))


def last_sale(t: Tables, exclusions: Sequence[str] = SALE_EXCLUSIONS, days: int = 90,
              k: int = 1) -> DataFrame:
    """BQ-2: latest sale with a real article, in the last days of the data."""
    docs = sale_docs(t).where(trailing(c("placed_at"), t.as_of(), days))
    lines = docs.join(t.lines.where(positive("units", "net")), "doc_id")
    return latest_lines(t, real_lines(t, lines, exclusions), k)


def last_sale_in_period(t: Tables, lo: str, hi: str,
                        exclusions: Sequence[str] = SALE_EXCLUSIONS, k: int = 1) -> DataFrame:
    """BQ-3: the same within given dates, which are never widened."""
    return latest_lines(t, real_lines(t, sale_lines(t, lo, hi), exclusions), k)


def best_selling_article(t: Tables, lo: str, hi: str,
                         exclusions: Sequence[str] = SALE_EXCLUSIONS, k: int = 1) -> DataFrame:
    """BQ-4: best seller of a period by units, system articles dropped (FLT-10)."""
    real_ones = (t.articles.where(real_article(c("article"), exclusions, keep_unknown=False))
                 .select("article_id", "article"))
    sold = (
        sale_lines(t, lo, hi, any_type=True, checked=("units",)).join(real_ones, "article_id")
        .groupBy("article_id", "article")
        .agg(total("units").alias("units"), total("gross").alias("amount"))
    )
    return top(sold, k, "units", "article_id")


def month_totals(t: Tables, lo: str, hi: str) -> DataFrame:
    """BQ-5: documents, lines and total of a period, mean line and mean ticket (AGG-6/7)."""
    return (
        doc_sales(t, lo, hi, checked=())
        .agg(F.sum("lines").alias("lines"), F.count("*").alias("documents"),
             rolled("gross").alias("total"))
        .withColumn("mean_line", ratio("total", "lines"))
        .withColumn("mean_ticket", ratio("total", "documents"))
    )


def sales_by_customer(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """BQ-6: documents, units and amount of each customer, largest first."""
    sold = (
        doc_sales(t, lo, hi, checked=()).groupBy("customer_id")
        .agg(F.count("*").alias("documents"), rolled("units").alias("units"),
             rolled("gross").alias("amount"))
    )
    return (
        sold.join(t.customers.select("customer_id", "customer"), "customer_id")
        .select("customer_id", "customer", "documents", "units", "amount")
        .orderBy(c("amount").desc(), "customer_id")
    )


def low_stock(t: Tables) -> DataFrame:
    """BQ-7: active articles under their minimum, with code and supplier.

    Stock is one row per article before the left join, so an article with several
    codes keeps its stock. The supplier is the lowest one the article came from.
    """
    held = t.lines.groupBy("article_id").agg(
        total("units", only=c("is_return")).alias("stock"), F.count_if("is_return").alias("held"),
        F.min("warehouse_id").alias("warehouse_id"))
    return (
        t.articles.where("active").join(held, "article_id", "left")
        .withColumn("stock", F.when(c("held") > 0, c("stock")))
        .where(F.coalesce(c("stock"), F.lit(0)) < c("minimum"))
        .join(t.warehouses.select("warehouse_id", c("warehouse").alias("supplier")),
              "warehouse_id", "left")
        .select("article_id", "article", "code", "stock", "minimum", "supplier")
        .orderBy("stock", "article_id")
    )


def _priced(t: Tables) -> DataFrame:
    """Mean selling price of each article (the stand-in for a price list)."""
    return (
        t.lines.groupBy("article_id").agg(total("gross").alias("gross"), total("units").alias("units"))
        .select("article_id", ratio("gross", "units").alias("price"))
    )


def article_margins(t: Tables) -> DataFrame:
    """Price, cost, profit and margin of every active article with a cost (JN-5, PRJ-2)."""
    return (
        t.articles.where(c("active") & (c("cost") > 0)).withColumn("cost", exact("cost"))
        .join(_priced(t), "article_id").select("article_id", "article", "line", "price", "cost",
                (c("price") - real("cost")).alias("profit"),
                margin("price", "cost").alias("margin_pct"))
    )


def top_margin(t: Tables, k: int = 10) -> DataFrame:
    """BQ-8: the most profitable articles by margin over cost."""
    return top(article_margins(t), k, "margin_pct", "article_id").drop("line")


def monthly(t: Tables, lo: Bound = None, hi: Bound = None, any_type: bool = True) -> DataFrame:
    return (
        doc_sales(t, lo, hi, any_type, checked=())
        .groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(rolled("gross").alias("total"))
    )


def monthly_growth(t: Tables, lo: Bound = None) -> DataFrame:
    """BQ-9: total per month with the month before and growth.

    The unpartitioned window sees calendar months only: twelve rows a year.
    """
    prev = F.lag("total").over(Window.orderBy("year", "month"))
    return (
        monthly(t, lo).withColumn("previous", prev)
        .withColumn("growth_pct", percent(real("total") - real("previous"), "previous"))
        .orderBy("year", "month")
    )


def customer_trend(t: Tables, lo: Bound = None) -> DataFrame:
    """BQ-10: monthly sales per customer with growth and a 3-month mean.

    After the two-level aggregation a customer holds one row per month, so the
    window partitions stay small whatever the number of lines behind them.
    """
    w = Window.partitionBy("customer_id").orderBy("year", "month")
    months = (
        doc_sales(t, lo, any_type=True, checked=())
        .groupBy("customer_id", F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(rolled("gross").alias("total"), F.count("*").alias("documents"),
             F.sum("lines").alias("lines"))
    )
    trend = (
        months.withColumn("mean_line", ratio("total", "lines"))
        .withColumn("previous", F.lag("total").over(w))
        .withColumn("growth_pct", percent(real("total") - real("previous"), "previous"))
        .withColumn("window_sum", F.sum("total").over(w.rowsBetween(-2, 0)))
        .withColumn("window_rows", F.count("*").over(w.rowsBetween(-2, 0)))
        .withColumn("mean_3m", ratio("window_sum", "window_rows"))
        .where(c("growth_pct").isNotNull())
    )
    return (
        trend.join(t.customers.select("customer_id", "customer"), "customer_id")
        .select("customer_id", "customer", "year", "month", "total", "documents", "mean_line",
                "previous", "growth_pct", "mean_3m")
        .orderBy(F.abs("growth_pct").desc(), "customer_id", "year", "month")
    )


def sales_today(t: Tables, day: Bound = None) -> DataFrame:
    """BQ-11: documents and total of one day, by default the last of the data (FLT-5)."""
    day = t.as_of() if day is None else day
    lo = F.lit(day).cast("date") if isinstance(day, str) else day
    return (
        t.headers.where(in_period(c("placed_at"), lo, F.date_add(lo, 1)))
        .agg(F.count("*").alias("documents"), total("doc_total").alias("total"))
    )


def active_articles(t: Tables) -> DataFrame:
    """BQ-12: how many articles are active."""
    return t.articles.where("active").agg(F.count("*").alias("active_articles"))


def stock_of(t: Tables, article_id: int, warehouse_id: int | None = None) -> DataFrame:
    """TVF-1: stock of one article in each warehouse, or in one of them."""
    lines = t.lines.where(c("is_return") & (c("article_id") == article_id))
    if warehouse_id is not None:
        lines = lines.where(c("warehouse_id") == warehouse_id)
    return lines.groupBy("article_id", "warehouse_id").agg(total("units").alias("stock"))


def stock_of_article(t: Tables, article_id: int) -> DataFrame:
    """BQ-13: total stock of one article."""
    return stock_of(t, article_id).groupBy("article_id").agg(F.sum("stock").alias("stock"))


def sales_between(t: Tables, lo: Bound, hi: Bound) -> DataFrame:
    """TVF-2: sales of a period by day."""
    return (
        doc_sales(t, lo, hi).groupBy("day")
        .agg(F.count("*").alias("documents"), rolled("units").alias("units"),
             rolled("net").alias("amount"))
    )


def avg_cost(t: Tables, article_id: int | None = None) -> DataFrame:
    """TVF-3: average cost of an article, weighted by the units bought."""
    bought = t.lines if article_id is None else t.lines.where(c("article_id") == article_id)
    bought = bought.groupBy("article_id").agg(total("units").alias("units"))
    return (
        bought.join(t.articles.select("article_id", "cost"), "article_id")
        .withColumn("spent", c("units") * exact("cost"))
        .select("article_id", "units", "spent", ratio("spent", "units").alias("average_cost"))
    )


def sales_detail(t: Tables, lo: Bound, hi: Bound = None) -> DataFrame:
    """BQ-14: lines from a date with article and warehouse, orphan lines kept (JN-3)."""
    lines = sale_lines(t, lo, hi, any_type=True, checked=())
    return (
        lines.join(t.articles.select("article_id", "code", "article"), "article_id", "left")
        .join(t.warehouses.select("warehouse_id", "warehouse"), "warehouse_id", "left")
        .select("doc_id", "day", "line_no", "warehouse", "article_id", "code", "article",
                exact("units").alias("units"), exact("net").alias("net"))
        .orderBy(c("day").desc(), c("doc_id").desc(), "line_no", "article_id")
    )


def latest_invoices(t: Tables, k: int = 5) -> DataFrame:
    """BQ-15: the last documents with their customer."""
    newest = (
        t.headers.orderBy(c("day").desc(), c("doc_id").desc()).limit(k)
        .select("doc_id", "day", "doc_type", "customer_id", exact("doc_total").alias("doc_total"))
    )
    return with_few(newest, t.customers.select("customer_id", "customer"), "customer_id", "left")


def invoice_lines(t: Tables, doc_id: int | None = None, k: int = 10) -> DataFrame:
    """BQ-16: first lines of one document, by default of the last sale (ORD-7)."""
    if doc_id is None:
        target = sale_docs(t).agg(F.max_by("doc_id", F.struct("day", "doc_id"))).scalar()
    else:
        target = F.lit(doc_id)
    lines = t.lines.where(c("doc_id") == target).orderBy(*_LINE_ORDER).limit(k)
    return with_few(lines, t.articles.select("article_id", "article"), "article_id", "left").select(
        "doc_id", "line_no", "article_id", "article", exact("units").alias("units"),
        unit_price().alias("unit_price"), exact("net").alias("net"))


def sale_filter_funnel(t: Tables, exclusions: Sequence[str] = SALE_EXCLUSIONS,
                       doc_id: int | None = None) -> DataFrame:
    """BQ-17: lines that survive each filter alone and all of them, in one pass."""
    lines = t.lines if doc_id is None else t.lines.where(c("doc_id") == doc_id)
    named = lines.join(t.articles.select("article_id", "article"), "article_id", "left")
    units, price = c("units") > 0, c("net") > 0
    return named.agg(
        F.count("*").alias("all_lines"), F.count_if(units).alias("with_units"),
        F.count_if(price).alias("with_price"), F.count("article_id").alias("with_article"),
        F.count_if(units & price & real_article(c("article"), exclusions)).alias("all_filters"))


# --- sales analysis (BQ-18 .. BQ-22) ------------------------------------------

def top_customers(t: Tables, lo: Bound, hi: Bound, k: int = 10) -> DataFrame:
    """BQ-18: best customers of a period by amount."""
    sold = doc_sales(t, lo, hi).groupBy("customer_id").agg(
        rolled("net").alias("amount"), F.count("*").alias("documents"))
    return with_few(top(sold, k, "amount", "customer_id"),
                    t.customers.select("customer_id", "customer"), "customer_id")


def sales_yoy_month(t: Tables, year: int) -> DataFrame:
    """BQ-19: month totals of a year beside those of the year before.

    One scan of both years and a conditional sum give what a full join of two
    aggregates would (JN-10): a month missing on one side shows 0.
    """
    docs = doc_sales(t, f"{year - 1}-01-01", f"{year + 1}-01-01")
    this = F.year("day") == year
    return _compared(docs.groupBy(F.month("day").alias("month")), this, "net")


def _compared(grouped, this: Column, measure: str) -> DataFrame:
    sides = grouped.agg(
        rolled(measure, this).alias("this_period"), rolled(measure, ~this).alias("before"))
    return (
        sides.withColumn("difference", c("this_period") - c("before"))
        .withColumn("change_pct", percent("difference", "before"))
    )


def customer_ticket(t: Tables, lo: Bound, hi: Bound) -> DataFrame:
    """BQ-20: amount, documents and mean ticket of each customer."""
    sold = doc_sales(t, lo, hi).groupBy("customer_id").agg(
        rolled("net").alias("amount"), F.count("*").alias("documents"))
    return (
        sold.withColumn("mean_ticket", ratio("amount", "documents"))
        .join(t.customers.select("customer_id", "customer"), "customer_id")
    )


def top5_per_line(t: Tables, lo: Bound, hi: Bound, k: int = 5) -> DataFrame:
    """BQ-21: best articles of each line by units."""
    sold = sale_lines(t, lo, hi).groupBy("article_id").agg(total("units").alias("units"))
    named = sold.join(t.articles.select("article_id", "article", "line"), "article_id")
    return top_per_group(named, "line", k, "units", "article_id")


def return_rate(t: Tables) -> DataFrame:
    """BQ-22: returned units of each article and their share of all units."""
    moved = t.lines.groupBy("article_id").agg(
        total("units").alias("units"),
        total("units", only=c("is_return")).alias("returned"))
    return (
        moved.where(c("returned") > 0)
        .withColumn("return_pct", percent("returned", "units"))
        .join(t.articles.select("article_id", "article"), "article_id")
        .orderBy(c("returned").desc(), "article_id")
    )


# --- stock (BQ-23 .. BQ-26, BQ-49, BQ-53) ---------------------------------------

def rotation(t: Tables, months: int = 3) -> DataFrame:
    """BQ-23: units sold in the last months over the stock of today."""
    since = F.add_months(t.as_of(), -months)
    sold = sale_lines(t, since).groupBy("article_id").agg(total("units").alias("sold"))
    return (
        sold.join(t.stock_by_article, "article_id", "left")
        .withColumn("rotation", ratio("sold", "stock"))
        .join(t.articles.select("article_id", "article"), "article_id")
        .orderBy(c("rotation").desc_nulls_last(), "article_id")
    )


def _valued_stock(t: Tables) -> DataFrame:
    held = t.stock.join(t.articles.select("article_id", "cost"), "article_id")
    return held.withColumn("value", c("stock") * exact("cost"))


def stock_value(t: Tables) -> DataFrame:
    """BQ-24: stock at cost by warehouse."""
    held = _valued_stock(t).groupBy("warehouse_id").agg(
        F.count("*").alias("articles"), F.sum("stock").alias("stock"), F.sum("value").alias("value"))
    return held.join(t.warehouses.select("warehouse_id", "warehouse"), "warehouse_id")


def no_movement(t: Tables, months: int = 6) -> DataFrame:
    """BQ-25: articles neither sold nor received in the last months (JN-7)."""
    since = F.add_months(t.as_of(), -months)
    sold = (t.lines.join(sale_docs(t, since, any_type=True), "doc_id", "left_semi")
            .select("article_id"))
    moved = t.lines.where(in_period(c("moved_at"), since, None)).select("article_id")
    return (
        t.articles.join(sold.unionByName(moved).distinct(), "article_id", "left_anti")
        .select("article_id", "article", "line")
    )


def stock_by_wh_supplier(t: Tables) -> DataFrame:
    """BQ-26: stock and value by place of the warehouse and supplier."""
    held = _valued_stock(t).groupBy("warehouse_id").agg(
        F.sum("stock").alias("stock"), F.sum("value").alias("value"))
    return (
        held.join(t.warehouses, "warehouse_id").join(t.zones, "nation_id")
        .groupBy("nation", c("warehouse").alias("supplier"))
        .agg(F.sum("stock").alias("stock"), F.sum("value").alias("value"))
    )


def stock_evolution(t: Tables) -> DataFrame:
    """BQ-49: units in, out and held at the end of each month."""
    months = (
        t.lines.groupBy(month_of(c("moved_day")).alias("month"))
        .agg(total("units", only=c("flag") == "R").alias("units_in"),
             total("units", only=c("flag") == "A").alias("units_out"))
    )
    held = F.sum(c("units_in") - c("units_out")).over(
        Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return months.withColumn("held", held).orderBy("month")


def critical_stock(t: Tables, limit: int = 10) -> DataFrame:
    """BQ-53: articles with less than ``limit`` units in a warehouse."""
    return (
        t.stock.where(c("stock") < limit)
        .join(t.articles.select("article_id", "article"), "article_id")
    )


# --- money (BQ-27 .. BQ-30) -------------------------------------------------------

def margin_by_line(t: Tables) -> DataFrame:
    """BQ-27: mean margin of the articles of each line."""
    return article_margins(t).groupBy("line").agg(
        F.count("*").alias("articles"), F.round(F.avg("margin_pct"), 2).alias("mean_margin_pct"))


def receivables(t: Tables) -> DataFrame:
    """BQ-28: open balance by customer, largest first."""
    open_docs = t.headers.where(c("doc_type").isin("O", "P"))
    owed = open_docs.groupBy("customer_id").agg(
        F.count("*").alias("open_documents"), total("doc_total").alias("balance"))
    return (
        owed.join(t.customers.select("customer_id", "customer"), "customer_id")
        .orderBy(c("balance").desc(), "customer_id")
    )


def _purchases(t: Tables, lo: Bound, hi: Bound) -> DataFrame:
    """Received lines with their value at article cost, in ten-thousandths."""
    return (
        t.lines.where(in_period(c("moved_at"), lo, hi))
        .join(t.articles.select("article_id", "cost"), "article_id")
        .withColumn("spent", c("units") * c("cost"))
    )


def sales_vs_purchases(t: Tables, lo: str, hi: str) -> DataFrame:
    """BQ-29: sold and bought amount of each month (JN-10)."""
    sold = (doc_sales(t, lo, hi).groupBy(month_of(c("day")).alias("month"))
            .agg(rolled("net").alias("sold")))
    bought = (
        _purchases(t, lo, hi).groupBy(month_of(c("moved_day")).alias("month"))
        .agg(total("spent", 4).alias("bought"))
    )
    zero = F.lit(0)
    return (
        sold.join(bought, "month", "full")
        .select("month", F.coalesce("sold", zero).alias("sold"),
                F.coalesce("bought", zero).alias("bought"))
        .withColumn("difference", c("sold") - c("bought"))
    )


def discount_by_customer(t: Tables, lo: Bound, hi: Bound) -> DataFrame:
    """BQ-30: discount given to each customer."""
    given = (doc_sales(t, lo, hi).groupBy("customer_id")
             .agg(rolled("discount").alias("discount"), rolled("gross").alias("gross")))
    return (
        given.withColumn("discount_pct", percent("discount", "gross"))
        .join(t.customers.select("customer_id", "customer"), "customer_id")
    )


# --- customers (BQ-31 .. BQ-35, BQ-46, BQ-48, BQ-50, BQ-55, BQ-57) ------------------

def zone_stats(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """BQ-31: amount, mean ticket and documents per customer of each zone."""
    per_customer = doc_sales(t, lo, hi).groupBy("customer_id").agg(
        rolled("net").alias("amount"), F.count("*").alias("documents"))
    return (
        per_customer.join(t.customers.select("customer_id", "nation_id"), "customer_id")
        .join(t.zones, "nation_id").groupBy("zone")
        .agg(F.sum("amount").alias("amount"), F.sum("documents").alias("documents"),
             F.count("*").alias("customers"))
        .withColumn("mean_ticket", ratio("amount", "documents"))
        .withColumn("documents_per_customer", ratio("documents", "customers"))
    )


def new_customers_month(t: Tables) -> DataFrame:
    """BQ-32: customers by the month of their first document."""
    first = t.headers.groupBy("customer_id").agg(F.min("day").alias("first_day"))
    return (first.groupBy(month_of(c("first_day")).alias("month"))
            .agg(F.count("*").alias("new_customers")))


def bought_now_not_before(t: Tables) -> DataFrame:
    """BQ-33: customers of the last month who did not buy in the month before.

    Both months in one scan: a customer qualifies when the first document of the
    two months lies in the later one.
    """
    this = F.trunc(t.as_of(), "month")
    docs = t.headers.where(in_period(c("placed_at"), F.add_months(this, -1), F.add_months(this, 1)))
    seen = docs.groupBy("customer_id").agg(
        F.min("day").alias("first_day"), F.count("*").alias("documents"))
    return (
        seen.where(c("first_day") >= this).select("customer_id", "documents")
        .join(t.customers.select("customer_id", "customer"), "customer_id")
    )


def top_product_of_top_customers(t: Tables, lo: Bound = None, hi: Bound = None, k: int = 10) -> DataFrame:
    """BQ-34: the article each of the best customers buys most."""
    best = top_customers(t, lo, hi, k).select("customer_id", "customer", "amount")
    docs = sale_docs(t, lo, hi).join(F.broadcast(best), "customer_id")
    bought = (
        docs.join(t.lines.where(positive("units", "net")), "doc_id")
        .groupBy("customer_id", "customer", "amount", "article_id")
        .agg(total("units").alias("units"))
    )
    favourite = top_per_group(bought, "customer_id", 1, "units", "article_id").drop("place")
    return with_few(favourite, t.articles.select("article_id", "article"), "article_id")


def inactive_customers(t: Tables, months: int = 3) -> DataFrame:
    """BQ-35: customers without a document in the last months (JN-7)."""
    since = F.add_months(t.as_of(), -months)
    recent = t.headers.where(in_period(c("placed_at"), since, None)).select("customer_id").distinct()
    return (t.customers.join(recent, "customer_id", "left_anti")
            .select("customer_id", "customer", "segment"))


def zone_big_buyers(t: Tables, zone: str, amount: float, lo: Bound, hi: Bound) -> DataFrame:
    """BQ-46: customers of a zone above an amount, with documents and top article."""
    in_zone = (
        t.customers.join(t.zones.where(c("zone") == zone), "nation_id")
        .select("customer_id", "customer")
    )
    docs = sale_docs(t, lo, hi).join(in_zone, "customer_id")
    lines = docs.join(t.lines.where(positive("units", "net")), "doc_id")
    by_article = lines.groupBy("customer_id", "customer", "article_id").agg(
        total("net").alias("amount"), total("units").alias("units"))
    best = F.max(F.struct("units", (-c("article_id")).alias("rest"), "article_id"))
    buyers = (
        by_article.groupBy("customer_id", "customer")
        .agg(F.sum("amount").alias("amount"), best.alias("best"))
        .where(c("amount") > amount)
        .select("customer_id", "customer", "amount", c("best.article_id").alias("article_id"))
    )
    counted = (
        lines.select("customer_id", "doc_id").distinct()
        .groupBy("customer_id").agg(F.count("*").alias("documents"))
    )
    return (
        buyers.join(counted, "customer_id")
        .join(t.articles.select("article_id", c("article").alias("top_article")), "article_id")
    )


def overdue_customers(t: Tables, days: int = 30) -> DataFrame:
    """BQ-48: customers with open documents older than ``days``."""
    as_of = t.as_of()
    late = t.headers.where((c("doc_type") == "O")
                           & (c("placed_at") < F.date_sub(as_of, days).cast("timestamp_ntz")))
    owed = late.groupBy("customer_id").agg(
        F.count("*").alias("documents"), total("doc_total").alias("balance"),
        F.min("day").alias("oldest"))
    return (
        owed.withColumn("max_days", F.datediff(t.as_of(), c("oldest"))).drop("oldest")
        .join(t.customers.select("customer_id", "customer"), "customer_id")
    )


def sales_drop_anomaly(t: Tables, sigmas: float = 2.0) -> DataFrame:
    """BQ-50: customers whose last month is far under their own history.

    A window partition holds one row per month of one customer, not its lines.
    """
    months = (
        doc_sales(t).groupBy("customer_id", month_of(c("day")).alias("month"))
        .agg(rolled("net").alias("total"))
    )
    w = Window.partitionBy("customer_id").orderBy("month")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    history = (
        months.withColumn("amount", real("total"))
        .withColumn("mean", F.avg("amount").over(before))
        .withColumn("spread", F.stddev_samp("amount").over(before))
        .withColumn("later", F.lead("month").over(w))
    )
    return (
        history.where(c("later").isNull() & (c("amount") < c("mean") - sigmas * c("spread")))
        .select("customer_id", "month", "total", F.round("mean", 2).alias("mean"),
                F.round("spread", 2).alias("spread"))
    )


def frequent_customers(t: Tables, k: int = 10) -> DataFrame:
    """BQ-55: customers with the most documents."""
    seen = t.headers.groupBy("customer_id").agg(F.count("*").alias("documents"))
    return with_few(top(seen, k, "documents", "customer_id"),
                    t.customers.select("customer_id", "customer"), "customer_id")


def top_buyers_last_month(t: Tables, k: int = 5) -> DataFrame:
    """BQ-57: best customers of the month of the last sale."""
    last = sale_docs(t).agg(F.max("day")).scalar()
    return top_customers(t, F.trunc(last, "month"), None, k)


# --- suppliers and warehouses (BQ-36 .. BQ-39, BQ-51) ---------------------------------

def purchases_by_supplier(t: Tables, lo: Bound, hi: Bound) -> DataFrame:
    """BQ-36: purchases and orders of each supplier.

    The distinct count shuffles on (supplier, document), not on the supplier.
    """
    bought = _purchases(t, lo, hi).groupBy("warehouse_id").agg(
        total("spent", 4).alias("amount"), F.countDistinct("doc_id").alias("orders"))
    return bought.join(
        t.warehouses.select("warehouse_id", c("warehouse").alias("supplier")), "warehouse_id")


def articles_per_supplier(t: Tables) -> DataFrame:
    """BQ-37: active articles of each supplier."""
    active = t.articles.where("active").select("article_id")
    pairs = t.lines.select("warehouse_id", "article_id").distinct()
    return (
        pairs.join(active, "article_id", "left_semi").groupBy("warehouse_id")
        .agg(F.count("*").alias("articles"))
        .join(t.warehouses.select("warehouse_id", c("warehouse").alias("supplier")), "warehouse_id")
    )


def lead_time(t: Tables) -> DataFrame:
    """BQ-38: mean days from order to receipt by supplier."""
    days = F.datediff(c("moved_day"), c("day"))
    timed = t.headers.select("doc_id", "day").join(
        t.lines.select("doc_id", "warehouse_id", "moved_day"), "doc_id")
    means = timed.groupBy("warehouse_id").agg(
        F.count("*").alias("lines"), F.avg(days).alias("mean_days"))
    return means.join(
        t.warehouses.select("warehouse_id", c("warehouse").alias("supplier")), "warehouse_id")


def top_suppliers(t: Tables, months: int = 6, k: int = 5) -> DataFrame:
    """BQ-39: suppliers with the most movements in the last months."""
    since = F.add_months(t.as_of(), -months)
    moved = (t.lines.where(in_period(c("moved_at"), since, None))
             .groupBy("warehouse_id").agg(F.count("*").alias("movements")))
    return with_few(top(moved, k, "movements", "warehouse_id"),
                    t.warehouses.select("warehouse_id", c("warehouse").alias("supplier")),
                    "warehouse_id")


def warehouse_ranking(t: Tables, k: int = 10) -> DataFrame:
    """BQ-51: warehouses with the most sales."""
    sold = sale_lines(t).groupBy("warehouse_id").agg(
        F.count("*").alias("lines"), total("net").alias("amount"))
    return with_few(top(sold, k, "amount", "warehouse_id"),
                    t.warehouses.select("warehouse_id", "warehouse"), "warehouse_id")


# --- advanced (BQ-42 .. BQ-45, BQ-47, BQ-52, BQ-56) -----------------------------------

def seller_performance(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """BQ-42: amount, units, documents and mean ticket by seller."""
    return (
        doc_sales(t, lo, hi).groupBy("seller")
        .agg(rolled("net").alias("amount"), rolled("units").alias("units"),
             F.count("*").alias("documents"))
        .withColumn("mean_ticket", ratio("amount", "documents"))
    )


def _sale_lines_by_line(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """Sale lines with the line of their article.

    Joined before any grouping: a first sum by (article, something else) would be one
    more shuffle of nearly as many rows. A dominant article is split by the skew join.
    """
    return sale_lines(t, lo, hi).join(t.articles.select("article_id", "line"), "article_id")


def seasonality(t: Tables, k: int = 3) -> DataFrame:
    """BQ-43: best calendar months of each line by units."""
    sold = (_sale_lines_by_line(t).groupBy("line", F.month("day").alias("month"))
            .agg(total("units").alias("units")))
    return top_per_group(sold, "line", k, "units", "month")


def negative_margin(t: Tables) -> DataFrame:
    """BQ-44: articles with lines sold under cost, and by how much."""
    sold = t.lines.where(positive("units")).join(
        t.articles.select("article_id", "article", "cost"), "article_id")
    loss = c("units") * c("cost") - c("gross") * 100
    return (
        sold.where(loss > 0).groupBy("article_id", "article", "cost")
        .agg(F.count("*").alias("lines"), total(loss, 4).alias("loss"),
             F.min(unit_price()).alias("lowest_price"))
        .withColumn("cost", exact("cost"))
    )


def multi_criteria_articles(t: Tables, line: str, stock: float, price: float, sales: int,
                            months: int = 1) -> DataFrame:
    """BQ-45: articles of a line above a stock, a price and a number of sales."""
    since = F.add_months(t.as_of(), -months)
    wanted = t.articles.where(c("line") == line).select("article_id", "article")
    # every aggregate starts from the lines of the wanted articles only
    only = lambda df: df.join(wanted.select("article_id"), "article_id", "left_semi")
    often = (
        only(sale_lines(t, since)).groupBy("article_id").agg(F.count("*").alias("sales")).where(c("sales") > sales)
    )
    return (
        wanted.join(often, "article_id")
        .join(only(t.stock_by_article).where(c("stock") > stock), "article_id")
        .join(only(_priced(t)).where(c("price") > price), "article_id")
        .select("article_id", "article", "sales", "stock", "price")
    )


def line_yoy(t: Tables, month: str) -> DataFrame:
    """BQ-47: a month by line beside the same month a year before (JN-10)."""
    lo = F.lit(month).cast("date")
    year_before = F.add_months(lo, -12)
    in_month = (in_period(c("placed_at"), lo, F.add_months(lo, 1))
                | in_period(c("placed_at"), year_before, F.add_months(year_before, 1)))
    sold = _sale_lines_by_line(t).where(in_month)
    halved = sold.groupBy("line", (c("day") >= lo).alias("this")).agg(*halves("net"))
    return _compared(halved.groupBy("line"), c("this"), "net")


def executive_cube(t: Tables) -> DataFrame:
    """BQ-52: amount, units and lines over segment x line x zone, with all subtotals.

    Sums are taken to the base grain first, so the eightfold expansion of the cube
    works on segments x lines x zones and not on the lines of the documents.
    """
    sold = _sale_lines_by_line(t).groupBy("customer_id", "line").agg(
        F.count("*").alias("lines"), *halves("units", "net"))
    base = (
        sold.join(t.customers.select("customer_id", "segment", "nation_id"), "customer_id")
        .join(t.zones, "nation_id").groupBy("segment", "line", "zone")
        .agg(F.sum("lines").alias("n"), rolled("units").alias("u"), rolled("net").alias("m"))
    )
    return base.cube("segment", "line", "zone").agg(
        F.sum("n").alias("lines"), F.sum("u").alias("units"), F.sum("m").alias("amount"))


def sales_by_category(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """BQ-56: units and amount by article line.

    Summed to the article first: the join on the article then needs no other shuffle.
    """
    sold = sale_lines(t, lo, hi).groupBy("article_id").agg(*halves("units", "net"))
    return (
        sold.join(t.articles.select("article_id", "line"), "article_id").groupBy("line")
        .agg(rolled("units").alias("units"), rolled("net").alias("amount"))
    )
