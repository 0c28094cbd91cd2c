"""Running totals, ABC classes, latest rows, shares of a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendero.functions.columns import ratio, total
from tendero.operators.sales import Bound, sale_lines
from tendero.session import stored
from tendero.sources.tables import Tables

c = F.col


def edges_below(edges: Column, lasts: Column, block: int, value: Column) -> Column:
    """How many of the sorted edges lie below a value, looked up block by block.

    ``lasts`` holds the last edge of each full block of ``block`` edges.
    """
    blocks = F.size(F.filter(lasts, lambda e: e < value))
    near = F.slice(edges, blocks * block + 1, F.lit(block))
    return blocks * block + F.size(F.filter(near, lambda e: e < value))


def _numbers(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'double({float(v)!r})' for v in values)})")


def _below(edges: list[float], value: Column, block: int = 16) -> Column:
    return edges_below(_numbers(edges), _numbers(edges[block - 1::block]), block, value)


def running_total(df: DataFrame, value: str, key: str, cuts: int = 256) -> DataFrame:
    """Adds ``running``: sum of ``value`` over the rows up to this one, largest first.

    Order is (value as double desc, key asc) over the whole frame. A window without
    partitions would sort everything in one task, so rows are split into consecutive
    ranges of the order at approximate quantiles of the value; a value so common that
    it spans several quantiles is split further at quantiles of the (numeric) key.
    The quantiles are at most 2 x ``cuts`` numbers; the range sums give every range
    its offset. The frame is stored once, then read by each of these steps.
    """
    df = stored(df.withColumn("_v", -c(value).cast("double")), "running")
    steps = [i / cuts for i in range(1, cuts)]
    found = df.agg(F.percentile_approx("_v", steps, 4000).alias("v"),
                   F.percentile_approx(key, steps, 4000).alias("k")).first()
    edges, key_edges = sorted(found.v or []), sorted(found.k or [])
    common = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    part = F.lit(0)
    if common:
        part = F.when(c("_v").isin(common), _below(key_edges, c(key).cast("double"))).otherwise(part)
    placed = df.withColumn("_range", _below(edges, c("_v"))).withColumn("_part", part)
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", "_part").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    )
    inside = (Window.partitionBy("_range", "_part").orderBy("_v", key)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.join(F.broadcast(offsets), ["_range", "_part"])
        .withColumn("running", c("_offset") + F.sum(value).over(inside))
        .drop("_v", "_range", "_part", "_offset")
    )


def abc_class(share_before: Column, a: float = 0.80, b: float = 0.95) -> Column:
    return (F.when(share_before < a, F.lit("A")).when(share_before < b, F.lit("B"))
            .otherwise(F.lit("C")))


def abc(t: Tables, lo: Bound = None, hi: Bound = None) -> DataFrame:
    """BQ-40, WIN-8: class of each article by the share of sales before it.

    Sale amounts are positive, so the largest running sum is the total.
    """
    sold = sale_lines(t, lo, hi).groupBy("article_id").agg(total("net").alias("amount"))
    ranked = running_total(sold, "amount", "article_id")
    ranked = ranked.withColumn("total", ranked.agg(F.max("running")).scalar())
    return (
        ranked.withColumn("share", ratio("running", "total"))
        .withColumn("class", abc_class(ratio(c("running") - c("amount"), "total")))
        .join(t.articles.select("article_id", "article"), "article_id")
        .select("article_id", "article", "amount", "share", "class")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key (WIN-9), as a max with map-side combine.

    ``order`` must be unique within the key for a fixed result.
    """
    rest = [n for n in df.columns if n not in keys and n not in order]
    best = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def shares(df: DataFrame, by: str, count: str = "rows", places: int = 1) -> DataFrame:
    """Rows per group with their percentage of all rows (AGG-13).

    The total is a scalar over the grouped counts; no rows give no groups.
    """
    grouped = df.groupBy(by).agg(F.count("*").alias(count))
    rows = grouped.agg(F.sum(count)).scalar()
    pct = F.round(F.try_divide(c(count) * 100.0, rows), places)
    return grouped.withColumn("percentage", pct)
