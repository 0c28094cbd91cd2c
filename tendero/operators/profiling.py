"""Column profiles, exact quantiles, duplicates, row-count statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendero.functions.columns import date_like
from tendero.operators.ranking import edges_below
from tendero.session import stored

c = F.col


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns, decimals included; booleans are a kind of their own."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _kind(f: T.StructField) -> str:
    if isinstance(f.dataType, T.NumericType):
        return "numeric"
    if isinstance(f.dataType, T.StringType):
        return "text"
    if isinstance(f.dataType, T.BooleanType):
        return "boolean"
    return "other"


def frequencies(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(column, value, n) over all the columns in one scan and one shuffle.

    Counts are combined on the map side, so a value that fills a third of the rows
    costs one row per task. NULLs are left out.
    """
    cells = df.select(*[c(n).cast(as_type).alias(n) for n in columns])
    return (
        cells.unpivot([], list(columns), "column", "value").where(c("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def value_stats(freq: DataFrame, points: Mapping[str, float], cuts: int = 128) -> DataFrame:
    """Count, distinct values, ends and exact interpolated quantiles of every column.

    ``percentile`` would gather all distinct values of a column in one task. Here the
    distinct values are split into ranges at their approximate quantiles, range totals
    (``cuts`` per column) give every range its first rank, and a window inside the
    range ranks its values. The quantile at rank h = p (n - 1) lies between the values
    whose rank intervals hold floor(h) and ceil(h).
    """
    steps = [i / cuts for i in range(1, cuts)]
    block = 12
    edges = (
        freq.groupBy("column").agg(F.percentile_approx("value", steps, 2000).alias("edges"),
                                   F.sum("n").alias("total"))
        .withColumn("lasts", F.filter("edges", lambda e, i: i % block == block - 1))
    )
    placed = (
        freq.join(F.broadcast(edges), "column")
        .withColumn("range", edges_below(c("edges"), c("lasts"), block, c("value")))
        .drop("edges", "lasts")
    )
    before = (Window.partitionBy("column").orderBy("range")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        placed.groupBy("column", "range").agg(F.sum("n").alias("held"))
        .withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    )
    inside = (Window.partitionBy("column", "range").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        placed.join(F.broadcast(offsets), ["column", "range"])
        .withColumn("after", c("start") + F.sum("n").over(inside))
        .withColumn("before", c("after") - c("n"))
    )
    picks = []
    for name, p in points.items():
        h = F.lit(float(p)) * (c("total") - 1)
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (c("before") <= rank) & (rank < c("after"))
            picks.append(F.max(F.when(hit, c("value"))).alias(f"{name}_{side}"))
    found = ranked.groupBy("column").agg(
        F.first("total").alias("total"), F.count("*").alias("unique"), F.min("value").alias("min"),
        F.max("value").alias("max"), *picks)
    values = []
    for name, p in points.items():
        h = F.lit(float(p)) * (c("total") - 1)
        lo, hi = c(f"{name}_lo"), c(f"{name}_hi")
        values.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select("column", c("total").alias("non_null"), "unique", "min", "max", *values)


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each column: one pass, one row turned to rows."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.avg(c(n).cast("double")).alias("mean"),
                 F.stddev_samp(c(n).cast("double")).alias("std")) for n in columns])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, distinct values, statistics, mode (PRF-1 .. PRF-4).

    ``most_frequent`` is the smallest of the most common texts. ``potential_date`` is
    true when every text of the column starts like a date.
    """
    spark = df.sparkSession
    numeric = numeric_columns(df)
    rest = [n for n in df.columns if n not in numeric]
    fields = [(i, f.name, f.dataType.simpleString(), _kind(f)) for i, f in enumerate(df.schema.fields)]
    out = spark.createDataFrame(fields, "position int, column string, type string, kind string")
    out = out.withColumn("rows", df.agg(F.count("*")).scalar())
    parts = []
    if numeric:
        freq = stored(frequencies(df, numeric, "double"), "frequencies")
        parts.append(value_stats(freq, {"median": 0.5}).join(_moments(df, numeric), "column"))
    if rest:
        freq = frequencies(df, rest, "string")
        parts.append(freq.groupBy("column").agg(
            F.sum("n").alias("non_null"), F.count("*").alias("unique"),
            F.min_by("value", F.struct(-c("n"), "value")).alias("most_frequent"),
            F.bool_and(date_like("value")).alias("potential_date")))
    stats = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name in ("min", "max", "median", "mean", "std"):
        if name not in stats.columns:
            stats = stats.withColumn(name, F.lit(None).cast("double"))
    if "most_frequent" not in stats.columns:
        stats = (stats.withColumn("most_frequent", F.lit(None).cast("string"))
                 .withColumn("potential_date", F.lit(None).cast("boolean")))
    text = c("kind") == "text"
    non_null = F.coalesce("non_null", F.lit(0))
    return (
        out.join(stats, "column", "left")
        .select("column", "position", "type", "kind", non_null.alias("non_null"),
                (c("rows") - non_null).alias("nulls"), F.coalesce("unique", F.lit(0)).alias("unique"),
                "min", "max", "mean", "median", "std",
                F.when(text, c("most_frequent")).alias("most_frequent"),
                F.when(text, F.coalesce("potential_date", F.lit(False))).alias("potential_date"))
        .orderBy("position")
    )


def _short(df: DataFrame) -> DataFrame:
    """``df`` with 256-bit digests in place of its texts: grouping keys of a fixed size."""
    return df.select(*[F.sha2(c(f"`{f.name}`"), 256).alias(f.name) if isinstance(f.dataType, T.StringType) else c(f"`{f.name}`")
                       for f in df.schema.fields])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one over all columns (PRF-6, SET-4)."""
    same = _short(df).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return same.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                    F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("duplicates"))


def summary(df: DataFrame) -> DataFrame:
    """Completeness, duplicates, number of numeric and text columns (PRF-5, PRF-6)."""
    nulls = reduce(lambda a, b: a + b, [c(n).isNull().cast("long") for n in df.columns])
    same = _short(df).groupBy(*df.columns).agg(F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"))
    width = len(df.columns)
    totals = same.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("duplicates"),
                      F.coalesce(F.sum("_nulls"), F.lit(0)).alias("nulls"))
    pct = (1 - F.try_divide(c("nulls").cast("double"), c("rows") * width)) * 100
    return totals.select(
        "rows", F.lit(width).alias("columns"), pct.alias("completeness"),
        F.concat(F.format_number(pct, 1), F.lit("%")).alias("completeness_label"), "duplicates",
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("text_columns"))


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of numeric columns (PRF-7)."""
    numeric = numeric_columns(df)
    freq = stored(frequencies(df, numeric, "double"), "frequencies")
    values = value_stats(freq, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (
        values.join(_moments(df, numeric), "column")
        .select("column", c("non_null").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")
    )


# --- row-count statistics ------------------------------------------------------

def table_stats(tables: Mapping[str, DataFrame], counted_at: str | Column | None = None) -> DataFrame:
    """Rows and columns of every table; counts come from the file footers (PRF-15)."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        for name, df in tables.items()]
    stats = reduce(DataFrame.unionByName, parts)
    if counted_at is not None:
        at = F.lit(counted_at) if isinstance(counted_at, str) else counted_at
        stats = stats.withColumn("counted_at", at.cast("timestamp"))
    return stats


def freshness(stats: DataFrame, as_of: str | Column, ttl_hours: float = 12) -> DataFrame:
    """Age of each count and whether it is older than its time to live (PRF-16)."""
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    age = (F.unix_timestamp(now) - F.unix_timestamp("counted_at")) / 3600
    return stats.withColumn("age_hours", age).withColumn("stale", age > ttl_hours)


def refresh_stats(stored: DataFrame, tables: Mapping[str, DataFrame], as_of: str,
                  ttl_hours: float = 12, force: bool = False) -> DataFrame:
    """Recount stale and unknown tables only, keep the other counts (PRF-15).

    The list of names read back is one row per table of the catalog.
    """
    fresh = freshness(stored, as_of, ttl_hours).where(~c("stale"))
    keep = set() if force else {r.table_name for r in fresh.select("table_name").collect()}
    todo = {n: df for n, df in tables.items() if n not in keep}
    kept = stored.where(c("table_name").isin(sorted(keep)))
    return kept.unionByName(table_stats(todo, as_of)) if todo else kept


def schema_stats(catalog: DataFrame) -> DataFrame:
    """Totals over a table catalog; a count of -1 means unknown (AGG-15)."""
    known = c("row_count") > 0
    return catalog.agg(
        F.count("*").alias("total_tables"), F.count_if("active").alias("active_tables"),
        F.count_if(~c("active")).alias("inactive_tables"),
        F.coalesce(F.sum(F.when(known, c("row_count"))), F.lit(0)).alias("total_rows"),
        F.count_if(known).alias("tables_with_data"),
        F.count_if(F.size("foreign_keys") > 0).alias("tables_with_foreign_keys"))


# --- keys and references ----------------------------------------------------------

def key_uniqueness(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """For every declared key: key values, repeated ones, rows with a NULL in it (SRC-8)."""
    parts = []
    for name, cols in keys.items():
        has_null = reduce(lambda a, b: a | b, [c(k).isNull() for k in cols])
        seen = tables[name].groupBy(*cols).agg(F.count("*").alias("_n"))
        parts.append(
            seen.agg(F.count("*").alias("key_values"), F.count_if(c("_n") > 1).alias("repeated"),
                     F.coalesce(F.sum(F.when(has_null, c("_n"))), F.lit(0)).alias("null_rows"))
            .select(F.lit(name).alias("table_name"), F.lit(", ".join(cols)).alias("key_columns"),
                    "key_values", "repeated", "null_rows"))
    return reduce(DataFrame.unionByName, parts)


def fk_integrity(tables: Mapping[str, DataFrame], edges) -> DataFrame:
    """For every declared reference: rows, and rows whose target is missing (SRC-9).

    References are counted per value before the join, so a value that holds a third
    of the rows meets its target once.
    """
    parts = []
    for table, cols, target, target_cols in edges:
        values = (tables[table].dropna("any", subset=list(cols)).groupBy(*cols)
                  .agg(F.count("*").alias("_n")))
        targets = tables[target].select(*[c(b).alias(f"_{i}") for i, b in enumerate(target_cols)],
                                        F.lit(1).alias("_found")).distinct()
        on = reduce(lambda a, b: a & b, [c(a) == c(f"_{i}") for i, a in enumerate(cols)])
        found = values.join(targets, on, "left")
        parts.append(
            found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.when(c("_found").isNull(), c("_n"))), F.lit(0)).alias("orphans"))
            .select(F.lit(table).alias("table_name"), F.lit(", ".join(cols)).alias("columns"),
                    F.lit(target).alias("referenced_table"),
                    F.lit(", ".join(target_cols)).alias("referenced_columns"), "rows", "orphans"))
    return reduce(DataFrame.unionByName, parts)
