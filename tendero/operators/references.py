"""References found in the data: which columns hold only values of a unique column.

Two passes. One aggregate per table takes smallest and greatest value and a distinct sketch of every
column of a kind; pairs whose ranges or sketches rule an inclusion out are dropped there (columns
against columns: as many rows as there are columns). Then one grouped sweep over the different
values of the remaining columns: a value's group is the set of columns that hold it, equal sets are
counted once, and a column lies in another one when they share as many values as it has.
No pair of columns is joined value by value.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.session import stored

c = F.col

INTEGRAL = ("byte", "short", "integer", "long")
LG_K = 12  # a sketch of 4096 registers: 1.6 % standard error
MARGIN = 1.10  # six standard errors: a true inclusion is never dropped by its sketch in practice


def column_sketches(tables: Mapping[str, DataFrame], types: tuple[str, ...] = INTEGRAL) -> DataFrame:
    """(kind, table_name, column, filled, low, high, sketch) of every column of the given types; one scan per table."""
    parts = []
    for name, df in tables.items():
        names = [f.name for f in df.schema.fields if f.dataType.typeName() in types]
        if not names:
            continue
        facts = [F.struct(F.lit("whole").alias("kind"), F.lit(name).alias("table_name"), F.lit(n).alias("column"), F.count(c(n)).alias("filled"),
                          F.min(c(n).cast("long")).alias("low"), F.max(c(n).cast("long")).alias("high"),
                          F.hll_sketch_agg(c(n).cast("long"), LG_K).alias("sketch")) for n in names]
        parts.append(df.agg(F.array(*facts).alias("facts")).select(F.inline("facts")))
    return reduce(DataFrame.unionByName, parts).where("filled > 0")


def possible(columns: DataFrame) -> DataFrame:
    """Pairs of columns that ranges and sketches allow: (a_table, a_column, b_table, b_column)."""
    a = columns.select(*[c(n).alias(f"a_{n}") for n in columns.columns if n != "kind"], "kind")
    b = columns.select(*[c(n).alias(f"b_{n}") for n in columns.columns if n != "kind"], "kind")
    both = F.hll_sketch_estimate(F.hll_union("a_sketch", "b_sketch"))
    return (
        a.join(b, "kind")  # as many rows as there are columns, on both sides
        .where((c("a_table_name") != c("b_table_name")) | (c("a_column") != c("b_column")))
        .where((c("a_low") >= c("b_low")) & (c("a_high") <= c("b_high")) & (both <= F.hll_sketch_estimate("b_sketch") * MARGIN + 1))
        .select(c("a_table_name").alias("a_table"), "a_column", c("b_table_name").alias("b_table"), "b_column"))


def inclusions(tables: Mapping[str, DataFrame], types: tuple[str, ...] = INTEGRAL) -> DataFrame:
    """(table_name, column, referenced_table, referenced_column, values, referenced_values) of every
    column whose values all stand in a column without repeats."""
    pairs = stored(possible(stored(column_sketches(tables, types), "sketches")), "pairs")
    # names of columns only
    wanted = {(r[0], r[1]) for r in pairs.select("a_table", "a_column").union(pairs.select("b_table", "b_column")).distinct().collect()}
    spark = pairs.sparkSession
    schema = "table_name string, column string, referenced_table string, referenced_column string, values long, referenced_values long"
    if not wanted:
        return spark.createDataFrame([], schema)
    parts = []
    for name, df in tables.items():
        held = [n for n in df.columns if (name, n) in wanted]
        if held:
            cells = F.explode(F.array(*[F.struct(F.lit(f"{name}.{n}").alias("col"), c(n).cast("long").alias("value")) for n in held]))
            parts.append(df.select(cells.alias("cell")).select("cell.*").where("value is not null"))
    # repeats meet before the shuffle, so a value that fills a third of a table is one row per task
    counted = stored(reduce(DataFrame.unionByName, parts).groupBy("col", "value").agg(F.count("*").alias("n")), "values")
    size = counted.groupBy("col").agg(F.count("*").alias("size"), F.max("n").alias("most"))
    sets = counted.groupBy("value").agg(F.sort_array(F.collect_set("col")).alias("cols")).groupBy("cols").agg(F.count("*").alias("n"))
    shared = (sets.select("cols", "n", F.explode("cols").alias("a")).select("n", "a", F.explode("cols").alias("b")).where("a != b")
              .groupBy("a", "b").agg(F.sum("n").alias("shared")))
    named = pairs.select(F.concat_ws(".", "a_table", "a_column").alias("a"), F.concat_ws(".", "b_table", "b_column").alias("b"),
                         c("a_table").alias("table_name"), c("a_column").alias("column"),
                         c("b_table").alias("referenced_table"), c("b_column").alias("referenced_column"))
    return (
        named.join(shared, ["a", "b"]).join(size.select(c("col").alias("a"), c("size").alias("values")), "a")
        .join(size.where("most = 1").select(c("col").alias("b"), c("size").alias("referenced_values")), "b")
        .where(c("shared") == c("values")).select(*[x.split()[0] for x in schema.split(", ")]))


def plain_name(name: Column) -> Column:
    """A column's name without a table's prefix of one or two letters."""
    return F.regexp_replace(name, "^[a-z]{1,2}_", "")


def found_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Inclusions in a column of the same name in another table: what a reference looks like in data."""
    return inclusions(tables).where(
        (c("table_name") != c("referenced_table")) & (plain_name(c("column")) == plain_name(c("referenced_column"))))
