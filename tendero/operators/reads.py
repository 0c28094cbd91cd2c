"""Bounded reads: preview with a "has more" flag, pages, samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def preview(df: DataFrame, limit: int, order: list[str | Column]) -> DataFrame:
    """The first ``limit`` rows and whether there are more (SRC-1).

    limit + 1 rows are taken by a top-k (a bounded heap per task), then ranked; the
    window and the flag see those rows only.
    """
    taken = df.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    return (
        taken.withColumn("_n", F.row_number().over(w))
        .withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
        .where(F.col("_n") <= limit).drop("_n")
    )


def page(df: DataFrame, skip: int, rows: int, order: list[str | Column]) -> DataFrame:
    """Rows ``skip`` .. ``skip + rows`` of an order (ORD-5)."""
    return df.orderBy(*order).offset(skip).limit(rows)


def batches(df: DataFrame, rows: int = 5000) -> Iterator[list[Row]]:
    """A result in batches for a consumer on the driver (SRC-2).

    One partition is held at a time. Files are written by ``reports.export`` instead.
    """
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def sample_rows(df: DataFrame, rows: int, order: list[str | Column]) -> DataFrame:
    """The first rows of a stated order (SRC-3)."""
    return df.orderBy(*order).limit(rows)


def sample_text(df: DataFrame, rows: int, order: list[str | Column], columns: int = 20,
                width: int = 50) -> DataFrame:
    """A sample as short text: 20 columns, NULL as "NULL", long strings cut (SRC-4)."""
    kept = df.schema.fields[:columns]
    cells = []
    for f in kept:
        value = F.col(f.name).cast("string")
        if isinstance(f.dataType, T.StringType):
            value = F.when(F.length(value) > width,
                           F.concat(F.substring(value, 1, width - 3), F.lit("..."))).otherwise(value)
        cells.append(F.coalesce(value, F.lit("NULL")).alias(f.name))
    return df.orderBy(*order).limit(rows).select(cells)
