"""Widening of an empty date window (FLT-22): 90, 180, 365 days, then all."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.functions.predicates import SALE_EXCLUSIONS, positive, trailing
from tendero.operators.sales import latest_lines, real_lines, sale_docs
from tendero.sources.tables import Tables

c = F.col

STEPS = (90, 180, 365)
# The note shown for each step.
NOTES = {
    90: None,
    180: "Amplié la búsqueda a los últimos 6 meses",
    365: "Amplié la búsqueda al último año completo",
    None: "Amplié la búsqueda a TODOS los registros históricos (sin filtro de fecha)",
}


def first_non_empty(make: Callable[[int | None], DataFrame], steps: Sequence[int] = STEPS,
                    unbounded: bool = True) -> tuple[DataFrame, int | None]:
    """The result of the first window that has rows, and its length in days.

    A probe stops at the first row it finds, so the usual case reads the short
    window only. Without ``unbounded`` (any question but "the last ...") the
    longest window is the answer even when it is empty.
    """
    for days in steps:
        found = make(days)
        if not found.isEmpty():
            return found, days
    if unbounded:
        return make(None), None
    return make(steps[-1]), steps[-1]


def widened_last_sale(t: Tables, exclusions: Sequence[str] = SALE_EXCLUSIONS,
                      k: int = 1) -> DataFrame:
    """BQ-54: the last sale, looking further back only while nothing is found."""
    def make(days: int | None) -> DataFrame:
        docs = sale_docs(t)
        if days is not None:
            docs = docs.where(trailing(c("placed_at"), t.as_of(), days))
        lines = docs.join(t.lines.where(positive("units", "net")), "doc_id")
        return real_lines(t, lines, exclusions)

    found, _ = first_non_empty(make)
    return latest_lines(t, found, k)


def widen_by_key(df: DataFrame, moment: str, keys: list[str], as_of: Column,
                 steps: Sequence[int] = STEPS, unbounded: bool = True) -> DataFrame:
    """For every key, its rows of the shortest window that holds any.

    Which window that is depends on the key's newest row alone: one aggregation
    decides for all keys, one join filters. Adds ``days`` (NULL = no limit).
    """
    newest = df.groupBy(*keys).agg(F.max(moment).alias("_newest"))
    days = F.lit(None).cast("int")
    for step in sorted(steps, reverse=True):
        days = F.when(trailing(c("_newest"), as_of, step), F.lit(step)).otherwise(days)
    chosen = newest.withColumn("days", days).drop("_newest")
    if not unbounded:
        chosen = chosen.where(c("days").isNotNull())
    edge = F.date_sub(as_of, c("days")).cast("timestamp_ntz")
    return df.join(chosen, keys).where(c("days").isNull() | (c(moment) >= edge))

