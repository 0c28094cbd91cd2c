"""Report sinks: files by format, exports with a count, reports of four datasets."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tendero.operators.profiling import describe, numeric_columns, profile, summary

FORMATS = ("csv", "json", "parquet")
STAMP = "yyyy-MM-dd HH:mm:ss"


def export(df: DataFrame, path: str, fmt: str = "csv", rows_per_file: int = 5_000_000) -> int:
    """Write a result and return its rows, counted while it is written (SNK-1, 2, 4, 7).

    An existing path is never overwritten. CSV has a header, NULL is empty and times
    are to the second; JSON is one record per line.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: one of {', '.join(FORMATS)}")
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    out = out.option("maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        out = (out.option("header", True).option("nullValue", "").option("emptyValue", "")
               .option("timestampFormat", STAMP).option("timestampNTZFormat", STAMP))
    elif fmt == "json":
        out = out.option("ignoreNullFields", False)
    out.format(fmt).save(path)
    return seen.get["rows"]


def metadata(spark: SparkSession, columns: list[str], rows: int, seconds: float,
             has_more: bool = False) -> DataFrame:
    """One row about a result (PRF-14)."""
    return spark.range(1).select(
        F.lit(rows).cast("long").alias("rows"), F.lit(float(seconds)).alias("seconds"),
        F.lit(has_more).alias("has_more"), F.lit(", ".join(columns)).alias("columns"),
        F.date_format(F.current_timestamp(), STAMP).alias("generated_at"))


def write_report(df: DataFrame, folder: str, fmt: str = "csv", analysis: bool = True,
                 has_more: bool = False) -> dict[str, str]:
    """Data, analysis, numeric summary and metadata under one folder (SNK-3).

    The data is computed once: the analysis reads the stored rows (kept as parquet
    next to the chosen format), not the query again.
    """
    spark = df.sparkSession
    started = time.time()
    stored = f"{folder}/stored"
    rows = export(df, stored, "parquet")
    seconds = time.time() - started
    data = spark.read.parquet(stored)
    paths = {"data": stored}
    if fmt != "parquet":
        paths["data"] = f"{folder}/data"
        export(data, paths["data"], fmt)
    if analysis:
        for name, part in (("analysis", summary(data)), ("columns", profile(data))):
            paths[name] = f"{folder}/{name}"
            export(part, paths[name], fmt)
        if rows and numeric_columns(data):
            paths["numbers"] = f"{folder}/numbers"
            export(describe(data), paths["numbers"], fmt)
    paths["metadata"] = f"{folder}/metadata"
    export(metadata(spark, df.columns, rows, seconds, has_more), paths["metadata"], fmt)
    return paths
