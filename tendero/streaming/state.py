"""Structured Streaming forms of the incremental updates.

Session state is a keyed table with snapshots: every micro-batch merges the sessions it touches
into it, under its own tag, so a batch that is run again after a failure changes nothing.
Count, newest message and role commute, so late messages count wherever they belong. What the stream
itself remembers are the messages of the last ``delay`` (the watermark), to drop repeats; older
ones leave the state, and a message that comes later than that is refused and counted as such.

Usage counters have a handful of keys; each micro-batch stores them in a folder of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tendero.operators.querylog import complexity
from tendero.session import stored
from tendero.sources.snapshots import SnapshotTable

c = F.col


def stream_table(spark: SparkSession, root: str, name: str, schema: StructType | str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream of its files.

    Nothing under that name is an error of the reader.
    """
    path = f"{root}/{name}.parquet"
    stored_rows = spark.read.parquet(path)
    reader = spark.readStream.schema(stored_rows.schema if schema is None else schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in stored_rows.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return reader.parquet(path)


def session_state(messages: DataFrame) -> DataFrame:
    """Messages, last time and last role of every session (STR-1)."""
    order = F.struct("at", "seq")
    return messages.groupBy("session").agg(
        F.count("*").alias("messages"), F.max("at").alias("updated_at"),
        F.max_by("role", order).alias("last_role"))


SESSIONS = "session long, messages long, updated_at timestamp, seq long, last_role string"
FOLD_AFTER = 16  # deltas of the session table that are folded into a new base


def merge_sessions(store: SnapshotTable, messages: DataFrame, tag: str | None = None) -> None:
    """Adds messages (session, at, seq, role) to the stored sessions; only sessions of the batch are read and written."""
    newest = F.struct(F.col("updated_at"), F.col("seq"), F.col("last_role"))
    added = messages.groupBy("session").agg(
        F.count("*").alias("messages"), F.max(F.struct(c("at").cast("timestamp").alias("updated_at"), c("seq").cast("long").alias("seq"), c("role").alias("last_role"))).alias("_n"))
    # stored: the batch's own plan, with the stream's state in it, must run once
    added = stored(added.select(c("session").cast("long"), "messages", "_n.*"), "batch")
    old = store.read().join(added.select(c("session").alias("_s")), c("session").eqNullSafe(c("_s")), "left_semi")
    both = old.unionByName(added).groupBy("session").agg(F.sum("messages").alias("messages"), F.max(newest).alias("_n"))
    store.upsert(both.select("session", "messages", "_n.*"), tag=tag)
    if len(store.manifest()["deltas"]) > FOLD_AFTER:
        store.compact()


@dataclass
class SessionRun:
    """Stored sessions after a run, and what the stream still remembers."""

    sessions: DataFrame
    remembered: int  # messages kept to recognise repeats
    refused: int  # messages of this run that came after the delay


def run_sessions(messages: DataFrame, folder: str, delay: str = "30 days") -> SessionRun:
    """Process what is there, then stop: sessions under ``folder``/sessions are up to date (STR-1).

    ``messages``: stream of session, at, seq, role. A repeat is a message with the session
    and seq of an earlier one.
    """
    spark = messages.sparkSession
    store = SnapshotTable.create(spark, f"{folder}/sessions", SESSIONS, ["session"])

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_sessions(store, batch, tag=f"batch {batch_id}")

    once = messages.withColumn("at", c("at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["session", "seq"])
    query = (once.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    return SessionRun(store.read().drop("seq"), steps[-1]["numRowsTotal"] if steps else 0, sum(s["numRowsDroppedByWatermark"] for s in steps))


def tier_usage(questions: DataFrame) -> DataFrame:
    """Questions per tier so far (STR-2)."""
    return complexity(questions, "question").groupBy("tier").agg(F.count("*").alias("questions"))


def run_to_end(state: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process what is there, then stop; returns the stored change log."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    query = (state.writeStream.outputMode(mode).foreachBatch(store)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return state.sparkSession.read.parquet(f"{folder}/changes")


def current(changes: DataFrame, key: str) -> DataFrame:
    """The newest stored state of each key."""
    rest = [n for n in changes.columns if n not in (key, "batch")]
    return (changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
            .select(key, "s.*"))


def export_new(rows: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Append the rows that arrived since the last run (STR-3)."""
    query = (rows.writeStream.format(fmt).outputMode("append").option("header", True)
             .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{folder}/rows"
