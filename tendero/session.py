"""Session settings shared by tests, the bench and small local jobs.

On a cluster the session is the caller's: nothing in the library changes the
settings of a session it is given.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tendero", cores: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session with AQE, UTC and a small shuffle width."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Dlog4j.logLevel=error")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own where it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.mkdtemp(prefix="tendero-"), "checkpoint")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of a frame written to the shared folder and read back.

    For frames that several branches of a plan use: they are computed once, and a
    lost executor costs a re-read, not the whole lineage.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(frame: DataFrame) -> None:
    """Remove the files of a ``stored`` frame that nothing reads any more."""
    files = frame.inputFiles()
    if files:
        spark = frame.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
