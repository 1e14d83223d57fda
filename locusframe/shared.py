"""Checkpoints in the folder that all executors reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new one in local mode; on a cluster an error, as
    a folder of one machine would hold a part of what is written."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is now, whatever happens to executors. Spark removes the files when nothing refers to the result
    (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
