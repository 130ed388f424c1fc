"""Tables that Spark jobs leave for later jobs: written once to the shared folder, so that branches of a plan share them and
a lost executor costs its tasks only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, notebooks).
LOCAL_FOLDER = "/tmp/checkpoints"
#: Rows that a task sorts, about.
TASK_ROWS = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset a local one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def settled(df: DataFrame, name: str, kept: list[DataFrame] | None = None) -> DataFrame:
    """df as a Parquet table of its own; kept: a list that remembers it for forget()."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tallywheel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if kept is not None:
        kept.append(out)
    return out


def tasks_for(rows: DataFrame) -> int:
    """How many tasks rows are dealt to, so that what one of them sorts doesn't grow with the table (it counts the rows, which
    a Parquet table knows)."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def forget(*tables: DataFrame) -> None:
    """Deletes tables that settled() made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
