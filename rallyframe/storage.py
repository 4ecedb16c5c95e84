"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder of this application under spark.checkpoint.dir.

    Where the session has none, a local master gets a temporary one; any other is told to set it, as its executors have
    no folder in common.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder; results not yet written are lost."""
    remove(spark, shared_dir(spark).rpartition("/")[0])


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and no executor's loss loses it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def add_rows(df: DataFrame, path: str, **options: str) -> None:
    """Add rows to a table, in a folder of their own that gets its name when it is whole, so writers don't meet.

    The table has the further column `added`. (Writers that append to one folder would share Spark's temporary one.)
    """
    jvm, name = df.sparkSession._jvm, uuid.uuid4().hex
    before, after = f"{path}/_adding/{name}", f"{path}/added={name}"
    df.write.options(**options).parquet(before)
    folder = jvm.org.apache.hadoop.fs.Path(before)
    store = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if not store.rename(folder, jvm.org.apache.hadoop.fs.Path(after)):
        raise OSError(f"cannot move {before} to {after}")
