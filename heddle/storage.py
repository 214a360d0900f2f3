"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_SHARED_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, which ``spark.checkpoint.dir`` names; on a cluster it has to."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = (top or LOCAL_SHARED_DIR).rstrip("/")
    return f"{top}/heddle-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: what is lost later is read again, not computed again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(before: DataFrame, df: DataFrame, tag: str) -> DataFrame:
    """``df`` as ``written``; then the table ``before``, also ``written``, which nothing but ``df`` reads, is deleted."""
    found = written(df, tag)
    for file in before.inputFiles()[:1]:
        remove(df.sparkSession, file.rsplit("/", 1)[0])
    return found


def clean(spark: SparkSession) -> bool:
    """Delete all tables that this application has written so; results that read them must be stored before."""
    return remove(spark, shared_dir(spark))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all that it holds; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
