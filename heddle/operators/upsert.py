"""Upserts and partition rewrites on Parquet, which has no MERGE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.windows import first_per_key
from heddle.storage import exists, shared_dir, written


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and those of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``old`` rows, and the first of ``new`` per key that ``old`` lacks."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(first_per_key(fresh, keys, order))


def insert_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last to come, as ``order`` (descending) says."""
    return first_per_key(rows, keys, order)


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose key is not done; null keys are never done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df``, replacing exactly the partitions that it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write ``df`` as a table of ``buckets`` partitions, by a hash of its keys, for ``upsert_buckets``."""
    _bucketed(df, keys, buckets).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def upsert_buckets(new: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[list[int], list[int]]:
    """``upsert`` into a table of ``write_buckets``: the buckets that were rewritten, and those that rows were appended to.

    Only the keys of the buckets that ``new`` has rows for are read. A bucket that holds one of the new keys is rewritten; to one that holds
    none, rows are appended; the files of all others stay. A run that broke off is finished by running it again. Null keys
    are never the same as others. What reaches the driver are numbers of buckets.
    """
    spark = new.sparkSession
    given = written(_bucketed(new, keys, buckets), "upsert")
    old = spark.read.schema(given.schema).parquet(path)
    numbers = lambda df: sorted(r[0] for r in df.select("_bucket").distinct().collect())
    hit = numbers(given)
    changed = numbers(old.filter(F.col("_bucket").isin(hit)).select(*keys, "_bucket").join(given.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi"))
    here = F.col("_bucket").isin(changed)
    if changed:
        merged = written(upsert(old.filter(here), given.filter(here), keys).select(given.columns), "merged")
        replace_partitions(merged.repartition("_bucket"), path, ["_bucket"])
    fresh = [b for b in hit if b not in changed]
    if fresh:
        given.filter(F.col("_bucket").isin(fresh)).repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
    return changed, fresh


def append_batches(work: DataFrame, path: str, key: str, batches: int) -> int:
    """Append in batches of whole keys, leaving out keys that ``path`` has; returns the batches written.

    A load that broke off is resumed by running it again.
    """
    spark = work.sparkSession
    todo = still_to_do(work, spark.read.parquet(path), [key]) if exists(spark, path) else work
    # dealt once into partitions on disk, of which each batch reads its own
    dealt = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    todo.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).write.partitionBy("_batch").parquet(dealt)
    held = spark.read.schema(todo.schema.add("_batch", "integer")).parquet(dealt)
    numbers = [r[0] for r in held.select("_batch").distinct().orderBy("_batch").collect()]
    for number in numbers:
        held.filter(F.col("_batch") == number).drop("_batch").write.mode("append").parquet(path)
    return len(numbers)


def duplicate_files(files: DataFrame) -> DataFrame:
    """Groups of files of the same content: ``files`` is what the binaryFile source reads.

    Only files whose length occurs twice are hashed.
    """
    lengths = files.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1")
    hashed = files.join(lengths.select("length"), "length", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256"))
    return hashed.groupBy("length", "sha256").agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)
