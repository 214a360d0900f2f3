"""Screens that keep arriving: staged as files come, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.upsert import replace_partitions


def stage_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str, version_col: str = "version_id") -> StreamingQuery:
    """Append arriving Parquet files to the staging table, partitioned by version; ends when all that is there is taken.

    A batch that is run again replaces its own part, named by the batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(batch_id)), target, [version_col, "batch"])

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) per window and type; events later than ``late`` behind the newest are dropped in a stream."""
    watermarked = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        watermarked = watermarked.withWatermark("ts", late)
    return (
        watermarked.groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
