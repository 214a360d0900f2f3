"""Rows made of a small file, or joined with one, are not all one task's."""

from pyspark.sql import functions as F

from heddle.queries.catalog import QUERIES


def test_prediction_verdicts_are_dealt_by_gene(spark, sf_dir):
    rows = QUERIES["prediction_verdicts"](spark, sf_dir).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(rows) > 2 and max(r["count"] for r in rows) < 0.6 * sum(r["count"] for r in rows)


def test_gene_details_broadcast_no_hits(spark, sf_dir):
    plan = QUERIES["gene_details"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan and "BuildLeft" not in plan


def test_upload_signals_parse_each_file_once(spark, sf_dir):
    plan = QUERIES["upload_signals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
