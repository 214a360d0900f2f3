"""Queries of loads, their audit and control tables, and of small pieces that requests use."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import scores
from heddle.operators import upsert
from heddle.plans import warehouse
from heddle.queries.bindings import table
from heddle.queries.catalog import CONTROL, STAGED, _control, _staging
from heddle.queries.files import _folder
from heddle.queries.registry import query, r6
from heddle.sources import screens

#: Orders as the audit of their customer's run: a step by the order's key, its time by its price.
AUDIT = """audit AS (SELECT o_custkey AS run_id, 'step' || (o_orderkey % 5) AS step_name, o_orderkey AS step_order, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
  o_orderkey % 1000 AS rows_inserted, o_totalprice / 1000 AS seconds, CASE o_orderstatus WHEN 'F' THEN 'error ' || o_orderkey END AS error FROM orders)"""


def _audit(spark, d):
    failed = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("step"), (F.col("o_orderkey") % 5).cast("string")).alias("step_name"), F.col("o_orderkey").alias("step_order"),
        F.when(failed, "failed").otherwise("completed").alias("status"), (F.col("o_orderkey") % 1000).alias("rows_inserted"), (F.col("o_totalprice") / 1000).alias("seconds"),
        F.when(failed, F.concat(F.lit("error "), F.col("o_orderkey").cast("string"))).alias("error"),
    )


def _runs(spark, d):
    """Customers as runs of their nation's version, from their first order to their last."""
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("finished_at"))
    customer = table(spark, d, "customer").join(spans, F.col("c_custkey") == F.col("o_custkey"))
    return customer.select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("version_id"), F.col("c_mktsegment").alias("status"), "started_at", "finished_at")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def last_rows(spark, d):
    return upsert.insert_last(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


_CASED = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN upper(p_name[1]) || lower(p_name[2:]) ELSE 'x' || p_name END"


@query(f"SELECT p_partkey, {_CASED} AS symbol FROM part WHERE p_partkey % 4 != 3 AND lower(p_name) = 'hot rod'")
def symbol_in_any_case(spark, d):
    capital = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substring(p_name, 2)")))
    k = F.col("p_partkey") % 4
    symbol = F.when(k == 0, F.upper("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, capital).otherwise(F.concat(F.lit("x"), "p_name"))
    return table(spark, d, "part").select("p_partkey", symbol.alias("symbol")).filter(F.col("symbol").isin(scores.symbol_variants("hot rod")))


@query(f"""WITH {AUDIT} SELECT step_name, count(*) AS n_runs, count(*) FILTER (status != 'completed') AS n_failed, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 2) AS success_percentage, round(avg(seconds), 6) AS mean_seconds,
  round(max(seconds), 6) AS longest_seconds, CAST(sum(rows_inserted) AS BIGINT) AS n_rows, round(sum(rows_inserted) FILTER (status = 'completed') / sum(seconds) FILTER (status = 'completed'), 6) AS rows_per_second FROM audit GROUP BY 1""")
def step_statistics(spark, d):
    return warehouse.step_statistics(_audit(spark, d)).withColumns({c: r6(c) for c in ("mean_seconds", "longest_seconds", "rows_per_second")})


@query(f"""WITH {AUDIT}, spans AS (SELECT o_custkey, min(o_orderdate) AS s, max(o_orderdate) AS f FROM orders GROUP BY 1)
SELECT c_custkey AS run_id, date_diff('second', s, f) AS seconds, count(*) AS steps, count(*) FILTER (audit.status = 'failed') AS failed_steps, CAST(sum(rows_inserted) AS BIGINT) AS rows_inserted FROM customer JOIN spans ON o_custkey = c_custkey JOIN audit ON run_id = c_custkey GROUP BY 1, 2""")
def run_summary(spark, d):
    return warehouse.run_summary(_runs(spark, d), _audit(spark, d)).select("run_id", "seconds", "steps", "failed_steps", "rows_inserted")


@query(f"""WITH {CONTROL}, {AUDIT}, last AS (SELECT run_id, step_name, error FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_order DESC) AS rn FROM audit) WHERE rn = 1),
failed AS (SELECT run_id, error FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_order DESC) AS rn FROM audit) WHERE rn = 1)
SELECT c_custkey AS run_id, organism, is_current, step_name AS last_step, failed.error AS last_error FROM customer JOIN last ON last.run_id = c_custkey JOIN failed ON failed.run_id = c_custkey LEFT JOIN versions ON version_id = c_nationkey""")
def run_history(spark, d):
    found = warehouse.run_history(_runs(spark, d), _audit(spark, d), _control(spark, d)[0])
    return found.select("run_id", "organism", "is_current", "last_step", "last_error")


@query(f"WITH {CONTROL} SELECT o_orderkey FROM orders JOIN versions ON version_id = o_custkey % 25 WHERE is_current")
def current_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("version_id"))
    return warehouse.current(rows, _control(spark, d)[0]).select("o_orderkey")


@query("""SELECT 'orders' AS table_name, true AS present, true AS has_columns, count(*) > 0 AS has_rows FROM orders UNION ALL SELECT 'part', true, false, count(*) > 0 FROM part
UNION ALL SELECT 'supplier', true, true, count(*) > 0 FROM supplier WHERE s_suppkey < 0 UNION ALL SELECT 'nothing', false, false, false""")
def readiness(spark, d):
    tables = {name: table(spark, d, name) for name in ("orders", "part")} | {"supplier": table(spark, d, "supplier").filter("s_suppkey < 0")}
    return warehouse.ready(tables, {"orders": ["o_orderkey"], "part": ["p_partkey", "no such column"], "supplier": [], "nothing": []})


@query(f"""WITH {STAGED}, raw AS (SELECT count(*) AS n FROM marked WHERE validation_errors IS NULL)
SELECT step_name, CAST(step_order AS INTEGER) AS step_order, status, n AS rows_inserted FROM (
  SELECT 'staged' AS step_name, 1 AS step_order, 'completed' AS status, (SELECT count(*) FROM staged) AS n UNION ALL SELECT 'screen', 2, 'completed', (SELECT count(*) FROM screen)
  UNION ALL SELECT 'gene', 3, 'completed', (SELECT count(*) FROM gene) UNION ALL SELECT 'screen_gene_raw', 4, 'completed', (SELECT count(*) FROM pair)
  UNION ALL SELECT 'fact_screen_gene', 5, 'completed', (SELECT count(*) FROM (SELECT DISTINCT version_id, screen_id, identifier_id FROM pair))
  UNION ALL SELECT 'dim_screen', 6, 'completed', (SELECT count(*) FROM screen) UNION ALL SELECT 'dim_gene', 7, 'completed', (SELECT count(*) FROM gene))""")
def resumed_load(spark, d):
    """A load, started again under its number after it ended: every step is there once."""
    path, (staged_screens, staged, versions) = _folder(spark, "load"), _staging(spark, d)
    warehouse.run_load(staged_screens, staged, versions, path, 1)
    warehouse.run_load(staged_screens, staged, versions, path, 1)
    first = upsert.insert_last(warehouse.audit_of(spark, f"{path}/audit"), ["step_name"], [F.col("step_order")])
    return first.select("step_name", "step_order", "status", "rows_inserted")


@query("SELECT CAST(l_suppkey % 3 AS VARCHAR) AS file_screen_id, l_orderkey AS identifier_id, count(*) AS n FROM lineitem GROUP BY ALL")
def screens_of_file_names(spark, d):
    path = _folder(spark, "files")
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat_ws("\t", "l_suppkey", "l_orderkey", F.lit("g"), F.lit("NO")).alias("SCREEN_ID\tIDENTIFIER_ID\tOFFICIAL_SYMBOL\tHIT"))
    for k in range(3):
        rows.filter(F.col("l_suppkey") % 3 == k).drop("l_suppkey").write.csv(f"{path}/SCREEN_{k}", header=True, quote="", sep="\x01")
    found = screens.read_tab_files(spark, f"{path}/*")
    return found.groupBy("file_screen_id", F.col("identifier_id").cast("long").alias("identifier_id")).agg(F.count("*").alias("n"))
