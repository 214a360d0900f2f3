"""The versioned warehouse: staging to dimensions and facts, control of versions, and its reports.

Each step is one lazy plan from DataFrames to a DataFrame. What is current follows from the control table alone;
facts and dimensions carry their version and no flag of their own.
"""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.fixed_values import ROW_BYTES
from heddle.operators.upsert import replace_partitions
from heddle.operators.windows import best_observation, first_per_key
from heddle.storage import exists, remove

MISSING_SCREEN, MISSING_GENE = "Missing screen id", "Missing identifier_id"
DUPLICATE = "Duplicate identifier"


def mark_invalid(genes: DataFrame, per_version: bool = False) -> DataFrame:
    """Staged rows with validation_errors: a missing id, or a repeat of (screen, identifier).

    A repeat is any row after the first in the order of hits first, highest score, row number. ``per_version``
    marks every row of an identifier that its version has twice, whatever the screen, as older loads did.
    """
    missing = F.col("identifier_id").isNull()
    if per_version:
        again = F.count("*").over(Window.partitionBy("version_id", "identifier_id")) > 1
    else:
        order = Window.partitionBy("version_id", "screen_id", "identifier_id").orderBy(
            F.desc("hit_flag"), F.col("score_1").desc_nulls_last(), "row_number"
        )
        again = F.row_number().over(order) > 1
    return genes.withColumn("validation_errors", F.when(missing, MISSING_GENE).when(again, DUPLICATE))


def mark_invalid_screens(screens: DataFrame) -> DataFrame:
    bad = F.col("screen_id").isNull() | (F.trim(F.col("screen_id").cast("string")) == "")
    return screens.withColumn("validation_errors", F.when(bad, MISSING_SCREEN))


def load_screens(staged: DataFrame) -> DataFrame:
    """One row per (version, screen): the first by organism and source."""
    valid = staged.filter("validation_errors is null")
    return first_per_key(valid, ["version_id", "screen_id"], [F.col("organism").asc_nulls_last(), F.col("annotation_source").asc_nulls_last()]).drop(
        "validation_errors"
    )


def load_genes(staged: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per (version, identifier): the first symbol, with the organism of the version."""
    valid = staged.filter("validation_errors is null").select("version_id", "identifier_id", "gene_symbol")
    one = first_per_key(valid, ["version_id", "identifier_id"], [F.col("gene_symbol").asc_nulls_last()])
    # a row per version: shuffled by it, all genes of a version would meet in one task
    return one.join(F.broadcast(versions.select("version_id", "organism")), "version_id", "left")


def raw_pairs(staged: DataFrame, screens: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per (version, screen, gene) among the loaded screens and genes; raw_score is the first score, 0 if missing."""
    rows = (
        staged.filter("validation_errors is null")
        .join(screens.select("version_id", "screen_id"), ["version_id", "screen_id"], "left_semi")
        .join(genes.select("version_id", "identifier_id"), ["version_id", "identifier_id"], "left_semi")
    )
    one = best_observation(rows, ["version_id", "screen_id", "identifier_id"], "hit_flag", "score_1", ["row_number"])
    return one.withColumn("raw_score", F.coalesce("score_1", F.lit(0.0)))


def hit_percentage() -> Column:
    return F.round(F.try_divide(100.0 * F.count_if("hit_flag"), F.count("*")), 2)


def facts(pairs: DataFrame) -> DataFrame:
    """Per (version, screen, gene): hits, their percentage, the mean raw score, and the mean of scores that are there."""
    return pairs.groupBy("version_id", "screen_id", "identifier_id").agg(
        F.count_if("hit_flag").alias("hit_count"),
        hit_percentage().alias("hit_percentage"),
        F.avg("raw_score").alias("avg_raw_score"),
        F.avg("score_1").alias("avg_measured_score"),
        F.lit(0).alias("total_publications"),
        F.lit(1).alias("condition_count"),
    )


def _dimension(members: DataFrame, pairs: DataFrame, key: str, other: str, total: str) -> DataFrame:
    counted = pairs.groupBy("version_id", key).agg(
        F.count_distinct(other).alias(total),
        F.count_distinct(F.when(F.col("hit_flag"), F.col(other))).alias(f"{total}_hit"),
        F.avg(F.when(F.col("hit_flag"), 100.0).otherwise(0.0)).alias("avg_hit_percentage"),
    )
    joined = members.join(counted, ["version_id", key], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in (total, f"{total}_hit")}
    return joined.withColumns({**zero, "avg_hit_percentage": F.coalesce("avg_hit_percentage", F.lit(0.0))})


def dim_screen(screens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Screens with their numbers of genes; those without rows have zeros."""
    return _dimension(screens, pairs, "screen_id", "identifier_id", "total_genes")


def dim_gene(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Genes with their numbers of screens; those without rows have zeros."""
    return _dimension(genes, pairs, "identifier_id", "screen_id", "total_screens")


def build(staging_screens: DataFrame, staging_genes: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """All tables of a load, by name. The versions are those of the staged rows."""
    marked_screens, marked_genes = mark_invalid_screens(staging_screens), mark_invalid(staging_genes)
    screens, genes = load_screens(marked_screens), load_genes(marked_genes, versions)
    pairs = raw_pairs(marked_genes, screens, genes)
    return {
        "screen": screens,
        "gene": genes,
        "screen_gene_raw": pairs,
        "fact_screen_gene": facts(pairs),
        "dim_screen": dim_screen(screens, pairs),
        "dim_gene": dim_gene(genes, pairs),
        "issues": issues(marked_screens, marked_genes),
    }


#: The steps of a load in order. Each one's plan takes the tables that those before it wrote, read back.
STEPS = {
    "staged": lambda t: mark_invalid(t["staging_genes"]),
    "screen": lambda t: load_screens(mark_invalid_screens(t["staging_screens"])),
    "gene": lambda t: load_genes(t["staged"], t["versions"]),
    "screen_gene_raw": lambda t: raw_pairs(t["staged"], t["screen"], t["gene"]),
    "fact_screen_gene": lambda t: facts(t["screen_gene_raw"]),
    "dim_screen": lambda t: dim_screen(t["screen"], t["screen_gene_raw"]),
    "dim_gene": lambda t: dim_gene(t["gene"], t["screen_gene_raw"]),
}
AUDIT_SCHEMA = "run_id int, step_name string, step_order int, status string, rows_inserted long, seconds double, error string"


def run_load(staging_screens: DataFrame, staging_genes: DataFrame, versions: DataFrame, path: str, run_id: int) -> DataFrame:
    """Write the tables of a load by version and return its audit rows; a step that fails ends the run and says so.

    ``versions`` are those that are loaded; they replace what the tables had of them. Progress is kept below ``path``, so
    that a run that broke off, started again under its number, goes on after its last completed step.
    """
    spark = staging_genes.sparkSession
    tables = {"staging_screens": staging_screens, "staging_genes": staging_genes, "versions": versions}
    log = f"{path}/audit"
    done = audit_of(spark, log).filter((F.col("run_id") == run_id) & (F.col("status") == "completed"))
    completed = {r.step_name for r in done.select("step_name").distinct().collect()}
    own = [r.version_id for r in versions.select("version_id").distinct().collect()]  # the partitions that a step reads back
    for order, (name, plan) in enumerate(STEPS.items(), start=1):
        began, failure = time.monotonic(), None
        try:
            if name not in completed:
                replace_partitions(plan(tables), f"{path}/{name}", ["version_id"])
            tables[name] = spark.read.parquet(f"{path}/{name}").filter(F.col("version_id").isin(own))
            rows = tables[name].count()
        except (PySparkException, Py4JJavaError) as error:
            failure, rows = str(error)[:500], None
        if name not in completed:
            status = "failed" if failure else "completed"
            row = (run_id, name, order, status, rows, time.monotonic() - began, failure)
            spark.createDataFrame([row], AUDIT_SCHEMA).write.mode("append").parquet(log)
        if failure:
            break
    return audit_of(spark, log).filter(F.col("run_id") == run_id)


def audit_of(spark: SparkSession, log: str) -> DataFrame:
    """The audit rows kept in a folder; none if there is no folder."""
    return spark.read.schema(AUDIT_SCHEMA).parquet(log) if exists(spark, log) else spark.createDataFrame([], AUDIT_SCHEMA)


def issues(screens: DataFrame, genes: DataFrame) -> DataFrame:
    """Validation errors per version and kind, with row counts."""
    kinds = [(screens, "screen"), (genes, "screen_gene")]
    parts = [
        df.filter("validation_errors is not null")
        .groupBy("version_id", F.lit(kind).alias("kind"), "validation_errors")
        .agg(F.count("*").alias("n_rows"))
        for df, kind in kinds
    ]
    return parts[0].unionByName(parts[1])


def current(table: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows of the versions that the control table marks as current."""
    return table.join(versions.filter("is_current").select("version_id"), "version_id", "left_semi")


def promote(versions: DataFrame, runs: DataFrame, version_id: int) -> DataFrame:
    """The control table with one version current within its organism; unchanged unless that version has a completed run."""
    done = runs.filter((F.col("version_id") == version_id) & (F.col("status") == "completed")).select("version_id").distinct()
    target = versions.join(done, "version_id", "left_semi").select(F.col("organism").alias("_organism"))
    same = F.col("organism") == F.col("_organism")
    return (
        versions.join(target, same, "left")
        .withColumn("is_current", F.when(F.col("_organism").isNull(), F.col("is_current")).otherwise(F.col("version_id") == version_id))
        .drop("_organism")
    )


def rollback(versions: DataFrame, runs: DataFrame, organism: str) -> DataFrame:
    """The control table with the latest completed version before the current one made current again."""
    own = versions.filter(F.col("organism") == organism)
    completed = runs.filter("status = 'completed'").select("version_id").distinct()
    now = own.filter("is_current").agg(F.max("version_id").alias("now"))
    earlier = own.join(completed, "version_id", "left_semi").join(F.broadcast(now), F.col("version_id") < F.col("now"))
    target = earlier.agg(F.max("version_id").alias("target"))
    found = versions.join(F.broadcast(target), F.lit(True))
    is_own = (F.col("organism") == organism) & F.col("target").isNotNull()
    return found.withColumn("is_current", F.when(is_own, F.col("version_id") == F.col("target")).otherwise(F.col("is_current"))).drop("target")


def purge(tables: dict[str, DataFrame], version_ids: list[int]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without some versions, dependents first, and a report of the rows removed from each."""
    gone = F.col("version_id").isin(version_ids)
    report = [df.filter(gone).groupBy(F.lit(name).alias("table_name"), "version_id").agg(F.count("*").alias("rows_removed")) for name, df in tables.items()]
    whole = report[0]
    for part in report[1:]:
        whole = whole.unionByName(part)
    return {name: df.filter(~gone) for name, df in reversed(tables.items())}, whole


def drop_versions(spark: SparkSession, path: str, version_ids: list[int]) -> DataFrame:
    """Remove versions from stored tables by their partitions, dependents first; a report of the rows removed."""
    names = [name for name in reversed(STEPS) if exists(spark, f"{path}/{name}")]
    counted = [
        spark.read.parquet(f"{path}/{name}").filter(F.col("version_id").isin(version_ids))
        .groupBy(F.lit(name).alias("table_name"), F.col("version_id").cast("int").alias("version_id")).agg(F.count("*").alias("rows_removed"))
        for name in names
    ]
    removed = [r for part in counted for r in part.collect()]  # one row per table and version
    for row in removed:
        remove(spark, f"{path}/{row.table_name}/version_id={row.version_id}")
    return spark.createDataFrame(removed, "table_name string, version_id int, rows_removed long")


def old_versions(versions: DataFrame, keep: int) -> DataFrame:
    """Versions beyond the latest ``keep`` of their organism that are not current."""
    age = F.row_number().over(Window.partitionBy("organism").orderBy(F.desc("version_id")))
    return versions.withColumn("_age", age).filter((F.col("_age") > keep) & ~F.col("is_current")).drop("_age")


def storage_estimate(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and version with their estimated bytes."""
    parts = [
        df.groupBy("version_id").agg(F.count("*").alias("n_rows")).select("version_id", F.lit(name).alias("table_name"), "n_rows", (F.col("n_rows") * ROW_BYTES[name]).alias("bytes"))
        for name, df in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def run_summary(runs: DataFrame, audit: DataFrame) -> DataFrame:
    """Per run: its duration in seconds, its steps, those that failed, and the rows it wrote."""
    steps = audit.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed_steps"), F.sum("rows_inserted").alias("rows_inserted"))
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return runs.withColumn("seconds", seconds).join(steps, "run_id", "left")


def run_history(runs: DataFrame, audit: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with their version's organism and, per run, its last step, from the latest start on. ``runs``: run_id, version_id, status, started_at."""
    last = audit.groupBy("run_id").agg(F.max_by("step_name", "step_order").alias("last_step"), F.max_by("error", "step_order").alias("last_error"))
    joined = runs.join(versions.select("version_id", "organism", "is_current"), "version_id", "left").join(last, "run_id", "left")
    return joined.orderBy(F.desc("started_at"), "run_id")


def step_statistics(audit: DataFrame) -> DataFrame:
    """Per step over all runs: how often it ran and failed, its mean and longest time, and its rows per second."""
    ok = F.col("status") == "completed"
    return audit.groupBy("step_name").agg(
        F.count("*").alias("n_runs"), F.count_if(~ok).alias("n_failed"), F.round(100.0 * F.count_if(ok) / F.count("*"), 2).alias("success_percentage"),
        F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("longest_seconds"), F.sum("rows_inserted").alias("n_rows"),
        F.try_divide(F.sum(F.when(ok, F.col("rows_inserted"))), F.sum(F.when(ok, F.col("seconds")))).alias("rows_per_second"),
    )


def ready(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Per required table: whether it is there, has its columns, and has rows."""
    any_table = next(iter(tables.values()))
    rows = []
    for name, columns in required.items():
        df = tables.get(name)
        rows.append((name, df is not None, df is not None and set(columns) <= set(df.columns), df is not None and not df.isEmpty()))
    return any_table.sparkSession.createDataFrame(rows, "table_name string, present boolean, has_columns boolean, has_rows boolean")
