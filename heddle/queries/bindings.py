"""The concepts of the engine over the tables that are given: once as DataFrames, once as SQL.

A supplier is a screen, a part a gene, and a line item an observation; a returned one is a hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.windows import add_signed_percentile, best_observation

DOMAINS = ["fitness", "stress", "reporter", "other"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, repeated (screen, gene) pairs included."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("screen_id"), F.col("l_partkey").alias("gene"), F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").alias("hit"), F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"),
    )


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per (screen, gene)."""
    return best_observation(observations(spark, sf_dir), ["screen_id", "gene"], "hit", "score", ["paper", "line"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per (screen, gene), with its percentile within the screen."""
    return add_signed_percentile(best(spark, sf_dir), ["screen_id"], "score")


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    domains = F.array(*[F.lit(d) for d in DOMAINS])
    return joined.select(
        F.col("s_suppkey").alias("screen_id"), F.col("r_name").alias("organism"), F.get(domains, (F.col("s_nationkey") % 4).cast("int")).alias("domain"),
        F.when(F.col("s_suppkey") % 4 == 0, "HIT_ONLY").otherwise("FULL").alias("coverage"), F.col("n_name").alias("condition"), F.col("s_name").alias("cell_line"),
        F.floor(F.col("s_suppkey") / 10).alias("pmid"),
    )


def edges(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Genes observed in the same papers, as a network: the cosine of their sets of papers, mutual best of ``k``."""
    from heddle.plans.networks import mutual_top

    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("gene")).distinct()
    seen = seen.join(seen.groupBy("gene").agg(F.count("*").alias("n")), "gene")  # before the pairs are made, which are many more rows
    pairs = seen.withColumnsRenamed({"gene": "a", "n": "na"}).join(seen.withColumnsRenamed({"gene": "b", "n": "nb"}), "paper").filter("a < b")
    joined = pairs.groupBy("a", "b").agg(F.count("*").alias("support"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return mutual_top(joined.select("a", "b", (F.col("support") / F.sqrt(F.col("na") * F.col("nb"))).alias("r"), "support"), k).withColumnRenamed("r", "strength")


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as genes and the first two letters of words as screens: a table whose rows are alike in groups, by language and by copies.

    A document is measured where it has such words, by their share of its words; the upper tenth of a screen's percentiles are hits.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gene"), F.explode(words).alias("w"))
    counts = each.groupBy("gene", F.substring("w", 1, 2).alias("screen_id")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("gene").agg(F.sum("n").alias("all"))
    rows = counts.join(sizes, "gene").select("screen_id", "gene", (F.col("n") / F.col("all")).alias("score"))
    return add_signed_percentile(rows, ["screen_id"], "score").withColumn("hit", F.coalesce(F.col("percentile") >= 0.8, F.lit(False)))


OBS = """obs AS (SELECT l_suppkey AS screen_id, l_partkey AS gene, l_extendedprice AS score, l_returnflag = 'R' AS hit,
  l_orderkey AS paper, l_linenumber AS line FROM lineitem)"""
BEST = f"""{OBS},
best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY screen_id, gene ORDER BY hit DESC, score DESC, paper, line) AS rn FROM obs) WHERE rn = 1)"""
SCORED = f"""{BEST},
ranked AS (SELECT *, rank() OVER (PARTITION BY screen_id ORDER BY score) + (count(*) OVER (PARTITION BY screen_id, score) - 1) / 2.0 - 1.0 AS r0 FROM best),
scored AS (SELECT * EXCLUDE r0, CAST(2 AS DOUBLE) * (r0 / nullif(max(r0) OVER (PARTITION BY screen_id), 0)) - CAST(1 AS DOUBLE) AS percentile FROM ranked)"""
SCREENS = """screens AS (SELECT s_suppkey AS screen_id, r_name AS organism, (['fitness', 'stress', 'reporter', 'other'])[s_nationkey % 4 + 1] AS domain,
  CASE WHEN s_suppkey % 4 = 0 THEN 'HIT_ONLY' ELSE 'FULL' END AS coverage, n_name AS condition, s_name AS cell_line, s_suppkey // 10 AS pmid
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EDGES = """seen AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS gene FROM lineitem),
sizes AS (SELECT gene, count(*) AS n FROM seen GROUP BY gene),
pairs AS (SELECT x.gene AS a, y.gene AS b, count(*) AS support FROM seen x JOIN seen y ON x.paper = y.paper AND x.gene < y.gene GROUP BY ALL),
weighted AS (SELECT a, b, support / sqrt(p.n * q.n) AS strength, support FROM pairs JOIN sizes p ON p.gene = a JOIN sizes q ON q.gene = b),
ways AS (SELECT * FROM weighted UNION ALL SELECT b, a, strength, support FROM weighted),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY strength DESC, b) AS rn FROM ways) WHERE rn <= 5),
edges AS (SELECT DISTINCT least(t.a, t.b) AS a, greatest(t.a, t.b) AS b, t.strength, t.support, CASE WHEN o.a IS NULL THEN 0 ELSE 1 END AS reciprocal
  FROM tops t LEFT JOIN tops o ON o.a = t.b AND o.b = t.a)"""
DOCUMENTS = """dwords AS (SELECT doc_id AS gene, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')) AS w FROM documents),
dcounts AS (SELECT gene, substr(w, 1, 2) AS screen_id, count(*) AS n FROM dwords GROUP BY ALL),
dshares AS (SELECT screen_id, gene, n / sum(n) OVER (PARTITION BY gene) AS score FROM dcounts),
dranked AS (SELECT *, rank() OVER (PARTITION BY screen_id ORDER BY score) + (count(*) OVER (PARTITION BY screen_id, score) - 1) / 2.0 - 1.0 AS r0 FROM dshares),
profiles AS (SELECT *, coalesce(percentile >= 0.8, false) AS hit
  FROM (SELECT * EXCLUDE r0, CAST(2 AS DOUBLE) * (r0 / nullif(max(r0) OVER (PARTITION BY screen_id), 0)) - CAST(1 AS DOUBLE) AS percentile FROM dranked))"""
