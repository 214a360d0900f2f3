"""All queries of the engine by name, each with its SQL for the oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed_values as V
from heddle.functions import rules, scores
from heddle.functions.stats import correlation_p, hypergeom_sf
from heddle.operators import graph, pairwise, upsert, windows
from heddle.plans import builders as plans_builders
from heddle.plans import details, harmonize, knowledge, networks, serving, similarity, upload, warehouse
from heddle.queries.bindings import BEST, DOCUMENTS, EDGES, OBS, SCORED, SCREENS, best, document_profiles, edges, observations, scored, screens, table
from heddle.queries.registry import ORACLE_SQL, QUERIES, query, r6  # noqa: F401
from heddle.sources import screens as screen_files
from heddle.storage import written
from heddle.streaming.ingest import windowed_counts

GENES = list(range(1, 41))
GENE_LIST = ", ".join(map(str, GENES))

# ---- the gene-list query

MATCHED = f"""{SCORED}, {SCREENS},
matched AS (SELECT screen_id, count(DISTINCT gene) AS shared_genes, list_sort(list(DISTINCT gene)) AS shared, avg(percentile) AS rho
  FROM scored JOIN screens USING (screen_id) WHERE gene IN ({GENE_LIST}) AND hit GROUP BY screen_id HAVING count(DISTINCT gene) >= 2
  ORDER BY shared_genes DESC, rho DESC, screen_id LIMIT 20)"""
DARK = f"""{MATCHED},
known AS (SELECT gene, count(DISTINCT screen_id) AS total_screens FROM best GROUP BY gene),
dark AS (SELECT gene, count(DISTINCT screen_id) AS screens, avg(percentile) AS correlation, coalesce(max(total_screens), 1) AS pubs
  FROM scored LEFT JOIN known USING (gene) WHERE hit AND gene NOT IN ({GENE_LIST}) AND screen_id IN (SELECT screen_id FROM matched)
  GROUP BY gene ORDER BY screens DESC, pubs, gene LIMIT 20)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return serving.matched_screens(scored(spark, d), screens(spark, d), GENES, min_shared=2)


def _dark(spark: SparkSession, d: str) -> DataFrame:
    known = best(spark, d).groupBy("gene").agg(F.count_distinct("screen_id").alias("total_screens"))
    return serving.dark_genes(scored(spark, d), _matched(spark, d), GENES, known)


@query(f"WITH {MATCHED} SELECT screen_id, shared_genes, array_to_string(shared, ',') AS shared, round(rho, 6) AS rho FROM matched")
def gene_list_screens(spark, d):
    return _matched(spark, d).select("screen_id", "shared_genes", F.array_join(F.col("shared").cast("array<string>"), ",").alias("shared"), r6("rho").alias("rho"))


@query(f"WITH {DARK} SELECT gene, screens, round(correlation, 6) AS correlation, pubs, round(10.0 / log10(pubs + 2), 2) AS dark_score, pubs > 100 AS is_bright FROM dark")
def gene_list_dark_genes(spark, d):
    return _dark(spark, d).withColumn("correlation", r6("correlation"))


@query(f"""WITH {DARK},
s5 AS (SELECT screen_id FROM matched ORDER BY shared_genes DESC, rho DESC, screen_id LIMIT 5), g8 AS (SELECT gene FROM dark ORDER BY screens DESC, pubs, gene LIMIT 8)
SELECT screen_id, gene, score FROM scored WHERE hit AND screen_id IN (FROM s5) AND gene IN (FROM g8) ORDER BY screen_id, gene LIMIT 40""")
def gene_list_edges(spark, d):
    return serving.query_edges(scored(spark, d), _matched(spark, d), _dark(spark, d))


@query(f"WITH {MATCHED} SELECT count(*) AS screens_compared, count(*) FILTER (rho > 0.7) AS significant_matches, CAST({len(GENES)} AS INTEGER) AS query_gene_count FROM matched")
def gene_list_stats(spark, d):
    return serving.query_stats(_matched(spark, d), len(GENES))


# ---- warehouse

STAGED = """versions AS (SELECT 1 AS version_id, 'mouse' AS organism),
staged AS (SELECT 1 AS version_id, CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE l_suppkey END AS screen_id, CASE WHEN l_partkey % 97 = 5 THEN NULL ELSE l_partkey END AS identifier_id,
  p_name AS gene_symbol, l_returnflag = 'R' AS hit_flag, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS score_1, l_orderkey * 10 + l_linenumber AS row_number
  FROM lineitem JOIN part ON l_partkey = p_partkey),
marked AS (SELECT *, CASE WHEN identifier_id IS NULL THEN 'Missing identifier_id' WHEN row_number() OVER (PARTITION BY version_id, screen_id, identifier_id
  ORDER BY hit_flag DESC, score_1 DESC NULLS LAST, row_number) > 1 THEN 'Duplicate identifier' END AS validation_errors FROM staged),
staged_screens AS (SELECT 1 AS version_id, CASE WHEN s_suppkey % 50 = 7 THEN NULL ELSE s_suppkey END AS screen_id, 'mouse' AS organism, s_name AS annotation_source FROM supplier
  UNION ALL SELECT 1, s_suppkey, 'human', s_name FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 50 != 7),
screen AS (SELECT version_id, screen_id, organism, annotation_source FROM (SELECT *, row_number() OVER (PARTITION BY version_id, screen_id ORDER BY organism, annotation_source) AS rn
  FROM staged_screens WHERE screen_id IS NOT NULL) WHERE rn = 1),
gene AS (SELECT version_id, identifier_id, min(gene_symbol) AS gene_symbol, 'mouse' AS organism FROM marked WHERE validation_errors IS NULL GROUP BY ALL),
pair AS (SELECT *, coalesce(score_1, 0) AS raw_score FROM marked JOIN (SELECT screen_id FROM screen) USING (screen_id) WHERE validation_errors IS NULL)"""


def _staging(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line, part, supplier = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    genes = joined.select(
        F.lit(1).alias("version_id"), F.when(F.col("l_suppkey") % 50 != 7, F.col("l_suppkey")).alias("screen_id"), F.when(F.col("l_partkey") % 97 != 5, F.col("l_partkey")).alias("identifier_id"),
        F.col("p_name").alias("gene_symbol"), (F.col("l_returnflag") == "R").alias("hit_flag"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("score_1"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"),
    )
    is_bad = F.col("s_suppkey") % 50 == 7
    first = supplier.select(F.lit(1).alias("version_id"), F.when(~is_bad, F.col("s_suppkey")).alias("screen_id"), F.lit("mouse").alias("organism"), F.col("s_name").alias("annotation_source"))
    second = supplier.filter((F.col("s_suppkey") % 3 == 0) & ~is_bad).select(F.lit(1), "s_suppkey", F.lit("human"), "s_name").toDF(*first.columns)
    versions = spark.createDataFrame([(1, "mouse")], "version_id int, organism string")
    return first.unionByName(second), genes, versions


def _warehouse(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return warehouse.build(*_staging(spark, d))


@query(f"WITH {STAGED} SELECT coalesce(validation_errors, 'valid') AS status, count(*) AS n_rows, round(sum(score_1), 2) AS total FROM marked GROUP BY 1")
def staging_validation(spark, d):
    marked = warehouse.mark_invalid(_staging(spark, d)[1])
    return marked.groupBy(F.coalesce("validation_errors", F.lit("valid")).alias("status")).agg(F.count("*").alias("n_rows"), F.round(F.sum("score_1"), 2).alias("total"))


@query(f"""WITH {STAGED}, old AS (SELECT *, CASE WHEN identifier_id IS NULL THEN 'Missing identifier_id'
  WHEN count(*) OVER (PARTITION BY version_id, identifier_id) > 1 THEN 'Duplicate identifier' END AS e FROM staged)
SELECT coalesce(e, 'valid') AS status, count(*) AS n_rows FROM old GROUP BY 1""")
def staging_validation_per_version(spark, d):
    marked = warehouse.mark_invalid(_staging(spark, d)[1], per_version=True)
    return marked.groupBy(F.coalesce("validation_errors", F.lit("valid")).alias("status")).agg(F.count("*").alias("n_rows"))


@query(f"""WITH {STAGED} SELECT version_id, 'screen' AS kind, 'Missing screen id' AS validation_errors, count(*) AS n_rows FROM staged_screens WHERE screen_id IS NULL GROUP BY ALL
UNION ALL SELECT version_id, 'screen_gene', validation_errors, count(*) FROM marked WHERE validation_errors IS NOT NULL GROUP BY ALL""")
def validation_issues(spark, d):
    return _warehouse(spark, d)["issues"]


@query(f"WITH {STAGED} SELECT * FROM screen")
def load_screens(spark, d):
    return _warehouse(spark, d)["screen"]


@query(f"WITH {STAGED} SELECT * FROM gene")
def load_genes(spark, d):
    return _warehouse(spark, d)["gene"]


@query(f"WITH {STAGED} SELECT screen_id, count(*) AS n, round(sum(raw_score), 2) AS total, max(row_number) AS last_row FROM pair GROUP BY screen_id")
def raw_pairs(spark, d):
    pairs = _warehouse(spark, d)["screen_gene_raw"]
    return pairs.groupBy("screen_id").agg(F.count("*").alias("n"), F.round(F.sum("raw_score"), 2).alias("total"), F.max("row_number").alias("last_row"))


@query(f"""WITH {STAGED} SELECT version_id, screen_id, identifier_id, count(*) FILTER (hit_flag) AS hit_count, round(100.0 * count(*) FILTER (hit_flag) / count(*), 2) AS hit_percentage,
  round(avg(raw_score), 6) AS avg_raw_score, round(avg(score_1), 6) AS avg_measured_score, 0 AS total_publications, 1 AS condition_count FROM pair GROUP BY ALL""")
def fact_screen_gene(spark, d):
    facts = _warehouse(spark, d)["fact_screen_gene"]
    return facts.withColumns({c: r6(c) for c in ("avg_raw_score", "avg_measured_score")})


@query(f"""WITH {STAGED} SELECT s.version_id, s.screen_id, organism, annotation_source, count(DISTINCT identifier_id) AS total_genes, count(DISTINCT identifier_id) FILTER (hit_flag) AS total_genes_hit,
  round(coalesce(avg(CASE WHEN p.screen_id IS NULL THEN NULL WHEN hit_flag THEN 100.0 ELSE 0.0 END), 0.0), 6) AS avg_hit_percentage
  FROM screen s LEFT JOIN pair p ON p.screen_id = s.screen_id GROUP BY ALL""")
def dim_screen(spark, d):
    return _warehouse(spark, d)["dim_screen"].withColumn("avg_hit_percentage", r6("avg_hit_percentage"))


@query(f"""WITH {STAGED} SELECT g.version_id, g.identifier_id, g.gene_symbol, organism, count(DISTINCT screen_id) AS total_screens, count(DISTINCT screen_id) FILTER (hit_flag) AS total_screens_hit,
  round(coalesce(avg(CASE WHEN p.identifier_id IS NULL THEN NULL WHEN hit_flag THEN 100.0 ELSE 0.0 END), 0.0), 6) AS avg_hit_percentage
  FROM gene g LEFT JOIN pair p ON p.identifier_id = g.identifier_id GROUP BY ALL""")
def dim_gene(spark, d):
    return _warehouse(spark, d)["dim_gene"].withColumn("avg_hit_percentage", r6("avg_hit_percentage"))


CONTROL = """versions AS (SELECT n_nationkey AS version_id, r_name AS organism, n_nationkey = min(n_nationkey) OVER (PARTITION BY r_name) AS is_current FROM nation JOIN region ON n_regionkey = r_regionkey),
done AS (SELECT DISTINCT s_nationkey AS version_id FROM supplier WHERE s_acctbal >= 0 AND s_nationkey != 13)"""


def _promoted(version: int) -> str:
    """SQL of the control table after a promotion."""
    of = f"(SELECT organism FROM versions WHERE version_id = {version} AND version_id IN (FROM done))"
    return f"SELECT version_id, organism, CASE WHEN coalesce(organism = {of}, false) THEN version_id = {version} ELSE is_current END AS is_current FROM versions"


def _control(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as versions of their region, the first of each current; suppliers as runs of their nation's version."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("version_id"), F.col("r_name").alias("organism"))
    first = named.groupBy("organism").agg(F.min("version_id").alias("first"))
    versions = named.join(first, "organism").select("version_id", "organism", (F.col("version_id") == F.col("first")).alias("is_current"))
    status = F.when((F.col("s_acctbal") >= 0) & (F.col("s_nationkey") != 13), "completed").otherwise("failed")
    return versions, table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").alias("version_id"), status.alias("status"))


@query(f"WITH {CONTROL} {_promoted(12)}")
def promote_version(spark, d):
    return warehouse.promote(*_control(spark, d), 12)


@query(f"WITH {CONTROL} {_promoted(13)}")
def promote_without_run(spark, d):
    return warehouse.promote(*_control(spark, d), 13)


@query("SELECT table_name, CAST(v AS INTEGER) AS version_id, n AS rows_removed FROM (SELECT 'orders' AS table_name, o_custkey % 5 AS v, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'customer', c_custkey % 5, count(*) FROM customer GROUP BY ALL) WHERE v IN (1, 3)")
def purge_report(spark, d):
    orders = table(spark, d, "orders").withColumn("version_id", (F.col("o_custkey") % 5).cast("int"))
    customers = table(spark, d, "customer").withColumn("version_id", (F.col("c_custkey") % 5).cast("int"))
    return warehouse.purge({"orders": orders, "customer": customers}, [1, 3])[1]


@query(f"""WITH {STAGED} SELECT version_id, 'screen' AS table_name, count(*) AS n_rows, count(*) * 2000 AS bytes FROM screen GROUP BY ALL
UNION ALL SELECT version_id, 'gene', count(*), count(*) * 800 FROM gene GROUP BY ALL UNION ALL SELECT version_id, 'screen_gene_raw', count(*), count(*) * 100 FROM pair GROUP BY ALL""")
def storage_estimate(spark, d):
    built = _warehouse(spark, d)
    return warehouse.storage_estimate({k: built[k] for k in ("screen", "gene", "screen_gene_raw")})


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 != 0), n AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)) SELECT k, v FROM m""")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return upsert.upsert(o.filter("k % 3 != 0"), o.filter("k % 2 = 0").withColumn("v", -F.col("v")), ["k"])


@query("""WITH old AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), fresh AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT k, v FROM fresh WHERE rn = 1 AND k NOT IN (SELECT k FROM old)""")
def insert_missing_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    old = o.filter("v % 3 = 0").select("k").distinct().withColumn("v", F.lit(None).cast("long"))
    return upsert.insert_missing(old, o, ["k"], [F.col("v")]).filter("v is not null")


@query("SELECT l_suppkey AS screen_id, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def still_to_load(spark, d):
    done = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("screen_id"))
    return upsert.still_to_do(observations(spark, d), done, ["screen_id"]).groupBy("screen_id").agg(F.count("*").alias("n"))


@query("SELECT length(text) AS length, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_contents(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("length")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("h")


# ---- ranks and harmonization


@query(f"WITH {SCORED} SELECT screen_id, gene, round(percentile, 9) AS percentile FROM scored")
def signed_percentile(spark, d):
    return scored(spark, d).select("screen_id", "gene", F.round("percentile", 9).alias("percentile"))


@query(f"WITH {BEST} SELECT screen_id, gene, round((rank() OVER (PARTITION BY screen_id ORDER BY score) + (count(*) OVER (PARTITION BY screen_id, score) - 1) / 2.0) / count(*) OVER (PARTITION BY screen_id), 9) AS fraction FROM best")
def rank_fraction(spark, d):
    return windows.add_rank_fraction(best(spark, d), ["screen_id"], "score", "fraction").select("screen_id", "gene", F.round("fraction", 9).alias("fraction"))


@query(f"""WITH {BEST}, m AS (SELECT *, median(score) OVER (PARTITION BY screen_id) AS md, stddev_samp(score) OVER (PARTITION BY screen_id) AS sd FROM best),
q AS (SELECT *, median(abs(score - md)) OVER (PARTITION BY screen_id) AS mad FROM m), z AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END AS sc FROM q)
SELECT screen_id, gene, round(CASE WHEN sc > 0 THEN (score - md) / sc END, 6) AS robust_z FROM z""")
def robust_z(spark, d):
    return windows.add_robust_z(best(spark, d), ["screen_id"], "score").select("screen_id", "gene", r6("robust_z").alias("robust_z"))


@query(f"WITH {BEST} SELECT screen_id, gene, score, hit, paper, line FROM best")
def best_observations(spark, d):
    return best(spark, d).select("screen_id", "gene", "score", "hit", "paper", "line")


@query(f"WITH {OBS} SELECT screen_id, gene, arg_min(score, paper * 10 + line) AS score, min(paper * 10 + line) AS place FROM obs GROUP BY ALL")
def first_seen_observations(spark, d):
    rows = observations(spark, d).withColumn("place", F.col("paper") * 10 + F.col("line"))
    return windows.first_per_key(rows, ["screen_id", "gene"], [F.col("place")]).select("screen_id", "gene", "score", "place")


def _raw_corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Deposited files for harmonization: one of six kinds of score columns per screen."""
    line = table(spark, d, "lineitem").withColumn("screen_id", F.col("l_suppkey"))
    one = windows.first_per_key(line, ["l_suppkey", "l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])
    rows = one.select(
        "screen_id", F.col("l_partkey").alias("gene"), F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_extendedprice").cast("string")).alias("score_1"),
        F.col("l_discount").cast("string").alias("score_2"), F.col("l_tax").cast("string").alias("score_3"), F.lit(None).cast("string").alias("score_4"), F.lit("").alias("score_5"),
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("NO").alias("hit"),
    )
    k = F.col("s_suppkey") % 6
    metadata = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("screen_id"),
        F.when(k == 0, "Log2FC").when(k == 1, "Bayes Factor").when(k == 4, "STARS score").when(k == 5, "Log10").alias("type_1"),
        F.when(k == 2, "p-Value").when(k == 3, "positive score").alias("type_2"), F.when(k == 3, "negative score").alias("type_3"), F.lit("-").alias("type_4"), F.lit("").alias("type_5"),
        F.when(k == 2, "Negative Selection").when(k == 4, "Positive Selection").otherwise("Phenotype Screen").alias("screen_type"), F.lit("Knockout").alias("methodology"),
        F.when(F.col("s_suppkey") % 7 == 0, "CRISPRa").otherwise("CRISPRn").alias("library_type"),
    )
    return rows, metadata


HARMONIZED = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1),
x AS (SELECT l_suppkey AS screen_id, l_partkey AS gene, CASE WHEN l_linenumber != 7 THEN l_extendedprice END AS s1, l_discount AS s2, l_tax AS s3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_hit, l_suppkey % 6 AS k,
  CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE 1 END AS f FROM one),
h AS (SELECT *, f * CASE k WHEN 0 THEN s1 WHEN 1 THEN -s1 WHEN 2 THEN log10(least(greatest(s2, 1e-10), 1.0)) WHEN 3 THEN s2 - s3 WHEN 4 THEN coalesce(s1, 0.0) END AS harmonized FROM x),
q AS (SELECT screen_id, count(harmonized) AS n, count(DISTINCT harmonized) AS dn FROM h GROUP BY screen_id),
ok AS (SELECT h.*, CASE WHEN n >= 2 AND dn > 1 AND NOT (n >= 500 AND dn < 20) THEN harmonized END AS v,
  CASE WHEN k = 5 THEN 'ambiguous logarithm' WHEN n < 2 THEN 'too few values' WHEN dn <= 1 THEN 'one value' WHEN n >= 500 AND dn < 20 THEN 'collapsed' WHEN n >= 500 AND dn::DOUBLE / n < 0.01 THEN 'coarse' END AS note FROM h JOIN q USING (screen_id)),
r AS (SELECT *, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY screen_id, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY screen_id, v) - 1) / 2.0 - 1.0 END AS r0 FROM ok)"""


@query(f"""WITH {HARMONIZED} SELECT screen_id, gene, round(harmonized, 6) + 0 AS harmonized, is_hit, note, round(CAST(2 AS DOUBLE) * (r0 / nullif(max(r0) OVER (PARTITION BY screen_id), 0)) - 1, 6) AS percentile FROM r""")
def harmonized_scores(spark, d):
    rows, metadata = _raw_corpus(spark, d)
    # the rows are read twice, for statistics and for scores: they are stored, as deposited screens are
    done = harmonize.harmonize(written(rows, "deposited"), metadata)
    return done.select("screen_id", "gene", r6("harmonized").alias("harmonized"), "is_hit", "note", r6("percentile").alias("percentile"))


@query(f"""WITH {SCORED}, {SCREENS} SELECT domain, count(percentile) AS n, round(avg(percentile), 6) AS mean_percentile, count(percentile) >= 20 AND avg(percentile) >= 0 AS failed
FROM scored JOIN screens USING (screen_id) WHERE gene % 10 = 3 GROUP BY domain""")
def panel_check(spark, d):
    rows = scored(spark, d).join(screens(spark, d).select("screen_id", "domain"), "screen_id")
    panel = table(spark, d, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("gene"))
    return harmonize.panel_check(rows, panel, ["domain"]).withColumn("mean_percentile", r6("mean_percentile"))


@query(f"""WITH {SCORED}, m AS (SELECT screen_id, avg(percentile) AS a, count(percentile) AS n FROM scored WHERE gene % 50 = 3 GROUP BY 1)
SELECT s.screen_id, bool_or(coalesce(n >= 3 AND a > 0, false)) AS flipped, round(sum(CASE WHEN n >= 3 AND a > 0 THEN -percentile ELSE percentile END * gene), 4) AS checksum FROM scored s LEFT JOIN m USING (screen_id) GROUP BY 1""")
def anchor_flip(spark, d):
    panel = table(spark, d, "part").filter("p_partkey % 50 = 3").select(F.col("p_partkey").alias("gene"))
    flipped = windows.flip_by_anchor(scored(spark, d), ["screen_id"], "gene", panel, "percentile")
    return flipped.groupBy("screen_id").agg(F.bool_or("flipped").alias("flipped"), F.round(F.sum(F.col("percentile") * F.col("gene")), 4).alias("checksum"))


# ---- pairs of screens and of genes

PAIRS = f"""{SCORED}, {SCREENS},
v AS (SELECT organism, screen_id, gene, percentile FROM scored JOIN screens USING (screen_id)),
uni AS (SELECT organism, gene FROM v GROUP BY ALL HAVING count(DISTINCT screen_id) >= 2),
u AS (SELECT v.* FROM v SEMI JOIN uni ON v.organism = uni.organism AND v.gene = uni.gene),
m AS (SELECT x.organism, x.screen_id AS a, y.screen_id AS b, count(*) AS n, sum(x.percentile) AS sx, sum(y.percentile) AS sy, sum(x.percentile * y.percentile) AS sxy, sum(x.percentile ** 2) AS sxx, sum(y.percentile ** 2) AS syy,
  count(*) FILTER (t) AS tn, sum(x.percentile) FILTER (t) AS tx, sum(y.percentile) FILTER (t) AS ty, sum(x.percentile * y.percentile) FILTER (t) AS txy, sum(x.percentile ** 2) FILTER (t) AS txx, sum(y.percentile ** 2) FILTER (t) AS tyy
  FROM (SELECT * FROM u) x JOIN u y ON x.organism = y.organism AND x.gene = y.gene AND x.screen_id < y.screen_id, LATERAL (SELECT abs(x.percentile) > 0.5 OR abs(y.percentile) > 0.5 AS t) GROUP BY ALL)"""


def _by_organism(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).join(screens(spark, d).select("screen_id", "organism", "domain", "coverage", "condition", "pmid", "cell_line"), "screen_id")


#: The two-sided p-value of a correlation r over n, by the finite series of Student's t with n - 2 degrees of freedom.
P_OF_R = """greatest(0, 1 - CASE WHEN {n} % 2 = 0
  THEN abs({r}) * list_sum(list_transform(range(CAST(({n} - 2) / 2 AS BIGINT)), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)) * (1 - {r} ** 2) ** j))
  ELSE 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(CAST(({n} - 3) / 2 AS BIGINT)), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * (1 - {r} ** 2) ** (j + 0.5))), 0)) END)"""


@query(f"""WITH {PAIRS}, size AS (SELECT screen_id, count(*) AS k FROM u GROUP BY 1)
SELECT organism, a, b, n, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS rho, round(n / least(p.k, q.k), 6) AS overlap_fraction, round({P_OF_R.format(r='((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))', n='n')}, 6) AS p,
  CASE WHEN tn >= 20 THEN round((tn * txy - tx * ty) / sqrt((tn * txx - tx * tx) * (tn * tyy - ty * ty)), 6) END AS tail_rho
FROM m JOIN size p ON p.screen_id = a JOIN size q ON q.screen_id = b WHERE n >= 100 AND abs((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))) >= 0.1""")
def screen_correlations(spark, d):
    found = pairwise.item_correlations(_by_organism(spark, d), "screen_id", "gene", "percentile", ["organism"], min_overlap=100, min_rho=0.1)
    return found.select("organism", "a", "b", "n", r6("rho").alias("rho"), r6("overlap_fraction").alias("overlap_fraction"), r6("p").alias("p"), r6("tail_rho").alias("tail_rho"))


@query(f"""WITH {SCORED}, few AS (SELECT * FROM scored)
SELECT x.screen_id AS a, y.screen_id AS b, count(*) AS n, round(sum(x.percentile * y.percentile), 6) + 0 AS sxy, round(sum(x.percentile), 6) + 0 AS sx, round(sum(y.percentile ** 2), 6) AS syy
FROM few x JOIN few y ON x.gene = y.gene AND x.screen_id < y.screen_id GROUP BY ALL""")
def blocked_screen_moments(spark, d):
    few = scored(spark, d)
    return pairwise.blocked_moments(few, "screen_id", "gene", "percentile").select("a", "b", "n", *[r6(c).alias(c) for c in ("sxy", "sx", "syy")])


@query(f"""WITH {SCORED}, w AS (SELECT x.screen_id AS a, y.screen_id AS b, x.percentile AS p, y.percentile AS q, abs(x.percentile * y.percentile) AS w FROM scored x JOIN scored y ON x.gene = y.gene AND x.screen_id < y.screen_id),
s AS (SELECT a, b, count(*) AS n, sum(w) AS w, sum(w * p) AS wx, sum(w * q) AS wy, sum(w * p * q) AS wxy, sum(w * p * p) AS wxx, sum(w * q * q) AS wyy, sum(p) AS x, sum(q) AS y, sum(p * q) AS xy, sum(p * p) AS xx, sum(q * q) AS yy FROM w GROUP BY ALL)
SELECT a, b, n, round((w * wxy - wx * wy) / sqrt((w * wxx - wx * wx) * (w * wyy - wy * wy)), 6) AS r, round((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)), 6) AS r_plain FROM s WHERE n >= 130""")
def weighted_screen_similarity(spark, d):
    found = similarity.weighted_similarity(scored(spark, d), min_genes=20, min_screens=2, min_overlap=130)
    return found.select("a", "b", "n", r6("r").alias("r"), r6("r_plain").alias("r_plain"))


HYPER = """exp(lgamma({r} + 1) + lgamma({n} - {r} + 1) + lgamma({k} + 1) + lgamma({n} - {k} + 1) - lgamma({n} + 1) - lgamma(x + 1) - lgamma({r} - x + 1) - lgamma({k} - x + 1) - lgamma({n} - {r} - {k} + x + 1))"""


@query(f"""WITH {BEST}, {SCREENS}, hits AS (SELECT organism, screen_id, gene FROM best JOIN screens USING (screen_id) WHERE hit),
pop AS (SELECT organism, count(DISTINCT gene) AS n FROM best JOIN screens USING (screen_id) GROUP BY 1), sz AS (SELECT screen_id, count(*) AS h FROM hits GROUP BY 1),
sh AS (SELECT x.organism, x.screen_id AS a, y.screen_id AS b, count(*) AS shared FROM hits x JOIN hits y ON x.organism = y.organism AND x.gene = y.gene AND x.screen_id < y.screen_id GROUP BY ALL HAVING count(*) >= 25),
j AS (SELECT sh.*, p.h AS r, q.h AS k, n FROM sh JOIN sz p ON p.screen_id = a JOIN sz q ON q.screen_id = b JOIN pop USING (organism)),
t AS (SELECT organism, a, b, shared, r, k, n, unnest(range(shared, least(r, k) + 1)) AS x FROM j)
SELECT organism, a, b, shared, r AS a_hits, k AS b_hits, round(shared / (r + k - shared), 6) AS jaccard, round(sum({HYPER.format(n='n', r='r', k='k')}), 6) AS p FROM t GROUP BY organism, a, b, shared, r, k, n""")
def screen_hit_overlaps(spark, d):
    rows = _by_organism(spark, d)
    found = pairwise.hit_overlaps(rows.filter("hit"), rows, "screen_id", "gene", ["organism"], min_shared=25)
    return found.withColumns({"jaccard": r6("jaccard"), "p": r6("p")})


COHIT = f"""{SCORED}, few AS (SELECT * FROM scored), hits AS (SELECT * FROM few WHERE hit),
c AS (SELECT x.gene AS a, y.gene AS b, count(*) AS cohit, count(*) FILTER (x.percentile * y.percentile > 0) AS same FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT x.gene AS a, y.gene AS b, count(*) AS n, count(*) FILTER (x.hit) AS a_hits, count(*) FILTER (y.hit) AS b_hits FROM few x JOIN few y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL),
t AS (SELECT a, b, cohit, same, n, a_hits, b_hits, unnest(range(cohit, least(a_hits, b_hits) + 1)) AS x FROM c JOIN w USING (a, b)),
cp AS (SELECT a, b, cohit, n, a_hits, b_hits, a_hits * b_hits / n AS expected, same / cohit AS concordance, sum({HYPER.format(n='n', r='a_hits', k='b_hits')}) AS p FROM t GROUP BY a, b, cohit, same, n, a_hits, b_hits)"""


@query(f"WITH {COHIT} SELECT a, b, cohit, n, a_hits, b_hits, round(expected, 6) AS expected, round(cohit / expected, 6) AS fold, round(p, 6) AS p, round(concordance, 6) AS concordance FROM cp")
def cohit_pairs(spark, d):
    found = pairwise.cohit_pairs(scored(spark, d), "gene", "screen_id", "percentile", "hit", 3)
    return found.withColumns({c: r6(c) for c in ("expected", "fold", "p", "concordance")})


@query(f"""WITH {COHIT}, ways AS (SELECT a, b, cohit, expected, p, n, concordance FROM cp UNION ALL SELECT b, a, cohit, expected, p, n, concordance FROM cp),
rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(p, 12), cohit DESC, b) AS rn FROM ways), best25 AS (SELECT * FROM rk WHERE rn <= 25)
SELECT least(x.a, x.b) AS a, greatest(x.a, x.b) AS b, max(x.cohit) AS cohit, max(CASE WHEN y.a IS NULL THEN 0 ELSE 1 END) AS reciprocal FROM best25 x LEFT JOIN best25 y ON y.a = x.b AND y.b = x.a GROUP BY 1, 2""")
def cohit_best_partners(spark, d):
    pairs = pairwise.cohit_pairs(scored(spark, d), "gene", "screen_id", "percentile", "hit", 3)
    both = pairs.select("a", "b", "cohit", "p").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cohit", "p"))
    top = windows.add_reciprocal(windows.top_k(both, ["a"], [F.round("p", 12), F.desc("cohit"), F.col("b")], 25), "a", "b")
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cohit", "reciprocal").distinct()


@query(f"""WITH {DOCUMENTS}, few AS (SELECT * FROM profiles WHERE percentile IS NOT NULL), hits AS (SELECT * FROM few WHERE hit),
c AS (SELECT x.gene AS a, y.gene AS b, count(*) AS cohit, count(*) FILTER (x.percentile * y.percentile > 0) AS same FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT x.gene AS a, y.gene AS b, count(*) AS n, count(*) FILTER (x.hit) AS a_hits, count(*) FILTER (y.hit) AS b_hits FROM few x JOIN few y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL),
t AS (SELECT a, b, cohit, same, n, a_hits, b_hits, unnest(range(cohit, least(a_hits, b_hits) + 1)) AS x FROM c JOIN w USING (a, b)),
cp AS (SELECT a, b, cohit, n, a_hits * b_hits / n AS expected, same / cohit AS concordance, sum({HYPER.format(n='n', r='a_hits', k='b_hits')}) AS p FROM t GROUP BY a, b, cohit, same, n, a_hits, b_hits),
tested AS (SELECT 2 * (SELECT count(*) FROM w) + count(DISTINCT gene) AS m FROM few),
ways AS (SELECT * FROM cp UNION ALL SELECT b, a, * EXCLUDE (a, b) FROM cp),
ranks AS (SELECT *, count(*) OVER (ORDER BY p) AS place FROM ways),
gate AS (SELECT coalesce(max(p) FILTER (p <= 0.05 * place / m), 0) AS threshold, count(*) AS candidates FROM ranks, tested),
adjusted AS (SELECT *, min(least(1, p * m / place)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q_bh, row_number() OVER (PARTITION BY a ORDER BY p, cohit DESC, b) AS rn FROM ranks, tested),
best25 AS (SELECT * FROM adjusted, gate WHERE rn <= 25 AND p <= threshold)
SELECT least(x.a, x.b) AS a, greatest(x.a, x.b) AS b, max(x.cohit) AS cohit, max(x.n) AS support, round(max(x.q_bh), 6) AS q_bh, round(least(1, max(x.p) * max(x.m) / max(x.candidates)), 6) AS q_ref, round(max(x.concordance), 3) AS concordance, max(CASE WHEN y.a IS NULL THEN 0 ELSE 1 END) AS reciprocal
FROM best25 x LEFT JOIN best25 y ON y.a = x.b AND y.b = x.a GROUP BY 1, 2""")
def cohit_network(spark, d):
    found = networks.cohit_network(written(document_profiles(spark, d), "profiles"), alpha=0.05)
    return found.select("a", "b", "cohit", "support", r6("q_bh").alias("q_bh"), r6("q_ref").alias("q_ref"), "concordance", "reciprocal")


@query()
def coessential_network(spark, d):
    return networks.coessential_network(written(document_profiles(spark, d), "profiles"), min_coverage=0.1, nulls=2)


@query(f"""WITH {SCORED}, k AS (SELECT * FROM scored), g AS (SELECT gene, avg(percentile) AS mu FROM k GROUP BY gene HAVING count(*) >= greatest(20, floor(0.11 * (SELECT count(DISTINCT screen_id) FROM k)))),
c AS (SELECT gene, screen_id, percentile - mu AS x FROM k JOIN g USING (gene)), nn AS (SELECT gene, sum(x * x) AS q FROM c GROUP BY 1),
dd AS (SELECT p.gene AS a, q.gene AS b, sum(p.x * q.x) AS dot FROM c p JOIN c q ON p.screen_id = q.screen_id AND p.gene != q.gene GROUP BY ALL),
rr AS (SELECT a, b, dot / sqrt(x.q * y.q) AS r FROM dd JOIN nn x ON x.gene = a JOIN nn y ON y.gene = b)
SELECT a AS gene, b AS neighbour, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rn FROM rr WHERE r >= 0.25) WHERE rn <= 14""")
def profile_neighbours(spark, d):
    found = networks.profile_neighbours(scored(spark, d), least=20)
    return found.select("gene", "neighbour", r6("r").alias("r"))


SIMILAR = f"""{SCORED}, few AS (SELECT * FROM scored), pr AS (SELECT x.screen_id AS a, y.screen_id AS b, count(*) AS n, sum(x.percentile) AS sx, sum(y.percentile) AS sy, sum(x.percentile * y.percentile) AS sxy, sum(x.percentile ** 2) AS sxx, sum(y.percentile ** 2) AS syy
FROM few x JOIN few y ON x.gene = y.gene AND x.screen_id != y.screen_id WHERE x.screen_id = 5 GROUP BY ALL HAVING count(*) >= 50),
rs AS (SELECT b AS screen_b, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r, n AS overlap FROM pr),
zs AS (SELECT *, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS z FROM rs)"""


@query(f"WITH {SIMILAR} SELECT screen_b, round(r, 6) AS r, overlap, round(z, 5) AS z FROM zs WHERE screen_b // 10 != 0")
def similar_screens(spark, d):
    pairs = similarity.screen_similarity_of(scored(spark, d), 5, min_overlap=50)
    found = similarity.similar_screens(pairs, screens(spark, d).select("screen_id", "pmid"), 5, exclude_same_study=True)
    return found.select("screen_b", r6("r").alias("r"), "overlap", F.round("z", 5).alias("z"))


# ---- graphs


@query(f"WITH {EDGES} SELECT a, b, round(strength, 6) AS strength, support, reciprocal FROM edges")
def network_edges(spark, d):
    return edges(spark, d).select("a", "b", r6("strength").alias("strength"), "support", "reciprocal")


EGO = f"""{EDGES}, part1 AS (SELECT CASE WHEN a = 17 THEN b ELSE a END AS node, strength, reciprocal FROM edges WHERE a = 17 OR b = 17),
use1 AS (SELECT * FROM part1 WHERE reciprocal = 1 OR NOT EXISTS (SELECT 1 FROM part1 WHERE reciprocal = 1)), nodes AS (SELECT node FROM (SELECT * FROM use1 ORDER BY strength DESC, node LIMIT 18) UNION SELECT 17)"""


@query(f"WITH {EGO} SELECT e.a, e.b, round(strength, 6) AS strength, reciprocal FROM edges e WHERE a IN (FROM nodes) AND b IN (FROM nodes)")
def ego_network(spark, d):
    e = edges(spark, d)
    nodes = graph.neighbourhood(e, 17)
    return graph.induced(e, nodes).select("a", "b", r6("strength").alias("strength"), "reciprocal")


@query(f"""WITH {EDGES}, way AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), few AS (SELECT a, b FROM edges),
na AS (SELECT f.a, f.b, w.b AS c FROM few f JOIN way w ON w.a = f.a WHERE w.b != f.b), nb AS (SELECT f.a, f.b, w.b AS c FROM few f JOIN way w ON w.a = f.b WHERE w.b != f.a),
x AS (SELECT a, b, count(*) AS k FROM na JOIN nb USING (a, b, c) GROUP BY ALL), p AS (SELECT a, b, count(*) AS k FROM na GROUP BY ALL), q AS (SELECT a, b, count(*) AS k FROM nb GROUP BY ALL)
SELECT f.a, f.b, coalesce(round(coalesce(x.k, 0) / nullif(coalesce(p.k, 0) + coalesce(q.k, 0) - coalesce(x.k, 0), 0), 3), 0.0) AS jaccard
FROM few f LEFT JOIN x ON x.a = f.a AND x.b = f.b LEFT JOIN p ON p.a = f.a AND p.b = f.b LEFT JOIN q ON q.a = f.a AND q.b = f.b""")
def neighbourhood_jaccard(spark, d):
    e = edges(spark, d)
    return graph.neighbourhood_jaccard(e, e.select("a", "b"))


INLINE = f"""{EGO.replace('LIMIT 18', 'LIMIT 14')}, {BEST}, hits AS (SELECT * FROM best WHERE hit),
ch AS (SELECT x.gene AS a, y.gene AS b FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL HAVING count(*) >= 6),
drawn AS (SELECT e.a, e.b, round(strength, 3) AS r, e.a = 17 OR e.b = 17 AS direct, CASE WHEN reciprocal = 1 AND ch.a IS NOT NULL THEN 1 WHEN reciprocal = 1 THEN 2 WHEN ch.a IS NOT NULL THEN 3 ELSE 4 END AS tier
  FROM edges e LEFT JOIN ch ON ch.a = e.a AND ch.b = e.b WHERE e.a IN (FROM nodes) AND e.b IN (FROM nodes))"""


def _inline(spark, d):
    cohits = pairwise.cohit_pairs(scored(spark, d), "gene", "screen_id", "percentile", "hit", 6)
    return details.inline_network(edges(spark, d), 17, cohits)


@query(f"WITH {INLINE} SELECT a, b, r, CAST(tier AS INTEGER) AS tier, direct FROM drawn")
def inline_network(spark, d):
    return _inline(spark, d)


@query(f"WITH {INLINE} SELECT CAST(t AS INTEGER) AS tier, count(drawn.tier) AS n FROM (VALUES (1), (2), (3), (4)) v(t) LEFT JOIN drawn ON drawn.tier = t AND direct GROUP BY t")
def direct_tiers(spark, d):
    return details.direct_tiers(_inline(spark, d))


@query(f"""WITH {EDGES}, {BEST}, hits AS (SELECT * FROM best WHERE hit), ch AS (SELECT x.gene AS a, y.gene AS b FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene < y.gene GROUP BY ALL HAVING count(*) >= 6),
tr AS (SELECT CASE WHEN reciprocal = 1 AND ch.a IS NOT NULL THEN 1 WHEN reciprocal = 1 THEN 2 WHEN ch.a IS NOT NULL THEN 3 ELSE 4 END AS tier FROM edges e LEFT JOIN ch ON ch.a = e.a AND ch.b = e.b)
SELECT CAST(t AS INTEGER) AS tier, count(tr.tier) AS n FROM (VALUES (1), (2), (3), (4)) v(t) LEFT JOIN tr ON tr.tier = t GROUP BY t""")
def edge_tiers(spark, d):
    cohits = pairwise.cohit_pairs(scored(spark, d), "gene", "screen_id", "percentile", "hit", 6)
    return graph.tier_histogram(graph.with_tiers(edges(spark, d), cohits))


@query(f"WITH {EDGES}, c AS (SELECT *, CASE WHEN a % 2 = 0 THEN 'even' ELSE 'odd' END AS context FROM edges) SELECT context, count(*) AS n_edges, CAST(sum(reciprocal) AS BIGINT) AS n_reciprocal, (SELECT count(*) FROM (SELECT a FROM c x WHERE x.context = c.context UNION SELECT b FROM c x WHERE x.context = c.context)) AS n_nodes FROM c GROUP BY context")
def network_contexts(spark, d):
    return graph.context_summary(edges(spark, d).withColumn("context", F.when(F.col("a") % 2 == 0, "even").otherwise("odd")))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def network_degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query("""WITH c AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_quantity AS q, l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_partkey != l_suppkey)
SELECT a, b, q FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY q DESC, o, l) AS rn FROM c) WHERE rn = 1""")
def canonical_edges(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("q"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    return graph.canonical(rows, "a", "b", [F.desc("q"), F.col("o"), F.col("l")]).select("a", "b", "q")


@query(f"""WITH {EDGES}, cx AS (SELECT p_partkey AS gene, p_size AS complex_id FROM part WHERE p_partkey % 3 != 0), ev AS (SELECT e.a, e.b, reciprocal FROM edges e WHERE a IN (SELECT gene FROM cx) AND b IN (SELECT gene FROM cx))
SELECT CASE WHEN reciprocal = 1 THEN 2 ELSE 4 END AS tier, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM cx x JOIN cx y USING (complex_id) WHERE x.gene = ev.a AND y.gene = ev.b) THEN 1 ELSE 0 END), 6) AS precision FROM ev GROUP BY 1""")
def complex_precision(spark, d):
    complexes = table(spark, d, "part").filter("p_partkey % 3 != 0").select(F.col("p_size").alias("complex_id"), F.col("p_partkey").alias("gene"))
    tiered = edges(spark, d).withColumn("tier", rules.edge_tier(F.col("reciprocal") == 1, F.lit(False)))
    return networks.complex_precision(tiered, complexes).withColumn("precision", r6("precision"))


# ---- a gene's footprint


@query(f"""WITH {SCORED}, {SCREENS} SELECT gene, domain, count(percentile) AS n, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate, round(median(percentile), 4) AS median, round(avg(percentile), 4) AS mean,
round(quantile_cont(percentile, 0.25), 4) AS p25, round(quantile_cont(percentile, 0.75), 4) AS p75, round(min(percentile), 4) AS min, round(max(percentile), 4) AS max,
CASE WHEN median(percentile) < -0.15 THEN 'essential' WHEN median(percentile) > 0.15 THEN 'advantageous' ELSE 'mixed' END AS lean FROM scored JOIN screens USING (screen_id) GROUP BY gene, domain""")
def gene_summary(spark, d):
    return serving.summary(_by_organism(spark, d), ["gene", "domain"])


@query(f"""WITH {SCORED}, b AS (SELECT gene, least(CAST(floor((percentile + 1.0::DOUBLE) / (2.0::DOUBLE / 26)) AS INTEGER) + 1, 26) AS bin FROM scored WHERE percentile IS NOT NULL), g AS (SELECT DISTINCT gene FROM b)
SELECT g.gene, CAST(r.bin AS INTEGER) AS bin, count(b.bin) AS n FROM g CROSS JOIN range(1, 27) r(bin) LEFT JOIN b ON b.gene = g.gene AND b.bin = r.bin GROUP BY ALL""")
def gene_histogram(spark, d):
    return serving.gene_histogram(scored(spark, d), ["gene"])


@query(f"""WITH {SCORED}, f AS (SELECT * FROM scored), lo AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY percentile, screen_id) AS rank FROM f), hi AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY percentile DESC, screen_id) AS rank FROM f)
SELECT gene, screen_id, 'essential' AS side, CAST(rank AS INTEGER) AS rank FROM lo WHERE rank <= 10 UNION ALL SELECT gene, screen_id, 'advantageous', CAST(rank AS INTEGER) FROM hi WHERE rank <= 10""")
def gene_extremes(spark, d):
    return serving.extremes(scored(spark, d), ["gene"]).select("gene", "screen_id", "side", "rank")


LEDGER = f"""{SCORED}, {SCREENS}, hits AS (SELECT gene, condition, 'drug' AS class, pmid AS paper, screen_id, percentile >= 0 AS pos FROM scored JOIN screens USING (screen_id) WHERE hit AND domain = 'stress'),
pp AS (SELECT gene, condition, class, paper, count(*) AS n, count(*) FILTER (pos) >= count(*) - count(*) FILTER (pos) AS positive FROM hits GROUP BY ALL),
tl AS (SELECT gene, condition, class, count(*) AS n_papers, CAST(sum(n) AS BIGINT) AS n_screens, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM pp GROUP BY ALL)"""


def _hits_of(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_organism(spark, d).withColumn("class", F.lit("drug")).withColumn("paper", F.col("pmid"))
    return rows.withColumn("sign", scores.effect_sign(F.col("percentile"), F.lit(None).cast("double")))


@query(f"WITH {LEDGER} SELECT gene, condition, class, CASE WHEN pos > neg THEN 'resist' WHEN pos < neg THEN 'sensitise' ELSE 'mixed' END AS direction, pos - neg AS net, n_papers, n_screens, greatest(pos, neg) AS n_agree FROM tl")
def stress_ledger(spark, d):
    return serving.stress_ledger(_hits_of(spark, d).filter("domain = 'stress'"), ["gene"])


@query(f"""WITH {BEST}, {SCREENS} SELECT gene, CASE WHEN condition LIKE '%A%' THEN lower(condition) || ' signaling' ELSE 'level of ' || cell_line END AS process, count(DISTINCT screen_id) AS n_screens, count(DISTINCT pmid) AS n_papers
FROM best JOIN screens USING (screen_id) WHERE hit AND domain IN ('reporter', 'other') GROUP BY ALL""")
def reporter_ledger(spark, d):
    rows = best(spark, d).join(screens(spark, d), "screen_id").filter(F.col("domain").isin("reporter", "other"))
    named = rows.withColumn("rationale", F.when(F.col("condition").like("%A%"), F.concat(F.lit("Negative regulators of "), F.lower("condition"), F.lit(" signaling"))).otherwise(" "))
    named = named.withColumn("phenotype", F.concat(F.lit("level of "), F.col("cell_line"))).withColumn("paper", F.col("pmid"))
    return serving.reporter_ledger(named, ["gene"])


@query(f"""WITH {BEST}, {SCREENS}, c AS (SELECT gene, organism, count(*) AS n FROM best JOIN screens USING (screen_id) GROUP BY ALL)
SELECT gene, organism, n FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, organism) AS rn FROM c) WHERE rn = 1""")
def best_organism(spark, d):
    return serving.best_organism(_by_organism(spark, d), ["gene"]).groupBy("gene", "organism").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORED} SELECT screen_id, gene, hit, round(percentile, 6) AS percentile FROM (SELECT * FROM scored WHERE screen_id = 3 ORDER BY hit DESC, abs(percentile) DESC NULLS LAST, gene LIMIT 600) ORDER BY hit DESC, abs(percentile) DESC NULLS LAST, gene LIMIT 200""")
def screen_gene_list(spark, d):
    return serving.screen_genes(scored(spark, d), 3).select("screen_id", "gene", "hit", r6("percentile").alias("percentile"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 100")
def order_page(spark, d):
    return serving.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], limit=500, offset=100)


@query(f"""WITH {BEST}, s AS (SELECT * FROM best WHERE screen_id = 3), e AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM s),
b AS (SELECT least(CAST(floor((least(greatest(score, lo), hi) - lo) / (hi - lo) * 40) AS INTEGER) + 1, 40) AS bin FROM s, e) SELECT CAST(r.bin AS INTEGER) AS bin, count(b.bin) AS n FROM range(1, 41) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY ALL""")
def gene_distribution(spark, d):
    return serving.distribution_of_gene(best(spark, d), 3, 10)[0]


@query(f"WITH {BEST}, f AS (SELECT screen_id, max(score) FILTER (gene % 50 = 7) AS focal FROM best GROUP BY 1) SELECT screen_id, round((count(*) FILTER (score < focal) + 0.5 * count(*) FILTER (score = focal)) / count(*), 6) AS focal_rank FROM best JOIN f USING (screen_id) GROUP BY screen_id")
def focal_rank(spark, d):
    rows = best(spark, d)
    focal = rows.groupBy("screen_id").agg(F.max(F.when(F.col("gene") % 50 == 7, F.col("score"))).alias("focal"))
    return windows.focal_rank(rows.join(focal, "screen_id"), ["screen_id"], "score", "focal").withColumn("focal_rank", r6("focal_rank"))


@query(f"WITH {SCREENS} SELECT count(*) AS n FROM screens WHERE organism = 'ASIA' AND domain IN ('fitness', 'stress') AND coverage = 'FULL' AND (lower(cell_line) LIKE '%1%' OR lower(cell_line) LIKE '%7%')")
def corpus_count(spark, d):
    keep = serving.corpus_filter("ASIA", ["fitness", "stress"], "FULL", cell_types=["1", "7"])
    return screens(spark, d).withColumnRenamed("cell_line", "cell_type").filter(keep).agg(F.count("*").alias("n"))


@query(f"""WITH {BEST}, {SCREENS} SELECT organism, count(*) AS n, count(DISTINCT gene) AS genes, count(*) FILTER (hit) AS hits, count(DISTINCT gene) FILTER (hit) AS hit_genes, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS hit_percentage,
round(avg(score) FILTER (hit), 4) AS mean_hit_score, array_to_string(list_sort(list(DISTINCT domain)), '|') AS domains FROM best JOIN screens USING (screen_id) GROUP BY organism HAVING count(DISTINCT gene) > 10""")
def organism_rollup(spark, d):
    return _by_organism(spark, d).groupBy("organism").agg(
        F.count("*").alias("n"), F.count_distinct("gene").alias("genes"), F.count_if("hit").alias("hits"), F.count_distinct(F.when(F.col("hit"), F.col("gene"))).alias("hit_genes"),
        F.round(100.0 * F.count_if("hit") / F.count("*"), 2).alias("hit_percentage"), F.round(F.avg(F.when(F.col("hit"), F.col("score"))), 4).alias("mean_hit_score"),
        F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("domains"),
    ).filter("genes > 10")


@query(f"""WITH {SCREENS}, {BEST}, c AS (SELECT screen_id, count(*) FILTER (hit) AS n_hits FROM best GROUP BY 1) SELECT s.screen_id, coalesce(n_hits, 0) AS n_hits, round(10.0 / log10(coalesce(n_hits, 0) + 2), 2) AS dark_score,
round(10.0 * (1 - least(greatest(log10(coalesce(n_hits, 0) + 1) / log10(1001), 0), 1)), 2) AS darkness FROM screens s LEFT JOIN c USING (screen_id)""")
def darkness_of_screens(spark, d):
    counts = best(spark, d).groupBy("screen_id").agg(F.count_if("hit").alias("n_hits"))
    joined = screens(spark, d).select("screen_id").join(counts, "screen_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return joined.select("screen_id", "n_hits", scores.dark_score(F.col("n_hits")).alias("dark_score"), scores.darkness(F.col("n_hits"), 1000)[0].alias("darkness"))


# ---- knowledge


def _index(spark: SparkSession, d: str) -> DataFrame:
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    genes = part.select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") % 2).alias("taxid"), F.col("p_name").alias("symbol"), F.col("p_type").alias("name"))
    aliases = part.select(F.col("p_partkey").alias("gene_id"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("alias"))
    hits = line.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("gene_id"))
    return knowledge.search_index(genes, aliases, hits, line.select(F.col("l_partkey").alias("gene_id")))


INDEX = """h AS (SELECT l_partkey AS gene_id, count(*) FILTER (l_returnflag = 'R') AS n_hits, count(*) AS n_papers FROM lineitem GROUP BY 1),
k AS (SELECT p_partkey AS gene_id, p_size % 2 AS taxid, p_name AS symbol, p_type AS name, p_brand || '-' || p_size AS alias, coalesce(n_hits, 0) AS n_hits, coalesce(n_papers, 0) AS n_papers FROM part LEFT JOIN h ON gene_id = p_partkey),
kr AS (SELECT *, CAST(floor(sqrt(n_papers + 1) * sqrt(n_hits + 1)) AS INTEGER) AS rank FROM k), al AS (SELECT *, row_number() OVER (PARTITION BY taxid, upper(alias) ORDER BY gene_id) AS rn FROM kr WHERE (taxid, upper(alias)) NOT IN (SELECT (taxid, upper(symbol)) FROM kr)),
idx AS (SELECT gene_id, taxid, symbol, upper(symbol) AS term, CAST(0 AS INTEGER) AS is_alias, n_hits, n_papers, rank, name FROM kr UNION ALL SELECT gene_id, taxid, symbol, upper(alias), 1, n_hits, n_papers, rank, name FROM al WHERE rn = 1)"""


@query(f"WITH {INDEX} SELECT * FROM idx")
def search_index(spark, d):
    return _index(spark, d)


@query(f"""WITH {INDEX}, f AS (SELECT *, row_number() OVER (ORDER BY is_alias, rank DESC, length(term), term) AS p FROM idx WHERE term LIKE 'B%'), w AS (SELECT * FROM f WHERE p <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p) AS rn FROM w)
SELECT symbol, term, rank FROM o WHERE rn = 1 ORDER BY p LIMIT 10""")
def gene_suggestions(spark, d):
    return serving.suggest(_index(spark, d).filter("taxid = 1").unionByName(_index(spark, d).filter("taxid = 0")), "b").select("symbol", "term", "rank")


@query(f"""WITH {INDEX}, names AS (SELECT upper(p_name) AS name FROM part UNION SELECT p_brand || '-' || p_size FROM part),
j AS (SELECT names.name, gene_id, symbol, CASE WHEN is_alias = 0 AND names.name = symbol THEN 0 WHEN is_alias = 0 THEN 1 ELSE 2 END AS priority FROM names JOIN idx ON term = upper(names.name))
SELECT name, gene_id, symbol, CAST(priority AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, gene_id) AS rn FROM j) WHERE rn = 1""")
def resolve_gene_names(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.upper("p_name").alias("name")).union(part.select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))).distinct()
    return knowledge.resolve_names(names, _index(spark, d).drop("name"))


@query(f"WITH {SCORED}, {SCREENS} SELECT gene, organism, round(avg(percentile), 6) AS mean_percentile, count(*) AS n FROM scored JOIN screens USING (screen_id) WHERE domain = 'fitness' AND percentile IS NOT NULL GROUP BY ALL")
def fitness_lean(spark, d):
    return knowledge.fitness_lean(_by_organism(spark, d)).withColumn("mean_percentile", r6("mean_percentile"))


FACTS = f"""{SCORED}, {SCREENS}, facts AS (SELECT gene, screen_id, domain, condition, percentile >= 0 AS pos, gene || ': knockout ' || CASE WHEN domain = 'stress' AND percentile >= 0 THEN 'confers resistance to ' || condition || ' (drug)'
WHEN domain = 'stress' THEN 'sensitises cells to ' || condition || ' (drug)' WHEN percentile >= 0 THEN 'raises the ' || condition || ' reporter' ELSE 'lowers the ' || condition || ' reporter' END || ' — an unpublished screen in ' || cell_line || '; author-called hit.' AS sentence
FROM scored JOIN screens USING (screen_id) WHERE hit AND domain IN ('stress', 'reporter'))"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits_of(spark, d).withColumns({"author": F.lit(None).cast("string"), "harmonized": F.col("percentile"), "robust_z": F.lit(None).cast("double")})
    return knowledge.stress_facts(rows)


@query(f"WITH {FACTS} SELECT gene, screen_id, sentence FROM facts")
def stress_facts(spark, d):
    return _facts(spark, d).select("gene", "screen_id", "sentence")


@query(f"""WITH {FACTS} SELECT gene, domain, 'drug' AS class, condition, count(*) FILTER (pos) AS n_resistance, count(*) FILTER (NOT pos) AS n_sensitising, count(DISTINCT screen_id) AS n_screens, count(*) FILTER (pos) - count(*) FILTER (NOT pos) AS net,
array_to_string(list_sort(list(DISTINCT CAST(screen_id AS VARCHAR))), ',') AS screens FROM facts GROUP BY gene, domain, condition""")
def stress_consensus(spark, d):
    return knowledge.stress_consensus(_facts(spark, d))


@query("""WITH v AS (SELECT l_partkey AS gene_id, l_suppkey AS model, max(sqrt(l_tax + 0.003) * 8.1 - 1.7) AS value FROM lineitem GROUP BY ALL)
SELECT gene_id, count(value) AS n_models, round(avg(value), 4) AS mean, count(*) FILTER (value < -0.5) AS n_dependent, count(*) FILTER (value < -1.0) AS n_strong, round(min(value), 4) AS lowest, min(model) FILTER (value = lo) AS lowest_model,
CASE WHEN count(*) FILTER (value < -0.5) / count(*) >= 0.9 THEN 'common_essential' WHEN count(*) FILTER (value < -0.5) >= 1 THEN 'selective' ELSE 'non_essential' END AS class FROM (SELECT *, min(value) OVER (PARTITION BY gene_id) AS lo FROM v) GROUP BY gene_id""")
def dependency_summary(spark, d):
    line = table(spark, d, "lineitem")
    values = line.groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("model")).agg(F.max(F.sqrt(F.col("l_tax") + 0.003) * 8.1 - 1.7).alias("value"))
    return knowledge.dependency_summary(values)


LINKS = """lk AS (SELECT 'P' || l_partkey AS pa, 'P' || (l_suppkey * 7 % 2000 + 1) AS pb, CAST(l_quantity * 20 AS INTEGER) AS combined_score, CAST(l_discount * 5000 AS INTEGER) AS coexpression, CAST(l_tax * 6000 AS INTEGER) AS experimental FROM lineitem),
pr AS (SELECT 'P' || p_partkey AS protein, p_partkey // 2 AS gene_id FROM part), ed AS (SELECT least(x.gene_id, y.gene_id) AS a, greatest(x.gene_id, y.gene_id) AS b, max(combined_score) AS combined_score, max(coexpression) AS coexpression, max(experimental) AS experimental
FROM lk JOIN pr x ON x.protein = pa JOIN pr y ON y.protein = pb WHERE combined_score >= 400 AND x.gene_id != y.gene_id GROUP BY 1, 2)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    links = line.select(
        F.concat(F.lit("P"), "l_partkey").alias("protein_a"), F.concat(F.lit("P"), F.col("l_suppkey") * 7 % 2000 + 1).alias("protein_b"), (F.col("l_quantity") * 20).cast("int").alias("combined_score"),
        F.round(F.col("l_discount") * 5000).cast("int").alias("coexpression"), F.round(F.col("l_tax") * 6000).cast("int").alias("experimental"),
    )
    return knowledge.string_edges(links, part.select(F.concat(F.lit("P"), "p_partkey").alias("protein"), F.floor(F.col("p_partkey") / 2).alias("gene_id")))


@query(f"WITH {LINKS} SELECT a, b, combined_score FROM ed")
def link_edges(spark, d):
    return _links(spark, d).select("a", "b", "combined_score")


@query("""WITH w AS (SELECT p_partkey AS a, p_partkey % 50 + 3000 AS b, 1.0 - (1.0 - p_size / 1000.0) * (1.0 - (p_size * 3 % 700) / 1000.0) AS weight FROM part), ways AS (SELECT * FROM w UNION ALL SELECT b, a, weight FROM w)
SELECT a AS gene, b AS neighbour, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(weight, 9) DESC, b) AS rn FROM ways WHERE weight > 0) WHERE rn <= 30""")
def clean_neighbours(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 50 + 3000).alias("b"), F.col("p_size").alias("x"), (F.col("p_size") * 3 % 700).alias("y"))
    return knowledge.clean_neighbours(rows, ["x", "y"]).withColumn("weight", r6("weight"))


PREDICT = """nb AS (SELECT DISTINCT l_suppkey AS gene, l_partkey AS neighbour, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS layer, l_quantity AS w FROM lineitem),
nl AS (SELECT gene, layer, neighbour, max(w) AS w FROM nb GROUP BY ALL), nw AS (SELECT gene, neighbour, sum(w / m) AS weight, list(layer) AS layers FROM (SELECT *, max(w) OVER (PARTITION BY gene, layer) AS m FROM nl) GROUP BY ALL)"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("neighbour"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y").alias("layer"), F.col("l_quantity").alias("w"))
    return windows.sum_layers(rows.groupBy("gene", "layer", "neighbour").agg(F.max("w").alias("w")), ["gene"], "layer", "neighbour", "w")


@query(f"WITH {PREDICT} SELECT gene, neighbour, round(weight, 6) AS weight, array_to_string(list_sort(layers), '+') AS layers FROM nw")
def layered_neighbours(spark, d):
    return _layers(spark, d).select("gene", "neighbour", r6("weight").alias("weight"), F.array_join("layers", "+").alias("layers"))


@query(f"""WITH {PREDICT}, an AS (SELECT DISTINCT p_partkey AS gene, p_type || '/' || p_size AS term, p_partkey % 9 != 0 AS positive FROM part), gv AS (SELECT DISTINCT gene AS neighbour, term FROM an WHERE positive),
sz AS (SELECT term FROM gv GROUP BY 1 HAVING count(*) BETWEEN 2 AND 300), vt AS (SELECT nw.gene, term, sum(weight) AS score, count(DISTINCT neighbour) AS n_support, list_sort(list_distinct(flatten(list(layers)))) AS layers FROM nw JOIN gv USING (neighbour) JOIN sz USING (term) GROUP BY ALL HAVING count(DISTINCT neighbour) >= 2),
cd AS (SELECT * FROM vt ANTI JOIN an ON an.gene = vt.gene AND an.term = vt.term), rk AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(score, 9) DESC, term) AS rank FROM cd)
SELECT gene, term, round(score, 6) AS score, n_support, CAST(rank AS INTEGER) AS rank, CASE WHEN len(layers) >= 2 AND n_support >= 3 THEN 'high' WHEN n_support >= 4 OR len(layers) >= 2 THEN 'moderate' ELSE 'tentative' END AS confidence FROM rk WHERE rank <= 8""")
def predicted_terms(spark, d):
    part = table(spark, d, "part")
    annotations = part.select(F.col("p_partkey").alias("gene"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("term"), (F.col("p_partkey") % 9 != 0).alias("positive")).distinct()
    found = serving.predict_terms(_layers(spark, d), annotations, least_size=2)
    return found.select("gene", "term", r6("score").alias("score"), "n_support", "rank", "confidence")


@query(f"""WITH {BEST}, hits AS (SELECT screen_id, gene FROM best WHERE hit), h AS (SELECT gene, count(*) AS n FROM hits GROUP BY 1), c AS (SELECT x.gene AS a, y.gene AS b, count(*) AS c FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene != y.gene GROUP BY ALL),
l AS (SELECT a, c / sqrt(p.n * q.n) AS lift, CASE WHEN x.p_size % 10 = y.p_size % 10 THEN 1 ELSE 0 END AS label FROM c JOIN h p ON p.gene = a JOIN h q ON q.gene = b JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),
r AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY lift) + (count(*) OVER (PARTITION BY a, lift) - 1) / 2.0 AS rk FROM l), s AS (SELECT a, sum(label) AS p, count(*) - sum(label) AS n, coalesce(sum(rk) FILTER (label = 1), 0) AS rs FROM r GROUP BY a)
SELECT a AS gene, round((rs - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM s WHERE p > 0 AND n > 0""")
def backtest_auroc(spark, d):
    hits = best(spark, d).filter("hit").select("screen_id", "gene")
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 10).alias("group"))
    return plans_builders.coscreen_auroc(hits, groups).withColumn("auroc", r6("auroc"))


# ---- significance, and thresholds


@query("""WITH p AS (SELECT l_discount * l_discount * l_tax + l_orderkey % 97 / 100000.0 AS p FROM lineitem), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM p) SELECT round(coalesce(max(p) FILTER (p <= k / 70000.0 * 0.05), 0), 9) AS threshold FROM r""")
def bh_threshold(spark, d):
    p = F.col("l_discount") * F.col("l_discount") * F.col("l_tax") + F.col("l_orderkey") % 97 / 100000.0
    return windows.bh_threshold(table(spark, d, "lineitem").select(p.alias("p")), "p", 70000, 0.05).withColumn("threshold", F.round("threshold", 9))


@query("""WITH t AS (SELECT i, 0.15 + i * 0.005 AS t FROM range(150) g(i)), c AS (SELECT i, t, (SELECT count(*) FROM lineitem WHERE l_quantity % 2 = 0 AND l_quantity >= 50 * t - 1e-7) AS r, (SELECT count(*) FROM lineitem WHERE l_quantity % 2 = 1 AND l_quantity >= 60 * t - 1e-7) AS n FROM t)
SELECT round(CAST(coalesce(min(t) FILTER (r >= 1 AND n <= 0.85 * r), 0.90) AS DOUBLE), 3) AS threshold FROM c""")
def fdr_threshold(spark, d):
    line = table(spark, d, "lineitem")
    real = line.filter("l_quantity % 2 = 0").select((F.col("l_quantity") / 50).alias("r"))
    null = line.filter("l_quantity % 2 = 1").select((F.col("l_quantity") / 60).alias("r"))
    return windows.fdr_sweep(real, null, "r", 0.15, 0.90, 0.005, 0.85)


@query(f"""WITH c AS (SELECT p_partkey, p_size AS r, p_size // 2 + 5 AS k, p_size // 4 + 1 AS a, 60 AS n FROM part), t AS (SELECT p_partkey, r, k, n, a, unnest(range(greatest(a, r + k - n), least(r, k) + 1)) AS x FROM c)
SELECT p_partkey, round(CASE WHEN max(a) <= greatest(0, max(r + k - n)) THEN 1.0 ELSE sum({HYPER.format(n='n', r='r', k='k')}) END, 9) AS p FROM t GROUP BY p_partkey""")
def hypergeometric_tail(spark, d):
    size = F.col("p_size")
    found = table(spark, d, "part").select("p_partkey", hypergeom_sf(F.floor(size / 4) + 1, F.lit(60), size, F.floor(size / 2) + 5).alias("p"), F.least(size, F.floor(size / 2) + 5).alias("most"))
    return found.filter(F.col("most") >= 1).select("p_partkey", F.round("p", 9).alias("p"))


# ---- rules, on cases whose answers are written down

CASES = {
    "score_role": (
        lambda x: rules.score_role(x),
        [("Log2FC", "DIR_POS"), ("Bayes Factor", "DIR_NEG"), ("STARS Score", "SIG_MAG"), ("MaGeCK Score", "SIG_P"), ("Rank", "IGNORE"), ("Log10 (p-Value)", "AMBIGUOUS_LOG"), ("adjusted p-val", "SIG_P"), ("some effect", "DIR_POS"), ("colour", "UNKNOWN"), ("-", None)],
    ),
    "mechanism": (lambda x: rules.mechanism(x), [("Olaparib 5uM", "DDR·PARP"), ("CDK9i", "CDK"), ("Rapamycin", "mTOR/PI3K"), ("hydroxychloroquine", "Autophagy"), ("H2O2", "Oxidative"), ("water", None)]),
    "selection_method": (lambda x: rules.selection_method(x)["value"], [("Negative Selection", "Negative"), ("Positive and Negative Selection", "Bidirectional"), ("FACS sort", "Phenotype"), ("", "Unknown")]),
    "assay_domain": (lambda x: rules.assay_domain(x)["value"], [("cell proliferation", "fitness"), ("response to chemicals", "stress"), ("protein/peptide accumulation", "reporter"), ("drug resistance", "stress"), ("", "other"), ("shape", "other")]),
    "condition_class": (lambda x: rules.condition_class(x, F.lit(""), F.lit(""))["class"], [("Timecourse", "baseline"), ("Drug Exposure", "drug"), ("Cytokine Exposure", "signal"), ("other", "unknown")]),
    "condition_keyword": (lambda x: rules.condition_class(F.lit("other"), x, F.lit(""))["class"], [("WNT withdrawal", "signal"), ("glucose", "unknown"), ("low glucose", "nutrient"), ("surfaceome", "binding"), ("ferroptosis", "drug")]),
    "organism": (lambda x: rules.organism(x), [("Mus musculus", "mouse"), ("10090", "mouse"), ("Homo sapiens", "human"), ("yeast", "human"), (None, "human")]),
    "lean": (lambda x: scores.lean(x.cast("double")), [("-0.2", "essential"), ("-0.15", "mixed"), ("0.151", "advantageous")]),
    "control": (lambda x: scores.is_control(x).cast("string"), [("STAT1", "false"), ("SGR000121914.1_XPR003.1", "true"), ("NTC_001", "true"), ("safe-harbor-1", "true"), ("", "true"), (None, "true")]),
    "process": (lambda x: scores.process_name(x, F.lit("ph")), [("Negative regulators of NFkB signaling", "NFkB signaling"), ("Genes involved in autophagy", "autophagy"), ("", "ph")]),
    "squash": (lambda x: scores.squash(x), [("KMS-12-BM", "KMS12BM"), ("kms 12", "KMS12")]),
}


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _listed(values: list) -> str:
    return "[" + ", ".join(_literal(v) for v in values) + "]"


@query("SELECT p_partkey, rule, given[p_partkey % len(given) + 1] AS given, found[p_partkey % len(found) + 1] AS found FROM part, (VALUES " + ", ".join(f"('{name}', {_listed([a for a, _ in cases])}, {_listed([b for _, b in cases])})" for name, (_, cases) in CASES.items()) + ") v(rule, given, found)")
def rule_cases(spark, d):
    """Each part carries one of a rule's texts, for every rule."""
    part = table(spark, d, "part").select("p_partkey")
    judged = []
    for name, (rule, cases) in CASES.items():
        text = F.get(F.array(*[F.lit(a).cast("string") for a, _ in cases]), (F.col("p_partkey") % len(cases)).cast("int"))
        judged.append(F.struct(F.lit(name).alias("rule"), text.alias("given"), rule(text).cast("string").alias("found")))
    return part.select("p_partkey", F.explode(F.array(*judged)).alias("j")).select("p_partkey", "j.rule", "j.given", "j.found")


# ---- documents of events


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, date_trunc('hour', ts) AS start FROM events GROUP BY 1, 4")
def event_windows(spark, d):
    found = windowed_counts(table(spark, d, "events"))
    return found.select("event_type", "n", F.round("total", 4).alias("total"), F.col("start").cast("timestamp_ntz").alias("start"))


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("SELECT 'gene' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'both', count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem)")
def node_sets(spark, d):
    line = table(spark, d, "lineitem")
    a, b = line.select(F.col("l_partkey").alias("k")), line.select(F.col("l_suppkey").alias("k"))
    parts = [("gene", a.union(b).distinct()), ("both", a.intersect(b)), ("only", a.subtract(b))]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---- details


@query(f"""WITH {SCORED}, {SCREENS}, c AS (SELECT gene, count(DISTINCT screen_id) AS screens, count(DISTINCT screen_id) FILTER (hit) AS hit_screens, avg(percentile) FILTER (hit) AS m FROM scored GROUP BY 1),
p AS (SELECT DISTINCT gene, CAST(pmid AS VARCHAR) AS pmid, cell_line FROM scored JOIN screens USING (screen_id) WHERE hit), k AS (SELECT gene, min(pmid || '/' || cell_line) AS first_citation FROM p GROUP BY 1)
SELECT gene, screens, hit_screens, round(coalesce(m, 0), 6) + 0 AS correlation, round(10.0 / log10(hit_screens + 2), 2) AS dark_score, hit_screens > 50 AS is_bright, first_citation FROM c LEFT JOIN k USING (gene)""")
def gene_details(spark, d):
    papers = screens(spark, d).select("screen_id", F.col("pmid"), F.col("cell_line").alias("author"))
    found = details.gene_details(scored(spark, d), papers)
    first = F.array_min(F.transform("citations", lambda c: F.concat_ws("/", c["pmid"], c["author"])))
    return found.select("gene", "screens", "hit_screens", r6("correlation").alias("correlation"), "dark_score", "is_bright", first.alias("first_citation"))


@query(f"""WITH {SCORED}, f AS (SELECT * FROM scored WHERE percentile IS NOT NULL), m AS (SELECT x.gene AS a, y.gene AS b, count(*) AS n, sum(x.percentile) AS sx, sum(y.percentile) AS sy, sum(x.percentile * y.percentile) AS sxy, sum(x.percentile ** 2) AS sxx, sum(y.percentile ** 2) AS syy
FROM f x JOIN f y ON x.screen_id = y.screen_id AND x.gene < y.gene AND (x.hit OR y.hit) GROUP BY ALL HAVING count(*) >= 8)
SELECT a, b, n, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 5) + 0 AS r FROM m WHERE n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0""")
def anchored_correlations(spark, d):
    found = details.anchored_correlations(scored(spark, d), 8)
    return found.select("a", "b", "n", (F.round("r", 5) + F.lit(0.0)).alias("r"))


@query(f"""WITH {EGO}, {SCORED}, {SCREENS}, lean AS (SELECT gene, avg(percentile) AS m FROM scored JOIN screens USING (screen_id) WHERE domain = 'fitness' GROUP BY 1)
SELECT node, round(m, 3) AS mean_percentile, CASE WHEN m < -0.15 THEN 'essential' WHEN m > 0.15 THEN 'advantageous' WHEN m IS NOT NULL THEN 'mixed' ELSE 'unknown' END AS lean, node = 17 AS focus FROM nodes LEFT JOIN lean ON gene = node""")
def coloured_network(spark, d):
    fitness = _by_organism(spark, d).filter("domain = 'fitness'").groupBy("gene").agg(F.avg("percentile").alias("mean_percentile"))
    return details.coloured_nodes(graph.neighbourhood(edges(spark, d), 17).select("node"), fitness, 17)


@query(f"""WITH {EDGES}, w AS (SELECT a, b, strength, reciprocal FROM edges UNION ALL SELECT b, a, strength, reciprocal FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY strength DESC, b) AS rank FROM w),
t AS (SELECT r.*, CASE WHEN reciprocal = 1 AND (r.a + r.b) % 3 = 0 THEN 1 WHEN reciprocal = 1 THEN 2 WHEN (r.a + r.b) % 3 = 0 THEN 3 ELSE 4 END AS tier FROM r WHERE rank <= 18)
SELECT a AS gene, b AS partner, CAST(rank AS INTEGER) AS rank, CAST(tier AS INTEGER) AS tier, CASE WHEN (a + b) % 3 = 0 THEN 1.5 END AS fold, p_type AS term FROM t JOIN part ON p_partkey = b""")
def partner_dossiers(spark, d):
    e = edges(spark, d)
    cohits = e.filter("(a + b) % 3 = 0").select("a", "b", F.lit(1.5).alias("fold"))
    part = table(spark, d, "part")
    terms = part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"), F.lit(True).alias("positive"))
    pathways = part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("pathway"))
    lean = part.select(F.col("p_partkey").alias("gene"), F.lit(0.0).alias("mean_percentile"))
    found = details.dossiers(e, cohits, terms, pathways, lean)
    return found.select("gene", "partner", "rank", "tier", "fold", F.col("terms")[0].alias("term"))


@query(f"""WITH {BEST}, {SCREENS}, h AS (SELECT gene, domain AS phenotype, condition FROM best JOIN screens USING (screen_id) WHERE hit), n AS (SELECT gene, phenotype, count(*) AS n FROM h GROUP BY ALL),
c AS (SELECT gene, phenotype, condition, count(*) AS k FROM h GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY gene, phenotype ORDER BY k DESC, condition) AS r FROM c)
SELECT gene, phenotype, n, condition AS first_condition, k AS times FROM n JOIN t USING (gene, phenotype) WHERE r = 1""")
def hit_facets(spark, d):
    rows = best(spark, d).filter("hit").join(screens(spark, d), "screen_id").select("gene", "screen_id", F.col("domain").alias("phenotype"), "condition", F.col("cell_line").alias("cell_type"))
    return details.hit_facets(rows).select("gene", "phenotype", "n", F.col("condition")[0]["value"].alias("first_condition"), F.col("condition")[0]["n"].alias("times"))


@query(f"""WITH {SCREENS}, {BEST}, h AS (SELECT screen_id, count(*) FILTER (hit) AS n FROM best GROUP BY 1) SELECT screen_id, cell_line, n AS n_hits FROM screens JOIN h USING (screen_id)
WHERE screen_id % 2 = 0 AND (contains(lower(replace(replace(cell_line, '-', ''), ' ', '')), '00001') OR contains(lower(cell_line), '0000-1') OR contains(lower(condition), '0000-1') OR starts_with(CAST(screen_id AS VARCHAR), '0000-1')) ORDER BY n DESC, screen_id LIMIT 8""")
def screen_suggestions(spark, d):
    hits = best(spark, d).groupBy("screen_id").agg(F.count_if("hit").cast("string").alias("number_of_hits"))
    rows = screens(spark, d).join(hits, "screen_id").withColumns({"phenotype": F.lit(None).cast("string"), "author": F.lit("")})
    found = details.suggest_screens(rows, screens(spark, d).filter("screen_id % 2 = 0"), "0000-1")
    return found.select("screen_id", "cell_line", F.col("number_of_hits").cast("long").alias("n_hits"))


@query(f"""WITH {SCORED}, {SCREENS}, u AS (SELECT screen_id, count(percentile) AS n_genes FROM scored GROUP BY 1), m AS (SELECT s.screen_id, domain, coverage, CASE screen_id % 3 WHEN 0 THEN 'Knockout' WHEN 1 THEN 'Activation' ELSE 'Other' END AS methodology FROM screens s)
SELECT m.screen_id, domain, CASE methodology WHEN 'Knockout' THEN 'KO' WHEN 'Activation' THEN 'CRISPRa' ELSE methodology END AS modality, CAST(CASE methodology WHEN 'Knockout' THEN -1 WHEN 'Activation' THEN 1 ELSE 0 END AS INTEGER) AS sign,
CASE WHEN domain = 'stress' THEN 'CDK' END AS mechanism, coverage, coalesce(n_genes, 0) AS n_genes FROM m LEFT JOIN u USING (screen_id)""")
def screen_contexts(spark, d):
    k = F.col("screen_id") % 3
    rows = screens(spark, d).withColumns({"methodology": F.when(k == 0, "Knockout").when(k == 1, "Activation").otherwise("Other"), "class": F.when(F.col("domain") == "stress", "drug").otherwise("baseline"), "condition": F.lit("palbociclib 1uM")})
    found = details.screen_contexts(rows, scored(spark, d))
    return found.select("screen_id", "domain", "modality", "sign", "mechanism", "coverage", "n_genes")


@query(f"""WITH {SCORED}, m AS (SELECT screen_id, count(percentile) AS n_panel, avg(percentile) AS panel_mean FROM scored WHERE gene % 40 = 3 GROUP BY 1)
SELECT s_suppkey AS screen_id, n_panel, round(panel_mean, 6) + 0 AS panel_mean, coalesce(s_suppkey % 2 = 0 AND n_panel >= 3 AND panel_mean > 0, false) AS conflict FROM supplier LEFT JOIN m ON screen_id = s_suppkey""")
def direction_vetoes(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("screen_id"))
    described = supplier.withColumns({"methodology": F.when(F.col("screen_id") % 2 == 0, "Knockout").otherwise("Inhibition"), "phenotype": F.lit("cell proliferation"), "rationale": F.lit(None).cast("string")})
    panel = table(spark, d, "part").filter("p_partkey % 40 = 3").select(F.col("p_partkey").alias("gene"))
    found = details.veto_directions(scored(spark, d), described, supplier, panel)
    return found.select("screen_id", "n_panel", r6("panel_mean").alias("panel_mean"), "conflict")


@query(f"""WITH {BEST}, {SCREENS}, al AS (SELECT p_partkey AS gene_id, count(DISTINCT p_brand) AS n_aliases FROM part GROUP BY 1), h AS (SELECT gene AS gene_id, count(*) AS n_hits, count(DISTINCT domain) AS n_phenotypes FROM best JOIN screens USING (screen_id) WHERE hit GROUP BY 1)
SELECT p_partkey AS gene_id, p_name AS symbol, n_aliases, coalesce(n_hits, 0) AS n_hits, coalesce(n_phenotypes, 0) AS n_phenotypes, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n_terms FROM part JOIN al ON al.gene_id = p_partkey LEFT JOIN h ON h.gene_id = p_partkey""")
def gene_bundles(spark, d):
    part = table(spark, d, "part")
    genes = part.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"))
    terms = part.select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("term"), F.lit("bp").alias("namespace"), F.when(F.col("p_partkey") % 4 == 0, "NOT|involved_in").alias("qualifier"))
    hits = best(spark, d).filter("hit").join(screens(spark, d), "screen_id").select(F.col("gene").alias("gene_id"), F.col("domain").alias("phenotype"))
    links = edges(spark, d).select("a", "b", F.col("strength").alias("combined_score"))
    found = details.gene_bundle(genes, part.select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("alias")), terms, links, hits)
    size = lambda c: F.greatest(F.size(F.col(c)), F.lit(0))
    return found.select("gene_id", "symbol", size("aliases").cast("long").alias("n_aliases"), "n_hits", F.coalesce(size("phenotypes"), F.lit(0)).cast("long").alias("n_phenotypes"), F.coalesce(size("terms"), F.lit(0)).alias("n_terms"))


@query("""SELECT p_partkey AS gene, id, verdict, confidence, n_support FROM part, (VALUES (1, 'verified', 'high', 2), (2, 'rejected:not-novel', 'high', 2), (3, 'single-supporter', 'moderate', 1), (4, 'verified', 'moderate', 1), (5, 'rejected:no-verifiable-support', 'low', 0), (6, 'verified', 'low', 2)) v(id, verdict, confidence, n_support) WHERE p_partkey % 7 != 6 OR id != 2
UNION ALL SELECT p_partkey, 2, 'verified', 'high', 2 FROM part WHERE p_partkey % 7 = 6""")
def prediction_verdicts(spark, d):
    """Each part is a gene with six partners and six predictions; every seventh knows no term yet."""
    part = table(spark, d, "part")
    gene = part.select(F.col("p_partkey").alias("gene")).repartition(max(4, part.count() // 20_000), "gene")  # a file of few bytes is one task, with all rows made of it

    def listed(rows: list[tuple], schema: str) -> DataFrame:
        kind = f"array<struct<{schema}>>"
        names = [c.split(":")[0] for c in schema.split(",")]
        cells = [F.struct(*[(F.array(*[F.lit(y) for y in x]) if isinstance(x, list) and x else F.array() if isinstance(x, list) else F.lit(x)).alias(n) for n, x in zip(names, row)]) for row in rows]
        return gene.select("gene", F.explode(F.array(*[c.cast(kind[6:-1]) for c in cells])).alias("r")).select("gene", "r.*")

    partners = [("a", 0.9, 1, 1, ["t"]), ("b", 0.8, 1, 2, ["t"]), ("c", 0.7, 0, 3, ["t"]), ("x", 0.6, 0, 4, ["t"]), ("y", 0.5, 0, 4, ["t"]), ("z", 0.5, 0, 4, [])]
    dossier = listed(partners, "partner:string,strength:double,reciprocal:int,tier:int,terms:array<string>").withColumn("pathways", F.array().cast("array<string>"))
    cases = [(1, "new one", ["a", "b", "q"]), (2, " Known ", ["a", "b"]), (3, "three", ["c", "c"]), (4, "four", ["a", "z"]), (5, "five", ["z"]), (6, "six", ["x", "y"]), (7, " ", ["a"])]
    predictions = listed(cases, "id:int,name:string,cited:array<string>")
    own = gene.filter("gene % 7 != 6").select("gene", F.lit("known").alias("name"))
    return details.weigh_predictions(predictions, dossier, own).select("gene", "id", "verdict", "confidence", F.col("n_support").cast("int").alias("n_support"))


# ---- uploads: each supplier's line items as a file of one of four formats

UPLOAD_HEADERS = ["id\tnum\tneg|score\tneg|lfc", "Gene,q-value,p-value,LFC,Rank", "gene\tbaseMean\tlog2FoldChange\tlfcSE\tpadj", "gene_symbol,score"]
UPLOAD_FORMATS = [("MAGECK", "id", "neg|lfc"), ("STARS", "Gene", "LFC"), ("DESEQ2", "gene", "log2FoldChange"), ("SIMPLE", "gene_symbol", "score")]
#: A screen's scores lean one way or the other, by its key; some rows have no identifier, some no score.
UPLOADED = """up AS (SELECT l_suppkey AS file, l_linenumber = 7 AS nameless, l_quantity = 10 AS scoreless, CASE WHEN l_quantity = 10 THEN 0 ELSE l_quantity - 60 * (l_suppkey % 3) / 2 END AS score FROM lineitem),
counted AS (SELECT file, count(*) FILTER (NOT nameless) AS n_genes, count(*) FILTER (nameless) AS n_skipped, count(*) FILTER (NOT nameless AND scoreless) AS n_without_score,
  count(*) FILTER (NOT nameless AND score < 0) AS neg, count(*) FILTER (NOT nameless AND score > 0) AS pos FROM up GROUP BY file)"""


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    kind = (F.col("l_suppkey") % 4).cast("int")
    symbol = F.when(F.col("l_linenumber") == 7, '""').otherwise(F.concat(F.lit("G"), F.col("l_partkey").cast("string")))
    value = F.when(F.col("l_quantity") == 10, "").otherwise((F.col("l_quantity") - 60 * (F.col("l_suppkey") % 3) / 2).cast("decimal(12,2)").cast("string"))
    lines = [F.concat_ws("\t", symbol, F.lit("4"), F.lit("0.1"), value), F.concat_ws(",", symbol, F.lit("0.1"), F.lit("0.2"), value, F.lit("1")), F.concat_ws("\t", symbol, F.lit("9"), value, F.lit("1"), F.lit("NA")), F.concat_ws(",", symbol, value)]
    line = F.get(F.array(*lines), kind)
    header = F.get(F.array(*[F.lit(h) for h in UPLOAD_HEADERS]), (F.col("file") % 4).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), line.alias("line"))
    return rows.groupBy("file").agg(F.collect_list("line").alias("lines")).select("file", F.concat(header, F.lit("\n"), F.array_join("lines", "\n")).alias("text"))


@query("WITH formats AS (SELECT unnest(range(4)) AS k, unnest([" + ", ".join(f"'{f}'" for f, _, _ in UPLOAD_FORMATS) + "]) AS format, unnest([" + ", ".join(f"'{c}'" for _, c, _ in UPLOAD_FORMATS) + "]) AS id_column, unnest([" + ", ".join(f"'{c}'" for _, _, c in UPLOAD_FORMATS) + "]) AS score_column) SELECT file, format, id_column, score_column, CAST(0.95 AS DOUBLE) AS confidence FROM (SELECT DISTINCT l_suppkey AS file FROM lineitem) JOIN formats ON k = file % 4")
def upload_formats(spark, d):
    return upload.detect(_uploads(spark, d)).select("file", *[F.col(f"found.{c}").alias(c) for c in ("format", "id_column", "score_column", "confidence")])


@query(f"""WITH {UPLOADED} SELECT file, n_genes, -1 AS hit_count, 'FULL' AS coverage,
  CASE WHEN least(neg, pos) > 0 AND least(neg, pos) / n_genes > 0.15 THEN 'bidirectional' WHEN neg > pos THEN 'depletion' WHEN pos > neg THEN 'enrichment' END AS direction FROM counted WHERE n_genes >= {V.MIN_UPLOAD_GENES}""")
def upload_signals(spark, d):
    return upload.signals(upload.parse_genes(_uploads(spark, d))[0]).withColumn("hit_count", F.coalesce("hit_count", F.lit(-1)))


@query(f"WITH {UPLOADED} SELECT file, n_genes, n_skipped, n_without_score, n_genes >= {V.MIN_UPLOAD_GENES} AS accepted FROM counted")
def upload_reports(spark, d):
    return upload.parse_genes(_uploads(spark, d))[1].drop("warnings")


@query("""WITH g AS (SELECT p_partkey AS k, p_size > 10 AS known, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') || '.' || p_size ELSE 'Gene' || p_partkey END AS symbol FROM part)
SELECT symbol, CASE WHEN known THEN 'S' || k WHEN k % 3 = 2 THEN upper(symbol) ELSE symbol END AS resolved, known AS mapped FROM g""")
def upload_resolution(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    ensembl = F.concat(F.lit("ENSG"), F.lpad(k, 11, "0"))
    kinds = [("entrez", k, k), ("ensembl", ensembl, F.concat(ensembl, F.lit("."), F.col("p_size").cast("string"))), ("ortholog", F.concat(F.lit("Gene"), k), F.concat(F.lit("Gene"), k))]
    of = (F.col("p_partkey") % 3).cast("int")
    walk = part.filter("p_size > 10").select(*[F.get(F.array(*x), of).alias(n) for n, x in (("kind", [F.lit(a) for a, _, _ in kinds]), ("id", [b for _, b, _ in kinds]))], F.concat(F.lit("S"), k).alias("target"))
    genes = part.select(F.get(F.array(*[c for _, _, c in kinds]), of).alias("symbol"))
    return upload.resolve_ids(genes, walk, "Mouse").select("symbol", "resolved", "mapped")


@query("""WITH known AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN upper(p_name[1]) || lower(p_name[2:]) ELSE p_name END AS symbol FROM part),
typed AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 2 = 0),
forms AS (SELECT name, name AS form, 0 AS o FROM typed UNION ALL SELECT name, upper(name), 1 FROM typed UNION ALL SELECT name, upper(name[1]) || lower(name[2:]), 2 FROM typed)
SELECT name, symbol FROM (SELECT name, symbol, row_number() OVER (PARTITION BY name ORDER BY o) AS rn FROM forms JOIN known ON symbol = form) WHERE rn = 1""")
def known_casings(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey") % 3
    capital = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substring(p_name, 2)")))
    known = part.select(F.when(k == 0, F.upper("p_name")).when(k == 1, capital).otherwise(F.col("p_name")).alias("symbol")).distinct()
    return details.known_casing(part.filter("p_partkey % 2 = 0").select(F.lower("p_name").alias("name")).distinct(), known).select("name", "symbol")


@query(f"""WITH {BEST}, v AS (SELECT screen_id, CAST(gene AS VARCHAR) AS gene, CAST(paper % 41 - 20 AS DOUBLE) AS x FROM best)
SELECT screen_id, gene, CASE screen_id % 4 WHEN 1 THEN CASE WHEN x != 1 THEN -x END WHEN 2 THEN NULL WHEN 3 THEN -x ELSE 1.0 - x END AS harmonized FROM v""")
def harmonized_overrides(spark, d):
    """Screens by their key: one column negated without its sentinel, quarantined, by the rule for the score's type, or a pair of columns by direction."""
    text = [F.lit(None).cast("string").alias(f"score_{i}") for i in (3, 4, 5)]
    scores_ = best(spark, d).select("screen_id", F.col("gene").cast("string").alias("gene"), (F.col("paper") % 41 - 20).cast("double").cast("string").alias("score_1"), F.lit("1.0").alias("score_2"), *text, F.lit("NO").alias("hit"))
    screen, k = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("screen_id")), F.col("screen_id") % 4
    kind = F.when(k == 1, "Log10").when(k == 2, "Log2FC").when(k == 3, "Bayes Factor").otherwise("any")
    blank = [F.lit("").alias(f"type_{i}") for i in (3, 4, 5)]
    metadata = screen.select("screen_id", kind.alias("type_1"), F.lit("other").alias("type_2"), *blank, F.lit("Phenotype Screen").alias("screen_type"), F.lit("Knockout").alias("methodology"), F.lit("").alias("library_type"))
    fields = lambda schema, values: [F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for c, v in zip(schema.split(", ")[1:], values)]
    overrides = screen.filter(k == 1).select("screen_id", *fields(harmonize.OVERRIDES_SCHEMA, ("signed", "negate", "low", 1, True, 1.0)))
    overrides = overrides.unionByName(screen.filter(k == 2).select("screen_id", *fields(harmonize.OVERRIDES_SCHEMA, ("broken", "quarantine", "high", 1, None, None))))
    directions = screen.filter(k == 0).select("screen_id", *fields(harmonize.DIRECTIONS_SCHEMA, ("PAIR", None, 2, 1, "high", "auto")))
    directions = directions.unionByName(screen.filter(k == 3).select("screen_id", *fields(harmonize.DIRECTIONS_SCHEMA, ("SINGLE", 1, None, None, "low", "needs_review"))))
    return harmonize.harmonize(scores_, metadata, overrides, directions).select("screen_id", "gene", "harmonized")


# ---- small relational pieces


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
def counts_per_row(spark, d):
    counted = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    return table(spark, d, "customer").select("c_custkey").join(counted, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) DESC NULLS LAST, p_partkey LIMIT 50")
def numeric_order_of_text(spark, d):
    part = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")))
    return part.orderBy(F.col("size").try_cast("int").desc_nulls_last(), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


@query("SELECT l_suppkey AS model, l_linenumber AS gene_id, max(l_quantity) AS value FROM lineitem GROUP BY ALL")
def unpivoted_models(spark, d):
    """All rows; the wide table's columns are line numbers, of which there are seven."""
    wide = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model_id")).pivot("l_linenumber", list(range(1, 8))).agg(F.max("l_quantity"))
    wide = wide.toDF("model_id", *[f"GENE{i} ({i})" for i in range(1, 8)])
    return screen_files.unpivot_models(wide, "model_id").filter("value is not null")


@query("SELECT p_name AS term, adj_p, combined FROM (SELECT p_name, p_size / 1000.0::DOUBLE AS adj_p, p_retailprice AS combined FROM part) WHERE adj_p <= 0.02 ORDER BY combined DESC, p_name LIMIT 15")
def enriched_terms(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("term"), (F.col("p_size") / 1000.0).alias("adj_p"), F.col("p_retailprice").alias("combined"))
    return knowledge.enriched_terms(rows, most_p=0.02)


@query(f"WITH {EDGES}, w AS (SELECT a, b, CASE WHEN support % 2 = 0 THEN -strength ELSE strength END AS rho FROM edges), n AS (SELECT CASE WHEN a = 17 THEN b ELSE a END AS node, rho FROM w WHERE a = 17 OR b = 17) SELECT node, round(rho, 6) AS rho FROM n WHERE node % 2 = 1")
def connected_genes(spark, d):
    signed = edges(spark, d).select("a", "b", F.when(F.col("support") % 2 == 0, -F.col("strength")).otherwise(F.col("strength")).alias("rho"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 2 == 1, "gene").otherwise("screen").alias("kind"))
    return details.connected(signed, nodes, 17, "gene").select("node", r6("rho").alias("rho"))


@query(f"WITH c AS (SELECT p_partkey AS id, (p_partkey * 37 % 199 - 99) / CAST(101.37 AS DOUBLE) AS r, 4 + p_partkey % 60 AS n FROM part) SELECT id, round({P_OF_R.format(r='r', n='n')}, 6) AS p FROM c")
def correlation_p_values(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 199 - 99) / 101.37).alias("r"), (4 + F.col("p_partkey") % 60).cast("double").alias("n"))
    return rows.select("id", F.round(correlation_p("r", "n"), 6).alias("p"))


@query(f"""WITH {CONTROL}, now AS ({_promoted(18)}), own AS (SELECT * FROM now WHERE organism = (SELECT organism FROM versions WHERE version_id = 18)),
target AS (SELECT max(version_id) AS t FROM own WHERE version_id IN (FROM done) AND version_id < (SELECT max(version_id) FROM own WHERE is_current))
SELECT version_id, organism, CASE WHEN organism IN (SELECT organism FROM own) AND t IS NOT NULL THEN version_id = t ELSE is_current END AS is_current FROM now, target""")
def rollback_version(spark, d):
    versions, runs = _control(spark, d)
    organism = versions.filter("version_id = 18").first().organism
    return warehouse.rollback(warehouse.promote(versions, runs, 18), runs, organism)


@query(f"WITH {SCREENS} SELECT domain, count(*) AS n_screens, count(*) >= 25 AS has_power FROM screens GROUP BY domain")
def context_power(spark, d):
    return details.context_power(screens(spark, d), "domain", 25)


@query("""SELECT s_suppkey AS screen_id, source, status, new_domain, domain_changed FROM supplier JOIN (VALUES (1, 'rule', 'auto', 'fitness', true), (2, 'reviewed', 'auto', 'stress', false), (3, 'in review', 'needs_review', 'stress', false), (0, 'rule', 'auto', 'reporter', true)) v(k, source, status, new_domain, domain_changed) ON k = s_suppkey % 4""")
def merged_facets(spark, d):
    """Suppliers as screens, whose facets by rule and review follow from their keys."""
    screen = table(spark, d, "supplier").select(F.col("s_suppkey").alias("screen_id"))
    of = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("screen_id") % 4).cast("int"))
    by_rule = screen.select(
        "screen_id", of("binding", "baseline", "signal", "signal").alias("condition_class"), of("suppressing", "none", "UNRESOLVED", "UNRESOLVED").alias("growth_direction"),
        of("binding", "proliferation", "UNRESOLVED", "UNRESOLVED").alias("readout_type"), of("fitness", "stress", "stress", "stress").alias("current_domain"),
    )
    reviewed = screen.filter("screen_id % 4 in (2, 3)").select("screen_id", of("", "", "suppressing", "promoting").alias("growth_direction"), F.lit("survival").alias("readout_type"), of("", "", "s", "").alias("sign_convention"), of("", "", "auto", "open").alias("status"))
    return knowledge.merge_facets(by_rule, reviewed).select("screen_id", "source", "status", "new_domain", "domain_changed")


@query()
def screen_similarity_without_component(spark, d):
    rows = scored(spark, d).select("screen_id", "gene", "percentile")
    v, su = networks.leading_component(written(networks.centred(rows), "centred"))
    return similarity.screen_similarity(similarity.without_component(rows, v, su), min_overlap=50)


@query(f"WITH {SCORED} SELECT screen_id, percentile, count(*) AS n, count(*) OVER (PARTITION BY screen_id) > 20 AS dealt_anew FROM scored GROUP BY screen_id, percentile")
def shuffled_null(spark, d):
    rows = scored(spark, d).select("screen_id", "gene", "percentile")
    null = networks.shuffled(networks.numbered(rows))
    same = null.join(rows.withColumnRenamed("percentile", "own"), ["screen_id", "gene"]).groupBy("screen_id").agg(F.avg((F.col("own") == F.col("percentile")).cast("int")).alias("same"), F.count_distinct("own").alias("values"))
    judged = same.select("screen_id", ((F.col("same") < 0.3) & (F.col("values") > 20)).alias("dealt_anew"))
    return null.groupBy("screen_id", "percentile").agg(F.count("*").alias("n")).join(judged, "screen_id")


from heddle.queries import builders, files, operations  # noqa: E402, F401  these register their queries too
