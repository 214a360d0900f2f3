"""Queries of the knowledge base's builders, of back-tests, and of lookups."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from heddle.functions import fixed_values as V
from heddle.functions import rules
from heddle.plans import builders, details, serving
from heddle.queries.bindings import BEST, EDGES, SCORED, SCREENS, best, document_profiles, edges, scored, screens, table
from heddle.queries.registry import query, r6
from heddle.sources import knowledge as sources
from heddle.storage import written


def _genes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"))


@query("""WITH p AS (SELECT o_custkey AS gene_id, 'A' || o_orderkey AS accession, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS function, o_orderstatus AS location, o_orderkey AS place FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part))
SELECT gene_id, accession, function, location FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY length(coalesce(function, '')) DESC, place) AS rn FROM p) WHERE rn = 1""")
def longest_functions(spark, d):
    proteins = table(spark, d, "orders").select(
        F.col("o_custkey").alias("gene_id"), F.concat(F.lit("A"), "o_orderkey").alias("accession"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("function"),
        F.col("o_orderstatus").alias("location"), F.col("o_orderkey").alias("place"),
    )
    return builders.longest_functions(proteins, _genes(spark, d))


@query("""SELECT gene_id, identifier FROM (SELECT l_partkey AS gene_id, 'E' || l_orderkey AS identifier, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem WHERE l_linenumber != 1) WHERE rn = 1""")
def first_identifiers(spark, d):
    name = F.when(F.col("l_linenumber") == 1, "-").otherwise(F.concat(F.lit("E"), "l_orderkey"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_id"), name.alias("identifier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return builders.first_identifiers(rows, _genes(spark, d))


@query("""WITH p AS (SELECT l_partkey AS a, 9606 + l_partkey % 2 AS ta, l_suppkey AS b, 9606 + l_suppkey % 2 AS tb FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 != l_suppkey % 2),
w AS (SELECT a, ta, b, tb FROM p UNION SELECT b, tb, a, ta FROM p) SELECT a AS gene_id, CAST(ta AS INTEGER) AS taxid, b AS ortholog_gene_id, CAST(tb AS INTEGER) AS ortholog_taxid, y.p_name AS ortholog_symbol
FROM w JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b""")
def orthologs(spark, d):
    line = table(spark, d, "lineitem")
    species = lambda c: (F.col(c) % 2 + 9606).cast("int")
    pairs = line.select(
        F.when(F.col("l_returnflag") == "R", "Ortholog").otherwise("Other").alias("relation"), species("l_partkey").alias("taxid_a"), F.col("l_partkey").alias("gene_a"),
        species("l_suppkey").alias("taxid_b"), F.col("l_suppkey").alias("gene_b"),
    )
    return builders.orthologs(pairs, _genes(spark, d), (9607, 9606))


@query("""SELECT gene_id, stable_id, name, url FROM (SELECT o_custkey AS gene_id, o_orderpriority AS stable_id, o_orderstatus AS name, CAST(o_orderkey AS VARCHAR) AS url, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 3 != 0 AND o_custkey IN (SELECT p_partkey FROM part)) WHERE rn = 1""")
def pathway_links(spark, d):
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ENS"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")).alias("gene"), F.col("o_orderpriority").alias("stable_id"),
        F.col("o_orderkey").cast("string").alias("url"), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("name"), F.col("o_orderstatus").alias("species"), F.col("o_orderkey").alias("place"),
    )
    return builders.pathway_links(rows, _genes(spark, d), ["F", "O"])


@query("""WITH h AS (SELECT l_linenumber AS taxid, l_partkey AS gene_id, CAST(l_orderkey AS VARCHAR) AS retired_id, CASE WHEN l_returnflag != 'N' THEN 'S' || l_suppkey END AS retired_symbol FROM lineitem
WHERE l_quantity >= 10 AND l_linenumber IN (1, 2) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20))
SELECT gene_id, taxid, retired_id AS alias, 'discontinued_geneid' AS alias_type FROM h UNION ALL SELECT gene_id, taxid, retired_symbol, 'discontinued_symbol' FROM h WHERE retired_symbol IS NOT NULL""")
def retired_aliases(spark, d):
    replaced = F.when(F.col("l_quantity") < 10, "-").otherwise(F.col("l_partkey").cast("string"))
    symbol = F.when(F.col("l_returnflag") == "N", "-").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    history = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("taxid"), replaced.alias("gene_id"), F.col("l_orderkey").alias("retired_id"), symbol.alias("retired_symbol"))
    known = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("gene_id"))
    return builders.retired_aliases(history, known, [1, 2])


@query("""WITH s AS (SELECT l_partkey AS gene_id, 'paper ' || l_orderkey AS summary, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS rn FROM lineitem WHERE l_linenumber IN (1, 2) AND l_quantity != 1)
SELECT p_partkey AS gene_id, p_name AS symbol, summary FROM part LEFT JOIN (SELECT * FROM s WHERE rn = 1) ON gene_id = p_partkey""")
def gene_summaries(spark, d):
    text = F.when(F.col("l_quantity") == 1, "").otherwise(F.concat(F.lit("paper "), F.col("l_orderkey").cast("string")))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("taxid"), F.col("l_partkey").alias("gene_id"), text.alias("summary"), F.col("l_orderkey").alias("place"))
    return builders.with_summaries(_genes(spark, d), rows, [1, 2]).select("gene_id", "symbol", "summary")


@query("SELECT l_partkey AS gene_id, l_orderkey AS pmid FROM lineitem WHERE l_linenumber IN (1, 2) AND l_partkey IN (SELECT p_partkey FROM part)")
def literature_links(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("taxid"), F.col("l_partkey").alias("gene_id"), F.col("l_orderkey").alias("pmid"))
    return builders.literature_links(rows, _genes(spark, d), [1, 2])


@query("""WITH v AS (SELECT l_partkey AS gene, l_suppkey AS m, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL), mu AS (SELECT gene, avg(v) AS mu FROM v GROUP BY 1), c AS (SELECT v.gene, m, v.v - mu.mu AS x FROM v JOIN mu ON mu.gene = v.gene),
nn AS (SELECT gene, sum(x * x) AS q FROM c GROUP BY 1 HAVING sum(x * x) > 1e-12), dd AS (SELECT p.gene AS a, q.gene AS b, sum(p.x * q.x) AS dot FROM c p JOIN c q ON p.m = q.m AND p.gene != q.gene GROUP BY ALL),
rr AS (SELECT a, b, dot / sqrt(x.q * y.q) AS r FROM dd JOIN nn x ON x.gene = a JOIN nn y ON y.gene = b WHERE a IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT a AS gene, b AS neighbour, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(r, 9) DESC, b) AS rn FROM rr WHERE r >= 0.1) WHERE rn <= 30""")
def model_neighbours(spark, d):
    values = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("model")).agg(F.max("l_extendedprice").alias("value"))
    known = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("gene_id"))
    return builders.model_neighbours(values, known).withColumn("r", r6("r"))


@query(f"WITH {SCORED}, {SCREENS} SELECT screen_id, count(percentile) AS n_genes FROM scored JOIN screens USING (screen_id) WHERE organism = 'ASIA' AND coverage = 'FULL' GROUP BY 1 HAVING count(percentile) >= 100")
def whole_screens(spark, d):
    return builders.whole_screens(scored(spark, d), screens(spark, d), "ASIA", 100)


@query()
def organism_network(spark, d):
    rows = written(document_profiles(spark, d), "profiles")
    early = F.when(F.substring("screen_id", 1, 1) < "n", "early").otherwise("late")
    screens_ = rows.select("screen_id").distinct().select("screen_id", early.alias("organism"), F.lit("FULL").alias("coverage"))
    return builders.organism_network(rows, screens_, "early", 30, min_screens=15)


@query(f"""WITH {EDGES}, way AS (SELECT a, b, strength, reciprocal FROM edges UNION ALL SELECT b, a, strength, reciprocal FROM edges), hv AS (SELECT a, sum(reciprocal) AS have FROM way GROUP BY a),
pl AS (SELECT way.a, way.b, have, row_number() OVER (PARTITION BY way.a ORDER BY round(strength, 9) DESC, way.b DESC) AS rn FROM way JOIN hv ON hv.a = way.a WHERE reciprocal = 0)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pl WHERE rn <= 6 - have""")
def topped_up_edges(spark, d):
    return builders.topped_up(edges(spark, d), 6)


@query(f"""WITH {EDGES}, {BEST}, hits AS (SELECT DISTINCT gene, screen_id FROM best WHERE hit), hn AS (SELECT gene, count(*) AS n FROM hits GROUP BY 1),
co AS (SELECT x.gene, y.gene AS neighbour, count(*) AS c FROM hits x JOIN hits y ON x.screen_id = y.screen_id AND x.gene != y.gene GROUP BY ALL),
cw AS (SELECT co.gene, neighbour, c / sqrt(p.n * q.n) AS weight FROM co JOIN hn p ON p.gene = co.gene JOIN hn q ON q.gene = neighbour),
ew AS (SELECT a AS gene, b AS neighbour, strength AS weight FROM edges UNION ALL SELECT b, a, strength FROM edges),
nb AS (SELECT * EXCLUDE rn FROM (SELECT 'coscreen' AS layer, *, row_number() OVER (PARTITION BY gene ORDER BY round(weight, 9) DESC, neighbour) AS rn FROM cw UNION ALL
  SELECT 'network' AS layer, *, row_number() OVER (PARTITION BY gene ORDER BY round(weight, 9) DESC, neighbour) AS rn FROM ew) WHERE rn <= 10),
tm AS (SELECT p_partkey AS gene, 's' || (p_size % 10) AS term FROM part UNION SELECT p_partkey, p_brand FROM part),
tot AS (SELECT count(DISTINCT term) AS n_terms FROM tm), np AS (SELECT gene, count(*) AS n_pos FROM tm GROUP BY 1),
vt AS (SELECT layer, nb.gene, term, round(sum(weight), 9) AS score FROM nb JOIN tm ON tm.gene = nb.neighbour GROUP BY layer, nb.gene, term),
mk AS (SELECT vt.*, n_pos, CASE WHEN tm.term IS NULL THEN 0 ELSE 1 END AS label FROM vt JOIN np ON np.gene = vt.gene LEFT JOIN tm ON tm.gene = vt.gene AND tm.term = vt.term),
rk AS (SELECT *, rank() OVER (PARTITION BY layer, gene ORDER BY score) + (count(*) OVER (PARTITION BY layer, gene, score) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY layer, gene ORDER BY score DESC, term) AS place FROM mk),
pg AS (SELECT layer, gene, n_pos, sum(label * r) AS rs, sum(label) AS found, count(*) AS n_scored, max(CASE WHEN place <= 5 THEN label ELSE 0 END) AS hit_5, max(CASE WHEN place <= 10 THEN label ELSE 0 END) AS hit_10, max(CASE WHEN place <= 20 THEN label ELSE 0 END) AS hit_20 FROM rk GROUP BY layer, gene, n_pos),
au AS (SELECT *, (rs + found * (n_terms - n_scored) + (n_pos - found) * (n_terms - n_scored + 1) / 2.0 - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n_terms - n_pos)) AS auroc FROM pg, tot WHERE n_pos < n_terms)
SELECT layer, count(*) AS n_genes, round(avg(auroc), 6) AS auroc, round(avg(hit_5), 6) AS hit_5, round(avg(hit_10), 6) AS hit_10, round(avg(hit_20), 6) AS hit_20 FROM au GROUP BY layer""")
def backtest_layers(spark, d):
    part = table(spark, d, "part")
    terms = part.select(F.col("p_partkey").alias("gene"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("term")).union(part.select("p_partkey", "p_brand"))
    e = edges(spark, d).select(F.col("a").alias("gene"), F.col("b").alias("neighbour"), F.col("strength").alias("weight"))
    network = builders.strongest(e.unionByName(e.select(F.col("neighbour").alias("gene"), F.col("gene").alias("neighbour"), "weight")), 10)
    coscreen = builders.coscreen_layer(best(spark, d).filter("hit"), 10)
    layers = [layer.withColumn("layer", F.lit(name)) for name, layer in (("network", network), ("coscreen", coscreen))]
    found = builders.back_test(layers[0].unionByName(layers[1]), terms)
    return found.withColumns({c: r6(c) for c in ("auroc", "hit_5", "hit_10", "hit_20")})


@query()
def backtest_null(spark, d):
    part = table(spark, d, "part")
    terms = part.select(F.col("p_partkey").alias("gene"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("term"))
    coscreen = builders.coscreen_layer(best(spark, d).filter("hit"), 10)
    null = builders.random_layer(coscreen, part.select(F.col("p_partkey").alias("gene")))
    return builders.back_test(null.withColumn("layer", F.lit("null")), terms)


@query(f"""WITH {SCORED}, s AS (SELECT gene, CASE WHEN gene % 7 != 0 THEN percentile END AS percentile FROM scored WHERE screen_id = 3 AND contains(CAST(gene AS VARCHAR), '1'))
SELECT gene, round(percentile, 6) AS percentile, CAST(row_number() OVER (ORDER BY percentile DESC NULLS LAST, gene) AS INTEGER) AS place FROM s""")
def drawer_rows(spark, d):
    rows = scored(spark, d).filter("screen_id = 3").select(F.col("gene").cast("string").alias("symbol"), "gene", F.when(F.col("gene") % 7 != 0, F.col("percentile")).alias("percentile"))
    return serving.drawer_rows(rows, " 1 ", "percentile", False, ["gene"]).select("gene", r6("percentile").alias("percentile"), "place")


@query(f"WITH {SCORED} SELECT gene FROM (SELECT gene FROM scored WHERE screen_id = 3 ORDER BY gene LIMIT 40)")
def drawer_tokens(spark, d):
    rows = scored(spark, d).filter("screen_id = 3").select(F.col("gene").cast("string").alias("symbol"), "gene")
    return serving.drawer_tokens(rows, "", [F.col("gene")]).select("gene")


@query("""SELECT key, answer, CAST(age_days AS INTEGER) AS age_days FROM (SELECT o_custkey AS key, o_orderkey AS answer, date_diff('day', o_orderdate, TIMESTAMP '1996-01-01') AS age_days, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-12-02' AND o_orderdate <= TIMESTAMP '1996-01-01') WHERE rn = 1""")
def cached_answers(spark, d):
    cache = table(spark, d, "orders").select(F.lit("x").alias("source"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("answer"), F.col("o_orderdate").alias("fetched_at"))
    return sources.cached_answers(cache, datetime.datetime(1996, 1, 1), [F.col("answer")]).select("key", "answer", "age_days")


@query(f"""WITH {EDGES}, w AS (SELECT a, b, strength FROM edges UNION ALL SELECT b, a, strength FROM edges), n AS (SELECT b AS node FROM (SELECT b FROM w WHERE a = 17 ORDER BY strength DESC, b LIMIT 12) UNION SELECT 17)
SELECT a, b, round(strength, 6) AS combined_score FROM edges WHERE a IN (FROM n) AND b IN (FROM n)""")
def partner_network(spark, d):
    links = edges(spark, d).select("a", "b", F.col("strength").alias("combined_score"))
    return details.partner_network(links, 17).withColumn("combined_score", r6("combined_score"))


@query(f"""WITH {SCREENS} SELECT screen_id, domain, CASE WHEN condition LIKE '%A%' THEN lower(condition) || ' signaling' ELSE 'level of ' || cell_line END AS process FROM screens WHERE screen_id IN (3, 1, 4, 15, 9, 2)""")
def reporter_screens(spark, d):
    rationale = F.when(F.col("condition").like("%A%"), F.concat(F.lit("Negative regulators of "), F.lower("condition"), F.lit(" signaling"))).otherwise(" ")
    rows = screens(spark, d).withColumn("rationale", rationale).withColumn("phenotype", F.concat(F.lit("level of "), "cell_line"))
    return details.reporter_screens(rows, [3, 1, 4, 15, 9, 2, 6]).select("screen_id", "domain", "process")


@query(f"""SELECT s_suppkey AS screen_id, CASE WHEN s_nationkey % 7 = 0 THEN 'binary_only' WHEN s_suppkey % 3 != 0 AND s_suppkey % 10 / 10.0 >= {V.DIRECTION_CONFIDENCE} THEN 'auto' ELSE 'needs_review' END AS status FROM supplier""")
def override_statuses(spark, d):
    mode = F.when(F.col("s_suppkey") % 3 == 0, "UNDEFINED").when(F.col("s_suppkey") % 3 == 1, "SINGLE").otherwise("PAIR")
    sure = F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey") % 10 / 10.0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("screen_id"), rules.override_status(mode, sure, F.col("s_nationkey") % 7 == 0).alias("status"))


_LABELS = [*V.SCORE_BUCKETS, "no such label"]
_QUOTED = ["'" + x.replace("'", "''") + "'" for x in _LABELS]


@query(
    f"""WITH p AS (SELECT p_partkey, ([{', '.join(_QUOTED)}])[p_partkey % {len(_LABELS)} + 1] AS label FROM part)
SELECT p_partkey, CASE label {' '.join(f"WHEN {q} THEN '{V.SCORE_BUCKETS[x]}'" for q, x in zip(_QUOTED, V.SCORE_BUCKETS))} ELSE 'unknown' END AS bucket FROM p"""
)
def score_buckets(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    return table(spark, d, "part").select("p_partkey", rules.score_bucket(label).alias("bucket"))
