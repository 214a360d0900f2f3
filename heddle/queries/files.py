"""Queries of readers and writers: tables are written as the files that a reader takes, in the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heddle.operators import upsert
from heddle.queries.bindings import table
from heddle.queries.registry import query
from heddle.sources import knowledge, screens, sinks
from heddle.storage import shared_dir

PART_ROWS = 200_000  # of a part of a screen file


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT 1 AS version_id, l_suppkey AS screen_id, CASE WHEN l_partkey % 97 != 5 THEN l_partkey END AS identifier_id, p_name AS gene_symbol, l_returnflag = 'R' AS hit_flag, CASE WHEN l_linenumber != 7 THEN l_extendedprice END AS score_1,
l_discount AS score_2, CAST(l_orderkey * 10 + l_linenumber AS DOUBLE) AS score_3, row_number FROM (SELECT *, 1 + row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_number FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE l_suppkey % 50 != 7""")
def deposited_screens(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = ["file", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    parts = min(max(7, table(spark, d, "lineitem").count() // PART_ROWS), 90_000)  # parts are read in the order of their names, with five digits
    in_files = joined.withColumn("file", F.col("l_suppkey") % 7).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    text = in_files.select(
        F.when(F.col("l_suppkey") % 50 != 7, F.col("l_suppkey").cast("string")), F.when(F.col("l_partkey") % 97 == 5, "-").otherwise(F.col("l_partkey").cast("string")), "p_name",
        F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_extendedprice").cast("string")), F.col("l_discount").cast("string"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("NO"), "file",
    ).toDF("SCREEN_ID", "IDENTIFIER_ID", "Official_Symbol", "SCORE.1", "SCORE.2", "SCORE.3", "HIT", "file")
    path = _folder(spark, "SCREEN_12")
    text.write.partitionBy("file").csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")
    staged = screens.staged(screens.read_tab_files(spark, path, in_parts=True), 1)
    return staged.select("version_id", "screen_id", "identifier_id", "gene_symbol", "hit_flag", "score_1", "score_2", "score_3", "row_number")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS screen_id, s_name AS notes, CAST(s_nationkey AS VARCHAR) AS source FROM supplier")
def metadata_files(spark, d):
    key = F.col("s_suppkey").cast("string")
    record = F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, key).alias("SCREEN_ID"), F.col("s_name").alias("NOTES"), F.col("s_nationkey").cast("string").alias("SOURCE")))
    entry = F.concat(F.lit('"'), key, F.lit('": '), F.when(F.col("s_suppkey") % 3 == 0, record).otherwise(F.concat(F.lit("["), record, F.lit("]"))))
    files = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).alias("file")).agg(F.concat_ws(",\n", F.collect_list(entry)).alias("entries"))
    path = _folder(spark, "metadata")
    files.select("file", F.concat(F.lit("{"), "entries", F.lit("}")).alias("value")).write.partitionBy("file").text(path)
    found = screens.read_metadata(spark, path)
    return found.select("screen_id", F.col("fields")["NOTES"].alias("notes"), F.col("fields")["SOURCE"].alias("source"))


@query("SELECT CAST(p_size % 2 AS VARCHAR) AS taxid, CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS symbol, CASE WHEN p_size % 5 != 0 THEN p_brand END AS alias FROM part")
def gene_files(spark, d):
    part = table(spark, d, "part")
    lines = part.select(F.concat_ws("\t", F.col("p_size") % 2, "p_partkey", "p_name", F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.col("p_brand")), F.lit("x")).alias("value"))
    header = spark.createDataFrame([("#tax_id\tGeneID\tSymbol\tSynonyms\tother",)], "value string")
    path = _folder(spark, "genes")
    header.unionByName(lines).write.text(path, compression="gzip")
    return knowledge.read_positions(spark, path, {"taxid": 0, "gene_id": 1, "symbol": 2, "alias": 3})


@query("""SELECT 'T:' || p_partkey AS term, p_name AS name, p_brand AS namespace, p_type AS definition, p_partkey % 11 = 0 AS is_obsolete, CASE WHEN p_partkey > 1 THEN 'T:' || (p_partkey // 2) END AS parent FROM part""")
def ontology_files(spark, d):
    k = F.col("p_partkey")
    lines = F.concat_ws(
        "\n", F.lit("[Term]"), F.concat(F.lit("id: T:"), k), F.concat(F.lit("name: "), "p_name"), F.concat(F.lit("namespace: "), "p_brand"), F.concat(F.lit('def: "'), "p_type", F.lit('" [x:1]')),
        F.when(k > 1, F.concat(F.lit("is_a: T:"), F.floor(k / 2), F.lit(" ! parent"))), F.when(k % 11 == 0, "is_obsolete: true"), F.lit("\n[Typedef]\nid: part_of\n"),
    )
    path = _folder(spark, "ontology")
    table(spark, d, "part").select(lines.alias("value")).write.text(path)
    terms, parents = knowledge.read_ontology(spark, path)
    return terms.join(parents, "term", "left")


@query("SELECT 'P' || l_partkey AS a, 'P' || l_suppkey AS b, CAST(l_quantity * 20 AS INTEGER) AS combined_score FROM lineitem")
def link_files(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select(F.concat(F.lit("P"), "l_partkey").alias("protein1"), F.concat(F.lit("P"), "l_suppkey").alias("protein2"), (F.col("l_quantity") * 20).cast("int").alias("combined_score"))
    path = _folder(spark, "links")
    rows.write.csv(path, sep=" ", header=True)
    return knowledge.read_links(spark, path, ["a", "b", "combined_score"])


@query("SELECT CAST(p_partkey // 7 AS VARCHAR) AS complex_id, 'G' || p_partkey AS gene FROM part QUALIFY count(*) OVER (PARTITION BY p_partkey // 7) BETWEEN 3 AND 60")
def complex_files(spark, d):
    part = table(spark, d, "part")
    grouped = part.groupBy(F.floor(F.col("p_partkey") / 7).alias("complex_id")).agg(F.collect_list(F.concat(F.lit(" g"), "p_partkey")).alias("genes"))
    mark = F.when(F.col("complex_id") % 2 == 0, ";").otherwise(",")
    rows = grouped.select("complex_id", F.lit('a "note" with a\ttab and\na second line').alias("comment"), F.concat_ws("", F.array_join("genes", "|"), F.lit("")).alias("listed"), mark.alias("mark"))
    rows = rows.select("complex_id", "comment", F.replace("listed", F.lit("|"), F.col("mark")).alias("subunits_gene_name"))
    path = _folder(spark, "complexes")
    rows.write.csv(path, sep="\t", header=True, quote='"', escape='"', quoteAll=True)
    return knowledge.read_complexes(spark, path)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 != 0 THEN n_name END AS n_name, n_regionkey FROM nation")
def pipe_text(spark, d):
    path = _folder(spark, "bulk")
    sinks.write_pipe_text(table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("n_name"), "n_regionkey"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path, sep="|")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal < 0")
def review_queue(spark, d):
    path = _folder(spark, "queue")
    sinks.write_csv(table(spark, d, "supplier").filter("s_acctbal < 0").select("s_suppkey", "s_name", "s_nationkey"), path)
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey int").csv(path, header=True)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def frozen_artifact(spark, d):
    path = _folder(spark, "artifact")
    sinks.write_artifact(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey", path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,struct<name:string>>")).alias("key", "record")).select("key", "record.name")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def replaced_partitions(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    path = _folder(spark, "orders")
    upsert.replace_partitions(orders, path, ["status"])
    upsert.replace_partitions(orders.filter("status = 'F'").withColumn("o_totalprice", -F.col("o_totalprice")), path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey % 8 AS k, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1")
def resumed_batches(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("k"), "o_orderkey")
    path = _folder(spark, "batches-of")
    upsert.append_batches(orders.filter("k < 3"), path, "k", 3)
    upsert.append_batches(orders, path, "k", 3)
    return spark.read.parquet(path).groupBy("k").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT count(*) AS n, min(n_nationkey) AS first FROM nation WHERE n_nationkey % 6 != 0 GROUP BY n_regionkey HAVING count(*) > 1")
def duplicate_files(spark, d):
    path = _folder(spark, "copies")
    text = F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("own "), "n_nationkey")).otherwise(F.concat(F.lit("region "), "n_regionkey"))
    table(spark, d, "nation").select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(path)
    found = upsert.duplicate_files(spark.read.format("binaryFile").load(path))
    keys = F.transform("paths", lambda p: F.regexp_extract(p, r"n_nationkey=(\d+)", 1).cast("int"))
    return found.select(F.size("paths").cast("long").alias("n"), F.array_min(keys).alias("first"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 != 0), n AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upserted_buckets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    path = _folder(spark, "buckets")
    upsert.write_buckets(o.filter("k % 3 != 0"), path, ["k"], 16)
    upsert.upsert_buckets(o.filter("k % 2 = 0").withColumn("v", -F.col("v")), path, ["k"], 16)
    return spark.read.parquet(path).select("k", "v")
