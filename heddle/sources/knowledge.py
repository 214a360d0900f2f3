"""Readers of public knowledge files: gene tables, ontologies, links and complexes, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.windows import first_per_key


def read_positions(spark: SparkSession, path: str, columns: dict[str, int], sep: str = "\t", header: bool = True) -> DataFrame:
    """Text columns of a delimited file by their positions (from 0); ``-`` and nothing are null.

    With ``header``, lines that start with ``#`` or repeat the first name are left out.
    """
    cells = F.split("value", sep, -1)
    lines = spark.read.text(path)
    rows = lines.filter(F.trim("value") != "")
    if header:
        rows = rows.filter(~F.col("value").startswith("#"))
    clean = lambda i: F.nullif(F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("-")), F.lit(""))
    return rows.select(*[clean(i).alias(name) for name, i in columns.items()])


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (term, name, namespace, definition, is_obsolete) and parents (term, parent) of an OBO file.

    The file is read by stanza: records are separated by the bracket that opens one. Only ``[Term]`` counts.
    """
    stanzas = spark.read.text(path, lineSep="\n[").filter(F.col("value").rlike(r"^\[?Term\]"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{name}: (.*)$", 1)), F.lit(""))
    terms = stanzas.select(
        tag("id").alias("term"), tag("name").alias("name"), tag("namespace").alias("namespace"),
        F.nullif(F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"), F.coalesce(tag("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
    ).filter("term is not null")
    found = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)))
    parents = stanzas.select(tag("id").alias("term"), found.alias("parent")).filter("term is not null")
    return terms, parents


def read_links(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A space-separated file of links with a header: the first two columns as text, all others as numbers."""
    rows = spark.read.csv(path, sep=" ", header=True)
    return rows.toDF(*names).select(*[F.col(n) if i < 2 else F.col(n).try_cast("int").alias(n) for i, n in enumerate(names)])


def read_complexes(spark: SparkSession, path: str, least: int = 3, most: int = 60) -> DataFrame:
    """Rows (complex_id, gene) of a quoted tab-separated table whose subunits are split at ``;`` or ``,``; by size."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    genes = F.array_distinct(F.filter(F.transform(F.split("subunits_gene_name", "[;,]"), lambda g: F.upper(F.trim(g))), lambda g: g != ""))
    sized = rows.select("complex_id", genes.alias("genes")).filter(F.size("genes").between(least, most))
    return sized.select("complex_id", F.explode("genes").alias("gene"))


def fresh(cache: DataFrame, now, days: int = 30) -> DataFrame:
    """Cached answers of external sources (column fetched_at) that are no older than ``days``."""
    return cache.filter(F.col("fetched_at") >= F.lit(now) - F.expr(f"interval {days} days"))


def cached_answers(cache: DataFrame, now, ties: list, days: int = 30) -> DataFrame:
    """Per source and key the latest answer that is no older than ``days`` at the time ``now``, with its age_days.

    ``cache``: source, key, fetched_at and whatever was answered; it stands for the external source.
    """
    known = fresh(cache, now, days).filter(F.col("fetched_at") <= F.lit(now))
    latest = first_per_key(known, ["source", "key"], [F.desc("fetched_at"), *ties])
    return latest.withColumn("age_days", F.datediff(F.lit(now).cast("date"), F.col("fetched_at").cast("date")))
