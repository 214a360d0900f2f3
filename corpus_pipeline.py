"""From raw documents to token ids: the stages of a training-data pipeline.

Every stage takes the documents that its predecessor kept and returns a DataFrame, which is written as
Parquet in the shared folder and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_rules
from heddle.llm.common import pick, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own(docs: DataFrame) -> DataFrame:
    """The columns of documents, by their places: others may have the same names in other cases."""
    return pick(docs, **{c: c for c in COLUMNS})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the band of their language or script."""
    return quality_rules.keep_documents(own(docs), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of three lines that occurred before; n_chars follows the text."""
    kept = line_dedup.remove_repeated_lines(own(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near duplicates; documents without an id all stay."""
    return ngram_join.one_of_each(own(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, dealt to the sources by their weights; every document is taken at most once."""
    weights = spark.createDataFrame(mixing.OP6_WEIGHTS, mixing.WEIGHTS_SCHEMA)
    return mixing.mix(own(docs), weights, share=0.9, epochs=1).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the bytes that they decode to."""
    encoded = byte_bpe.encode(own(docs), decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: Fertility, the similarity join and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
