"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import written


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Columns node and component (its smallest node) for every node of ``edges`` (columns a, b; longs).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay as they are; each
    round is written to the shared folder. A hub's edges are never gathered: minima are aggregated
    before the shuffle, and joins with them have one row per node on one side. Rows with a null end don't count.
    """
    given = edges.filter("a is not null and b is not null")
    pairs = written(given.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    while (now := _checksum(pairs)) != before:
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        # every larger neighbour of a node is tied to the smallest of the node and its neighbours
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # every node and its smaller neighbours are tied to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        tied = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        pairs = written(tied.filter("a != b").distinct(), tag)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _checksum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
