"""Undirected graphs as edge tables with one row per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.fixed_values import TIER_LABELS
from heddle.functions.rules import edge_tier
from heddle.operators.windows import first_per_key


def canonical(edges: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """Edges with a < b, one per pair: the first in ``order``. Loops go."""
    turned = edges.filter(F.col(a) != F.col(b)).withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    return first_per_key(turned, [a, b], order)


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every edge in both directions, so that a neighbourhood is an equality on ``a`` rather than an OR."""
    others = [c for c in edges.columns if c not in (a, b)]
    turned = edges.select(F.col(b).alias(a), F.col(a).alias(b), *others)
    return edges.select(a, b, *others).unionByName(turned)


def induced(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges between ``nodes`` (column node)."""
    return edges.join(nodes.select(F.col("node").alias(a)), a, "left_semi").join(nodes.select(F.col("node").alias(b)), b, "left_semi")


def neighbourhood(edges: DataFrame, seed: object, top: int = 18, reciprocal_only: bool = True) -> DataFrame:
    """The seed and its ``top`` strongest partners (columns node, strength). Mutual-best partners only, unless it has none."""
    partners = both_ways(edges).filter(F.col("a") == seed)
    if reciprocal_only:
        best = partners.groupBy("a").agg(F.max("reciprocal").alias("any_mutual"))
        partners = partners.join(F.broadcast(best), "a").filter((F.col("reciprocal") == 1) | (F.col("any_mutual") == 0))
    ranked = partners.orderBy(F.desc("strength"), "b").limit(top).select(F.col("b").alias("node"), "strength")
    itself = partners.select(F.col("a").alias("node"), F.lit(None).cast("double").alias("strength")).distinct()
    return itself.unionByName(ranked)


def _wedges(way: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows a, b, far, c: of each pair the neighbours c of the end with fewer of them, and the other end. ``way``: a, b, both directions.

    Of pairs that are edges there are no more rows than edges to the power 3/2: a hub is never the end that is opened, but for another hub.
    """
    size = way.groupBy("a").agg(F.count("*").alias("n"))
    sized = pairs.join(size.withColumnRenamed("n", "na"), "a", "left").join(size.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b", "left")
    fewer = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    turned = sized.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("near"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("far"))
    return turned.join(way.select(F.col("a").alias("near"), F.col("b").alias("c")), "near").filter("c != far").select("a", "b", "far", "c")


def neighbourhood_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the Jaccard similarity of their neighbours in all ``edges``, both ends left out; loops are no edges.

    0 where nobody else is a neighbour; to three digits. The neighbours of the end with fewer are looked up among the other's; how many
    each has in all follows from its degree.
    """
    own = pairs.select("a", "b").distinct()
    way = both_ways(edges.select("a", "b")).filter("a != b").distinct()
    met = way.select(F.col("a").alias("far"), F.col("b").alias("c"))
    common = _wedges(way, own).join(met, ["far", "c"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("common"))
    size = way.groupBy("a").agg(F.count("*").alias("na"))
    linked = way.withColumn("linked", F.lit(1))
    joined = pairs.join(size, "a", "left").join(size.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b", "left")
    joined = joined.join(linked, ["a", "b"], "left").join(common, ["a", "b"], "left")
    c, na, nb, one = (F.coalesce(x, F.lit(0)) for x in ("common", "na", "nb", "linked"))
    similar = F.coalesce(F.round(F.try_divide(c, na + nb - 2 * one - c), 3), F.lit(0.0))
    return joined.select(*pairs.columns, similar.alias("jaccard"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_tiers(edges: DataFrame, cohits: DataFrame) -> DataFrame:
    """Edges with has_cohit, tier and tier_label; ``cohits`` has a row (a, b) with a < b for each co-hit pair."""
    known = cohits.select("a", "b").distinct().withColumn("has_cohit", F.lit(True))
    labels = F.create_map(*[x for k, v in TIER_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return (
        edges.join(known, ["a", "b"], "left")
        .withColumn("has_cohit", F.coalesce("has_cohit", F.lit(False)))
        .withColumn("tier", edge_tier(F.col("reciprocal") == 1, F.col("has_cohit")))
        .withColumn("tier_label", labels[F.col("tier")])
    )


def tier_histogram(edges: DataFrame) -> DataFrame:
    """Edges per tier, 1 to 4, with zeros."""
    every = edges.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("tier"))
    counts = edges.groupBy("tier").agg(F.count("*").alias("n"))
    return every.join(counts, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def context_summary(edges: DataFrame) -> DataFrame:
    """Per context: edges, mutual-best edges, and nodes."""
    nodes = edges.select("context", F.explode(F.array("a", "b")).alias("node")).groupBy("context").agg(F.count_distinct("node").alias("n_nodes"))
    counts = edges.groupBy("context").agg(F.count("*").alias("n_edges"), F.sum("reciprocal").alias("n_reciprocal"))
    return counts.join(nodes, "context")
