import pytest
from pyspark.sql import functions as F

from heddle.plans import builders, serving
from heddle.storage import shared_dir


def test_back_test_against_all_terms(spark):
    """AUROC over every term, scored or not, as it is computed pair by pair."""
    neighbours = {1: {2: 0.9, 3: 0.4}, 2: {1: 0.5, 4: 0.5}, 3: {4: 1.0}, 5: {9: 1.0}}
    terms = {1: {"a", "b"}, 2: {"a", "c"}, 3: {"b", "c", "d"}, 4: {"d"}, 5: {"e"}, 6: {"a", "b", "c", "d", "e"}}
    every = sorted(set().union(*terms.values()))
    areas, hits = [], []
    for gene, own in neighbours.items():
        score = {t: sum(w for n, w in own.items() if t in terms.get(n, ())) for t in every}
        if not any(score.values()):
            continue
        yes, no = ([score[t] for t in every if (t in terms[gene]) == wanted] for wanted in (True, False))
        areas.append(sum((y > n) + 0.5 * (y == n) for y in yes for n in no) / (len(yes) * len(no)))
        ranked = sorted((t for t in every if score[t]), key=lambda t: (-round(score[t], 9), t))
        hits.append(bool(set(ranked[:1]) & terms[gene]))
    layer = spark.createDataFrame([("x", g, n, w) for g, own in neighbours.items() for n, w in own.items()], "layer string, gene long, neighbour long, weight double")
    given = spark.createDataFrame([(g, t) for g, own in terms.items() for t in own], "gene long, term string")
    (got,) = builders.back_test(layer, given, ks=(1,)).collect()
    assert (got.layer, got.n_genes) == ("x", len(areas))
    assert got.auroc == pytest.approx(sum(areas) / len(areas)) and got.hit_1 == pytest.approx(sum(hits) / len(hits))


def test_random_layer_is_reproducible_and_far_from_its_layer(spark):
    genes = spark.range(1, 400).select(F.col("id").alias("gene"))
    layer = spark.createDataFrame([(g, (g * k) % 399 + 1, 1.0) for g in range(1, 400) for k in (2, 3, 5)], "gene long, neighbour long, weight double")
    rows = lambda seed: sorted(map(tuple, builders.random_layer(layer, genes, seed).collect()))
    assert rows(1) == rows(1) != rows(2)
    same = {(a, b) for a, b, _ in rows(1)} & {(r.gene, r.neighbour) for r in layer.collect()}
    assert len(same) < 30 and len(rows(1)) > 1150


def test_drawer(spark):
    rows = spark.createDataFrame([("Abc1", 0.5), ("xab", None), ("b", -1.0)] + [(f"g{i}", 0.0) for i in range(60)], "symbol string, value double")
    place = lambda up: [r.symbol for r in serving.drawer_rows(rows, " AB ", "value", up, ["symbol"]).orderBy("place").collect()]
    assert place(True) == ["xab", "Abc1"] and place(False) == ["Abc1", "xab"]
    assert serving.drawer_tokens(rows, "", [F.col("symbol")]).count() == 40
    assert serving.drawer_tokens(rows, "g", [F.col("symbol")]).count() == 60
    assert serving.drawer_tokens(rows, "", [F.col("symbol")], show_all=True).count() == 63


class Cluster:
    """A session whose settings name no shared folder, on a cluster."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(Cluster)
