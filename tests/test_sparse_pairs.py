"""Pairs of sparse data: cells meet only where they share a member, and come out as of the join and of dense blocks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.operators import pairwise
from heddle.plans import builders, networks


@pytest.fixture
def copies(spark):
    """Cells of five copies of one small table with keys of their own: most pairs of genes share nothing."""
    rng = random.Random(4)
    cells = {(rng.randrange(40), rng.randrange(9)): (rng.uniform(-1, 1), rng.random() < 0.4) for _ in range(220)}
    rows = [(c * 100 + g, c * 10 + s, x, hit) for c in range(5) for (g, s), (x, hit) in cells.items()]
    return spark.createDataFrame(rows, "gene long, screen_id long, percentile double, hit boolean").cache()


def near(rows):
    return sorted(tuple(round(x, 7) + 0.0 if isinstance(x, float) else x for x in r) for r in rows)


def ways(monkeypatch, make):
    """What ``make`` returns by dense blocks, and by shared members in several blocks and batches."""
    monkeypatch.setattr(pairwise, "_SPARSE", 10**9)
    dense = near(make().collect())
    monkeypatch.setattr(pairwise, "_SPARSE", 0)
    monkeypatch.setattr(pairwise, "_BLOCK_PAIRS", 300)
    monkeypatch.setattr(pairwise, "_PAIRS", 50)
    return dense, near(make().collect())


MADE = {
    "moments": lambda df: pairwise.blocked_moments(df, "gene", "screen_id", "percentile"),
    "moments within": lambda df: pairwise.blocked_moments(df.withColumn("odd", F.col("screen_id") % 2), "gene", "screen_id", "percentile", ["odd"]),
    "weighted": lambda df: pairwise.weighted_pearson(df, "gene", "screen_id", "percentile", 3),
    "cohits": lambda df: pairwise.cohit_pairs(df, "gene", "screen_id", "percentile", "hit", 2),
    "anchored": lambda df: pairwise.anchored_correlations(df, "gene", "screen_id", "percentile", "hit", 4),
    "coscreen": lambda df: builders.coscreen_layer(df.filter("hit"), 3),
    "alike": lambda df: networks.similar_profiles(networks.centred(df), 3, 0.1, 2, digits=9),
    "of text": lambda df: pairwise.blocked_moments(df.withColumn("gene", F.concat(F.lit("g"), "gene")), "gene", "screen_id", "percentile"),
}


@pytest.mark.parametrize("name", MADE)
def test_shared_members_give_the_rows_of_dense_blocks(copies, monkeypatch, name):
    dense, sparse = ways(monkeypatch, lambda: MADE[name](copies))
    assert len(dense) > 50 and sparse == dense


def test_cells_meet_only_where_members_are_shared(spark, monkeypatch):
    """Copies that share nothing: the work grows with their number, not its square, and no dense block is packed."""
    monkeypatch.setattr(pairwise, "_BLOCK_PAIRS", 200)
    monkeypatch.setattr(pairwise, "_record", None)
    rng = random.Random(1)
    cells = sorted({(rng.randrange(30), rng.randrange(8)) for _ in range(100)})
    of = lambda n: spark.createDataFrame([(c * 30 + g, c * 8 + s, 1.0) for c in range(n) for g, s in cells], "item long, member long, v double")
    monkeypatch.setattr(pairwise, "_SPARSE", 0)
    met_cells = spark.sparkContext.accumulator(0)

    def finish(held):
        met_cells.add(len(held.left))
        return pd.DataFrame({"n": [len(held.a)]})

    pairs, met = [], []
    for n in (3, 12):
        before = met_cells.value
        found = pairwise.block_pairs(of(n), "item", "member", ["v"], {"n": (pairwise.one, pairwise.one)}, finish, "n long")
        pairs.append(found.agg(F.sum("n")).first()[0])
        met.append(met_cells.value - before)
    assert pairs[1] == 4 * pairs[0] and met[1] == 4 * met[0]


def test_coscreen_auroc_makes_few_rows_for_each_gene(copies, monkeypatch):
    """Equal to ranks of all pairs, of which the tasks send counts only."""
    made, real = [], pairwise.block_pairs

    def spy(*args, **kwargs):
        made.append(real(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(builders, "block_pairs", spy)
    hits = copies.filter("hit").select("gene", "screen_id")
    groups = copies.select("gene", F.nullif((F.col("gene") % 3).cast("int"), F.lit(2)).alias("group")).distinct()
    dense, sparse = ways(monkeypatch, lambda: builders.coscreen_auroc(hits, groups))
    h = hits.toPandas().groupby("gene")["screen_id"].agg(set)
    group = dict(groups.toPandas().itertuples(index=False))
    expected = []
    for a in h.index:
        lifts = [(len(h[a] & h[b]) / (len(h[a]) * len(h[b])) ** 0.5, group[a] == group[b]) for b in h.index if b != a and h[a] & h[b]]
        ins, outs = ([x for x, label in lifts if label is want] for want in (True, False))
        if ins and outs:
            expected.append((a, round(sum((x > y) + 0.5 * (x == y) for x in ins for y in outs) / len(ins) / len(outs), 7)))
    assert len(expected) > 50 and dense == sparse == sorted(expected)
    pairs = sum(bool(h[a] & h[b]) for a in h.index for b in h.index if a != b)
    assert made[0].count() < pairs
