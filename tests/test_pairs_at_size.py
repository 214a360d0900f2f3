"""Sparse pairs hold little at a time however keys are dealt, co-hits are counted from hits alone, and one screen's answer makes no other pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import pairwise
from heddle.plans import builders, networks, similarity

from .test_sparse_pairs import MADE, near


@pytest.fixture
def mixed(spark):
    """Cells of five copies of one small table whose keys alternate, so that each block shares members with every other one."""
    rng = random.Random(5)
    cells = {(rng.randrange(40), rng.randrange(9)): (rng.uniform(-1, 1), rng.random() < 0.4) for _ in range(220)}
    rows = [(g * 5 + c, s * 5 + c, x, hit) for c in range(5) for (g, s), (x, hit) in cells.items()]
    return spark.createDataFrame(rows, "gene long, screen_id long, percentile double, hit boolean").cache()


@pytest.mark.parametrize("name", [*MADE, "auroc"])
def test_blocks_that_all_share_members_meet_by_ranges(mixed, monkeypatch, name):
    made = MADE | {"auroc": lambda df: builders.coscreen_auroc(df.filter("hit"), df.select("gene", (F.col("gene") % 3).alias("group")).distinct())}
    monkeypatch.setattr(pairwise, "_SPARSE", 10**9)
    dense = near(made[name](mixed).collect())
    for settings in ({"_SENT": 0, "_NEAR": 2}, {"_SENT": 10**9}):
        with monkeypatch.context() as m:
            for k, v in ({"_SPARSE": 0, "_BLOCK_PAIRS": 300} | settings).items():
                m.setattr(pairwise, k, v)
            assert len(dense) > 50 and near(made[name](mixed).collect()) == dense


def test_pairs_of_cells_come_some_at_a_time(monkeypatch):
    """As many as ``_PAIRS`` and one item's more; all of an item's are together."""
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, [200, 30], (3000, 2)), axis=0)
    found = pairwise._Cells.packed(cells[:, 0], cells[:, 1], [np.ones(len(cells))], {"n": pairwise.one})
    block = pairwise._Cells(*(found[c][0] for c in ("items", "members", "places", "data")), 1, ["n"])
    monkeypatch.setattr(pairwise, "_PAIRS", 4000)
    sums = {"n": (pairwise.one, pairwise.one)}
    held = [(np.unique(h.a), len(h.left), h.sum("n").sum()) for h in pairwise._cell_pairs(block, block, sums, True)]
    most = max(np.isin(cells[:, 1], cells[cells[:, 0] == i, 1]).sum() for i in range(200))
    assert len(held) > 5 and max(n for _, n, _ in held) <= 4000 + most
    assert sum(len(a) for a, _, _ in held) == len(np.unique(np.concatenate([a for a, _, _ in held])))
    shared = (np.eye(200)[cells[:, 0]].T @ np.eye(30)[cells[:, 1]] > 0).astype(int)
    assert sum(n for _, _, n in held) == (shared @ shared.T).sum() - len(cells)
    assert sum(h.sum("n").sum() for h in pairwise._cell_pairs(block, block, sums, False)) == ((shared @ shared.T).sum() - len(cells)) / 2


def test_cohits_are_counted_from_hits_alone(mixed, monkeypatch):
    given, real = [], pairwise.block_pairs

    def spy(values, *args, **kwargs):
        given.append(values)
        return real(values, *args, **kwargs)

    every = near(pairwise.cohit_pairs(mixed, "gene", "screen_id", "percentile", "hit", 2).collect())
    monkeypatch.setattr(pairwise, "block_pairs", spy)
    monkeypatch.setattr(pairwise, "_FEW_PAIRS", 10**6)
    joined = near(pairwise.cohit_pairs(mixed, "gene", "screen_id", "percentile", "hit", 2).collect())
    monkeypatch.setattr(pairwise, "_FEW_PAIRS", 0)
    planes = near(pairwise.cohit_pairs(mixed, "gene", "screen_id", "percentile", "hit", 2).collect())
    assert len(every) > 50 and every == joined == planes
    assert given[0].count() == mixed.filter("hit").count() < given[2].count() == mixed.count()


def test_one_screens_similarity_makes_no_other_pairs(mixed, monkeypatch):
    pairs = similarity.screen_similarity(mixed, 3).filter("screen_a = 7")
    every = near(pairs.select("screen_b", "r", "overlap").collect())
    monkeypatch.setattr(similarity, "blocked_moments", None)
    found = near(similarity.screen_similarity_of(mixed, 7, 3).select("screen_b", "r", "overlap").collect())
    assert len(every) > 3 and found == every


def test_best_of_sparse_pairs_leave_a_block_once(mixed, monkeypatch):
    """A gene's partners in several blocks make ``k`` rows, not ``k`` for each block."""
    made, real = [], pairwise.block_pairs

    def spy(*args, **kwargs):
        made.append(real(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(pairwise, "block_pairs", spy)
    for k, v in {"_SPARSE": 0, "_BLOCK_PAIRS": 300, "_SENT": 10**9}.items():
        monkeypatch.setattr(pairwise, k, v)
    best = networks.similar_profiles(networks.centred(mixed), 3, 0.01, digits=9)
    assert made[0].count() == best.count() > 100
