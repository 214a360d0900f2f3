"""Networks of many genes over few screens: what is written does not grow with the square of the genes, and noise needs no rounds."""

import math
import random

import numpy as np

from heddle.operators import pairwise
from heddle.plans import networks


def noise(spark, genes, screens, seed=3):
    rng = random.Random(seed)
    rows = [(g, s, rng.uniform(-1, 1), rng.random() < 0.3) for g in range(genes) for s in range(screens) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "gene long, screen_id long, percentile double, hit boolean")


def test_components_of_few_screens_need_no_rounds(spark, monkeypatch):
    rows, df = noise(spark, 50, 20)
    x = networks.centred(df)
    monkeypatch.setattr(networks, "GRAM_CELLS", 200)
    with monkeypatch.context() as few:
        few.setattr(networks, "MOST_ROUNDS", 0)
        v, su = networks.leading_components(x, 2)
        whole, along = {r.screen_id: r.v for r in v.collect()}, {r.gene: r.su for r in su.collect()}
    monkeypatch.setattr(networks, "WHOLE_SCREENS", 0)
    rounds = {r.screen_id: r.v for r in networks.leading_components(x, 2)[0].collect()}
    table = np.full((50, 20), np.nan)
    for g, s, p, _ in rows:
        table[g, s] = p
    filled = np.nan_to_num(table - np.nanmean(table, 1, keepdims=True))
    for c in range(2):
        assert abs(abs(sum(whole[s][c] * rounds[s][c] for s in whole)) - 1) < 1e-6
        assert max(abs(along[g][c] - filled[g] @ [whole[s][c] for s in range(20)]) for g in along) < 1e-9


def test_records_are_not_written_once_for_each_other_block(spark):
    """Twelve blocks: each record goes through one exchange, not through twelve."""
    _, df = noise(spark, 48, 20)
    found = networks.similar_profiles(networks.centred(df), 3, 0.05, digits=9, block_items=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan.lower()
    assert found.count() > 100


def test_partners_reach_the_best_so_far_of_a_task():
    """Partners that come later than the first k replace them only where they are better; ties go to the smaller partner."""
    held = pairwise._FirstSoFar(np.array([7, 9]), 2, -0.1)
    held.add(np.array([0, 0, 1]), [np.array([-0.5, -0.2, -0.3]), np.array([4, 5, 4])], [np.array([1, 2, 3])])
    held.add(np.array([0, 0]), [np.array([-0.5, -0.4]), np.array([3, 2])], [np.array([4, 5])])
    items, (key, partner), (other,) = held.rows()
    assert [*zip(items.tolist(), key.tolist(), partner.tolist(), other.tolist())] == [(7, -0.5, 3, 4), (7, -0.5, 4, 1), (9, -0.3, 4, 3)]
    assert held.bound.tolist() == [-0.5, -0.1]


def test_cohit_network_by_many_blocks_and_its_rows(spark, monkeypatch):
    """Dense blocks, shared members and slices give the network of a plain count of all pairs; no pair of genes is a row but those that pass."""
    rng = random.Random(8)
    groups = [{s for s in range(60) if rng.random() < 0.3} for _ in range(6)]
    rows = []
    for g in range(60):
        for s in range(60):
            if rng.random() < 0.9:
                rows.append((g, s, rng.uniform(-1, 1), rng.random() < (0.85 if g < 30 and s in groups[g % 6] else 0.1)))
    rows += [(90, 99, 0.5, False), (91, 98, 0.5, True)]
    df = spark.createDataFrame(rows, "gene long, screen_id long, percentile double, hit boolean").cache()
    seen, up = {}, {}
    for g, s, p, h in rows:
        seen.setdefault(g, {})[s] = h
        up[g, s] = p > 0
    p, tested = {}, 0
    for a in seen:
        for b in seen:
            both = seen[a].keys() & seen[b].keys()
            tested += bool(both)
            x, r, k = (sum(seen[c][s] and seen[d][s] for s in both) for c, d in ((a, b), (a, a), (b, b)))
            if a != b and x >= 3:
                n = len(both)
                p[a, b] = sum(math.comb(r, i) * math.comb(n - r, k - i) for i in range(x, min(r, k) + 1)) / math.comb(n, k), x
    order = sorted(v for v, _ in p.values())
    limit = max((v for n, v in enumerate(order, 1) if v <= 0.05 * n / tested * (1 + 1e-9)), default=0) * (1 + 1e-9)
    tops = {(a, b) for a in seen for b in sorted((b for c, b in p if c == a), key=lambda b: (round(p[a, b][0], 12), -p[a, b][1], b))[:4] if p[a, b][0] <= limit}
    want = {(min(e), max(e)) for e in tops}
    assert 20 < len(want) < len(p) / 4

    made, real = [], pairwise.block_pairs
    for way, sizes in (("_SPARSE", {}), (None, {"block_items": 7}), (None, {"block_items": 20, "task_cells": 300})):
        with monkeypatch.context() as m:
            if way:
                m.setattr(pairwise, way, 0)
                m.setattr(pairwise, "_BLOCK_PAIRS", 300)
                m.setattr(pairwise, "_PAIRS", 50)
            m.setattr(pairwise, "block_pairs", lambda *args, sizes=sizes, **more: made.append(real(*args, **(more | sizes))) or made[-1])
            got = networks.cohit_network(df, k=4).collect()
        assert {(e.a, e.b) for e in got} == want, (way, sizes)
        for e in got:
            first, second = ([up[g, s] for s in sorted(seen[e.a].keys() & seen[e.b].keys()) if seen[e.a][s] and seen[e.b][s]] for g in (e.a, e.b))
            assert e.concordance == round(sum(x == y for x, y in zip(first, second)) / e.cohit, 3) and e.cohit == len(first)
            assert math.isclose(e.q_ref, min(1, e.p * tested / len(p)), rel_tol=1e-9) and e.q_bh <= 0.05 + 1e-9
            assert e.reciprocal == ((e.a, e.b) in tops and (e.b, e.a) in tops)
            assert e.support == len(seen[e.a].keys() & seen[e.b].keys())
    assert all(df.filter("what = 3").count() < len(p) / 2 for df in made)
