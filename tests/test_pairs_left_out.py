"""Pairs are measured once, and those that can't be among the best are left out before they are worked out in full, without loss."""

import numpy as np
import pytest

from heddle.operators import pairwise
from heddle.plans import networks

from tests.test_networks_at_size import noise


def strengths(of):
    return {(r.a, r.b): (round(r.r, 9), r.support, r["rank"]) for r in of.collect()}


def test_a_network_measures_its_pairs_once(spark, monkeypatch):
    """Best partners meet themselves (who has whom): they are stored before, or each pair would be measured twice."""
    seen, mutual = [], networks.mutual
    monkeypatch.setattr(networks, "mutual", lambda best: seen.append(best._jdf.queryExecution().executedPlan().toString()) or mutual(best))
    networks.coessential_network(noise(spark, 60, 30)[1], min_screens=5, min_support=5).collect()
    assert len(seen) == 2 and not any("MapInPandas" in plan or "CartesianProduct" in plan for plan in seen)


def test_genes_without_the_support_are_in_no_block(spark, monkeypatch):
    rows = [(g, s, float((g * 7 + s * s * (g + 3)) % 11)) for g in range(40) for s in range(12 if g % 4 else 8)]
    df = spark.createDataFrame(rows, "gene long, screen_id long, x double")
    taken, best = [], networks.best_partners
    monkeypatch.setattr(networks, "best_partners", lambda x, *a, **b: taken.append({r.gene for r in x.select("gene").distinct().collect()}) or best(x, *a, **b))
    networks.similar_profiles(df, 3, 0.05, 9, digits=9)
    assert taken == [{g for g in range(40) if g % 4}]


@pytest.mark.parametrize("least", [0, 9])
def test_what_is_left_out_is_not_among_the_best(spark, monkeypatch, least):
    """Blocks of ten, with a gene whose row has length 0 but for rounding without the component, and with ties: the same rows as by all strengths."""
    _, df = noise(spark, 70, 24, seed=5)
    x = networks.centred(df)
    copy = x.filter("gene < 8").selectExpr("gene + 1000 AS gene", "screen_id", "x")
    x = x.unionByName(copy)
    v = networks.leading_components(x)[0]
    x = x.unionByName(v.selectExpr("5000L AS gene", "screen_id", "v[0] * 5 AS x")).unionByName(v.selectExpr("5001L AS gene", "screen_id", "v[0] * 5000000 + CASE WHEN screen_id = 3 THEN 1000 ELSE 0 END AS x"))
    near = lambda: strengths(networks.similar_profiles(x, 4, 0.05, least, v, digits=9, block_items=10))
    some = near()
    best = networks.best_partners
    monkeypatch.setattr(networks, "best_partners", lambda *a, rows, **b: best(*a, **b))
    assert some == near() and len(some) > 150


def test_most_pairs_are_never_worked_out():
    """Of 16 blocks a task works out few strengths, also where it counts common members of all pairs at once."""
    rng = np.random.default_rng(2)
    worked, x = [], rng.normal(size=(16, 50, 40))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    seen = rng.random(x.shape) < 0.6

    def strength(held):
        worked.append(held.ends[0].size if hasattr(held, "ends") else held.a.size * held.b.size)
        return np.array(held.sum("dot"))

    def side(k):
        row, at = np.nonzero(seen[k])
        order = np.argsort(at, kind="stable")
        return pairwise._Side(np.arange(50) + 50 * k, row[order], at[order], [x[k][row, at][order]])

    sums = {"dot": (networks._value, networks._value), "n": (pairwise.present, pairwise.present)}
    whole = np.concatenate(np.where(seen, x, 0))
    for counted in (0, 1 << 16):
        worked.clear()
        pairwise._COUNTED, before = counted, pairwise._COUNTED
        task = pairwise._StrongestSoFar(strength, 3, "n", 9, 0.05, 12, lambda held, s: held.cells(s, networks._value).copy())
        sides = [side(k) for k in range(16)]
        for low in range(16):
            for high in range(low, 16):
                task.add(pairwise.PairBlock((sides[low], sides[high]), 40, sums, {}, low == high, float), low, high)
        pairwise._COUNTED = before
        assert sum(worked) < 0.35 * 800 * 799 / 2
        r = whole @ whole.T
        r[(np.concatenate(seen).astype(int) @ np.concatenate(seen).T < 12) | (r < 0.05)] = -1
        np.fill_diagonal(r, -1)
        found = {}
        for frame in task.rows():
            for a, b, s in zip(frame["a"], frame["b"], frame["r"]):
                found.setdefault(a, []).append((round(s, 9), b))
        for a in range(800):
            order = sorted((-round(r[a, b], 9), b) for b in np.flatnonzero(r[a] > 0))[:3]
            assert sorted(found.get(a, []), key=lambda p: (-p[0], p[1])) == [(-s, b) for s, b in order]
