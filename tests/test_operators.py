import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import graph, pairwise, upsert, windows


def test_signed_percentile_and_ties(spark):
    rows = [("a", x) for x in (1.0, 2.0, 2.0, 3.0)] + [("b", x) for x in (1.0, 2.0, 3.0, 3.0)] + [("c", 5.0), ("d", None), ("d", 1.0), ("d", 2.0)]
    got = windows.add_signed_percentile(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")
    by = lambda g: sorted((r.percentile for r in got.collect() if r.g == g), key=lambda v: (v is not None, v or 0))
    assert by("a") == [-1, 0, 0, 1]
    assert by("b") == pytest.approx([-1, -0.2, 1, 1])
    assert by("c") == [None] and by("d") == [None, -1, 1]


def test_robust_z_falls_back(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0), ("b", 1.0), ("b", 1.0), ("b", 5.0), ("c", 3.0), ("c", 3.0), ("c", None)]
    got = windows.add_robust_z(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()
    z = {(r.g, r.x): r.robust_z for r in got}
    assert z["a", 4.0] == pytest.approx(2 / 1.4826) and z["b", 5.0] == pytest.approx(4 / 2) and z["c", 3.0] is None and z["c", None] is None


def test_best_and_last(spark):
    df = spark.createDataFrame([(1, False, 9.0, 1), (1, True, 2.0, 2), (1, True, 3.0, 3), (2, False, None, 4), (2, False, 1.0, 5)], "k int, hit boolean, s double, n int")
    assert sorted(r.n for r in windows.best_observation(df, ["k"], "hit", "s", ["n"]).collect()) == [3, 5]
    assert sorted(r.n for r in upsert.insert_last(df, ["k"], [F.desc("n")]).collect()) == [3, 5]


def test_reciprocal_and_histogram(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a int, b int")
    assert {(r.a, r.b): r.reciprocal for r in windows.add_reciprocal(df, "a", "b").collect()} == {(1, 2): 1, (2, 1): 1, (1, 3): 0}
    values = spark.createDataFrame([(-1.0,), (1.0,), (0.0,), (1.5,)], "x double")
    counts = {r.bin: r.n for r in windows.histogram(values, "x", -1.0, 1.0, 4, []).collect()}
    assert counts == {1: 1, 2: 0, 3: 1, 4: 1}


def test_bh_and_sweep(spark):
    ps = [0.001, 0.012, 0.02, 0.04, 0.9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert windows.bh_threshold(df, "p", 5, 0.05).first().threshold == 0.04
    assert windows.bh_threshold(df.limit(0), "p", 5, 0.05).first().threshold == 0.0
    real = spark.createDataFrame([(x,) for x in (0.2, 0.3, 0.4, 0.5, 0.6)], "r double")
    null = spark.createDataFrame([(x,) for x in (0.2, 0.25, 0.31)], "r double")
    assert windows.fdr_sweep(real, null, "r", 0.15, 0.90, 0.005, 0.05).first().threshold == pytest.approx(0.315)
    assert windows.fdr_sweep(real.limit(0), null, "r", 0.15, 0.90, 0.005, 0.05).first().threshold == 0.9


def test_auroc(spark):
    r = random.Random(1)
    rows = [(r.choice([0.1, 0.2, 0.3, 0.4]), int(r.random() < 0.4)) for _ in range(60)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert windows.auroc(spark.createDataFrame(rows, "s double, y int"), [], "s", "y").first().auroc == pytest.approx(want)


def test_layers_and_anchor(spark):
    df = spark.createDataFrame([("g", "x", 1, 2.0), ("g", "x", 2, 4.0), ("g", "y", 1, 3.0)], "gene string, layer string, nb int, w double")
    got = {r.nb: (r.weight, r.layers) for r in windows.sum_layers(df, ["gene"], "layer", "nb", "w").collect()}
    assert got == {1: (1.5, ["x", "y"]), 2: (1.0, ["x"])}
    rows = [("s", g, v) for g, v in zip("abcd", (0.5, 0.4, 0.1, -0.9))] + [("t", g, v) for g, v in zip("abc", (-0.5, -0.1, -0.2))] + [("u", "a", 0.9)]
    panel = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    got = windows.flip_by_anchor(spark.createDataFrame(rows, "screen string, gene string, p double"), ["screen"], "gene", panel, "p").collect()
    assert {(r.screen, r.gene): r.p for r in got}["s", "d"] == 0.9
    assert {r.screen for r in got if r.flipped} == {"s"}


def series(spark, **items):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in items.items() for i, v in enumerate(vs) if v is not None], "item string, member int, v double")


def test_weighted_pearson_by_hand(spark):
    got = {(r.a, r.b): (r.r, r.r_plain) for r in pairwise.weighted_pearson(series(spark, a=[1, 2, 3], c=[2, 1, 4], d=[2, 4, 6], e=[5, 5, 5], z=[0, 0, 0]), "item", "member", "v").collect()}
    assert got["a", "c"][0] == pytest.approx(0.8284941842352037, abs=1e-6)
    assert got["a", "d"] == pytest.approx((1.0, 1.0))
    assert got["a", "e"] == (None, None) and got["a", "z"][0] is None


def random_matrix(items, members, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(items, members)), 3)
    x[r.random(x.shape) < 0.3] = np.nan
    return x


def test_count_pairs_by_blocks_and_slices(spark):
    rng = np.random.default_rng(3)
    rows = {(f"g{rng.integers(40)}", int(rng.integers(60))) for _ in range(150)}
    df = spark.createDataFrame([*rows, (None, 1), ("g1", None)], "gene string, screen_id int")
    genes = {g: {s for h, s in rows if h == g} for g, _ in rows}
    expected = sum(a < b and bool(genes[a] & genes[b]) for a in genes for b in genes)
    for sizes in ({}, {"block_items": 7, "task_cells": 20}):
        assert pairwise.count_pairs(df, "gene", "screen_id", **sizes) == expected
    assert pairwise.count_pairs(df.limit(0), "gene", "screen_id") == 0


def test_block_sums_within_groups_of_text_items(spark):
    r = np.random.default_rng(4)
    rows = [(g, f"i{i}", f"m{r.integers(12)}", float(np.round(r.normal(), 2))) for g in "xy" for i in range(7) for _ in range(9)]
    df = spark.createDataFrame(rows, "kind string, item string, member string, v double")
    rounded = lambda q: tuple(q)[:4] + tuple(round(v, 6) + 0.0 for v in tuple(q)[4:])
    joined = sorted(rounded(q) for q in pairwise.pair_moments(df, "item", "member", "v", ["kind"]).collect())
    for sizes in ({}, {"block_items": 2, "task_cells": 20}):
        assert sorted(rounded(q) for q in pairwise.blocked_moments(df, "item", "member", "v", ["kind"], **sizes).collect()) == joined
    assert pairwise.blocked_moments(df.limit(0), "item", "member", "v", ["kind"]).count() == 0


def test_running_total_and_least_from(spark):
    r = np.random.default_rng(9)
    rows = [(float(r.integers(60)) / 7, int(r.integers(100))) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, n long").repartition(6)
    total = {(q.p, q.k) for q in windows.add_running_total(df, "p", "n", "k").collect()}
    assert total == {(p, sum(n for q, n in rows if q <= p)) for p, _ in rows}
    least = {(q.p, q.low) for q in windows.add_least_from(df, "p", "n", "low").collect()}
    assert least == {(p, min(n for q, n in rows if q >= p)) for p, _ in rows}


def test_moments_both_ways(spark):
    x = random_matrix(9, 40)
    rows = [(i, m, float(x[i, m])) for i in range(9) for m in range(40) if not np.isnan(x[i, m])]
    df = spark.createDataFrame(rows, "item long, member long, v double")
    joined = {(r.a, r.b): tuple(r)[2:] for r in pairwise.pair_moments(df, "item", "member", "v").collect()}
    blocked = {(r.a, r.b): tuple(r)[2:] for r in pairwise.blocked_moments(df, "item", "member", "v", block_items=3, task_cells=60).collect()}
    assert joined.keys() == blocked.keys() == {(i, j) for i in range(9) for j in range(i + 1, 9)}
    for (i, j), sums in joined.items():
        both = ~np.isnan(x[i]) & ~np.isnan(x[j])
        a, b = x[i][both], x[j][both]
        assert sums == pytest.approx((both.sum(), a.sum(), b.sum(), a @ b, a @ a, b @ b))
        assert blocked[i, j] == pytest.approx(sums)
    r = {(q.a, q.b): q.r for q in pairwise.pair_moments(df, "item", "member", "v").select("a", "b", pairwise.pearson().alias("r")).collect()}
    both = ~np.isnan(x[2]) & ~np.isnan(x[5])
    assert r[2, 5] == pytest.approx(np.corrcoef(x[2][both], x[5][both])[0, 1])


def test_cohits(spark):
    r = np.random.default_rng(3)
    v, h = random_matrix(8, 30, 3), None
    h = (r.random(v.shape) < 0.5) & ~np.isnan(v)
    rows = [(s, g, float(v[g, s]), bool(h[g, s])) for g in range(8) for s in range(30) if not np.isnan(v[g, s])]
    df = spark.createDataFrame(rows, "screen_id long, gene long, percentile double, hit boolean")
    for q in pairwise.cohit_pairs(df, "gene", "screen_id", "percentile", "hit", 2).collect():
        i, j = q.a, q.b
        both = ~np.isnan(v[i]) & ~np.isnan(v[j])
        hits = h[i] & h[j]
        n, a, ri, rj = both.sum(), hits.sum(), (h[i] & both).sum(), (h[j] & both).sum()
        assert (q.cohit, q.n, q.a_hits, q.b_hits) == (a, n, ri, rj)
        assert q.concordance == pytest.approx((np.sign(v[i][hits]) == np.sign(v[j][hits])).mean())
        tail = sum(math.comb(ri, x) * math.comb(n - ri, rj - x) for x in range(a, min(ri, rj) + 1)) / math.comb(n, rj)
        assert q.p == pytest.approx(tail)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 0), (2, 3, 0.7, 0), (3, 4, 0.6, 0), (4, 5, 0.5, 1)], "a int, b int, strength double, reciprocal int")
    assert {r.node for r in graph.neighbourhood(edges, 1).collect()} == {1, 2}
    assert {r.node for r in graph.neighbourhood(edges, 3).collect()} == {1, 2, 3, 4}  # no mutual-best partner: all
    assert {r.node for r in graph.neighbourhood(edges, 1, reciprocal_only=False).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    assert graph.induced(edges, nodes).count() == 3
    jaccard = {(r.a, r.b): r.jaccard for r in graph.neighbourhood_jaccard(edges, edges.select("a", "b")).collect()}
    assert jaccard == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5, (3, 4): 0.0, (4, 5): 0.0}
    tiers = graph.with_tiers(edges, spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"))
    assert {(r.a, r.b): r.tier for r in tiers.collect()} == {(1, 2): 1, (1, 3): 3, (2, 3): 4, (3, 4): 4, (4, 5): 2}
    assert {r.tier: r.n for r in graph.tier_histogram(tiers.filter("tier != 2")).collect()} == {1: 1, 2: 0, 3: 1, 4: 2}


def test_upserts_and_batches(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, upsert.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]
    assert sorted(map(tuple, upsert.insert_missing(old, new, ["k"], [F.col("v")]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    path = str(tmp_path / "t")
    work = spark.range(50).withColumnRenamed("id", "k")
    upsert.append_batches(work.filter("k < 20"), path, "k", 4)
    upsert.append_batches(work, path, "k", 4)
    assert upsert.append_batches(work, path, "k", 4) == 0
    assert spark.read.parquet(path).agg(F.count("*"), F.count_distinct("k")).first()[:2] == (50, 50)
    parts = str(tmp_path / "p")
    upsert.replace_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string"), parts, ["p"])
    upsert.replace_partitions(spark.createDataFrame([(2, "z")], "p int, v string"), parts, ["p"])
    assert sorted((r.p, r.v) for r in spark.read.parquet(parts).collect()) == [(1, "x"), (2, "z")]


def test_duplicate_files(spark, tmp_path):
    for name, text in (("a", "same"), ("b", "same"), ("c", "diff"), ("d", "longer")):
        (tmp_path / name).write_text(text)
    found = upsert.duplicate_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [[p.rsplit("/", 1)[1] for p in r.paths] for r in found] == [["a", "b"]]


def test_jaccard_at_a_hub_opens_the_smaller_end(spark):
    """A star of 100,000 leaves with some triangles: as many rows as leaves, not their square; and all pairs by brute force."""
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    more = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 7)], "a long, b long")
    edges = star.unionByName(more)
    way = graph.both_ways(edges).filter("a != b").distinct()
    assert graph._wedges(way, edges.filter("a != b")).count() < 20
    got = {(r.a, r.b): r.jaccard for r in graph.neighbourhood_jaccard(edges, edges).filter("a > 0 or b < 6").collect()}
    near = {0: set(range(1, 100_001)), 1: {0, 2}, 2: {0, 1, 3}, 3: {0, 2, 4}, 4: {0, 3}, 5: {0}, 7: {0}}
    for (a, b), jaccard in got.items():
        x, y = near[a] - {a, b}, near[b] - {a, b}
        assert jaccard == round(len(x & y) / len(x | y), 3) if x | y else jaccard == 0.0
    r = np.random.default_rng(2)
    rows = {(int(a), int(b)) for a, b in r.integers(0, 15, (40, 2)) if a != b}
    pairs = [(a, b) for a in range(16) for b in range(16) if a != b]
    near = {x: {b for a, b in rows if a == x} | {a for a, b in rows if b == x} for x in range(16)}
    found = graph.neighbourhood_jaccard(spark.createDataFrame([*rows], "a int, b int"), spark.createDataFrame(pairs, "a int, b int")).collect()
    for q in found:
        x, y = near[q.a] - {q.b}, near[q.b] - {q.a}
        assert q.jaccard == (round(len(x & y) / len(x | y), 3) if x | y else 0.0)
    assert len(found) == len(pairs)


def test_upserts_touch_only_the_buckets_they_change(spark, tmp_path):
    path = str(tmp_path / "table")
    old = spark.createDataFrame([(i, f"o{i}") for i in range(200)] + [(None, "null")], "k int, v string")
    upsert.write_buckets(old, path, ["k"], 20)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}

    before = files()
    bucket = {r.k: r.b for r in old.select("k", F.pmod(F.xxhash64("k"), F.lit(20)).cast("int").alias("b")).collect()}
    new = [(5, "n5"), (6, "n6"), (1000, "n1000"), (None, "null too")]
    changed, fresh = upsert.upsert_buckets(spark.createDataFrame(new, "k int, v string"), path, ["k"], 20)
    assert changed == sorted({bucket[5], bucket[6]}) and set(fresh).isdisjoint(changed) and len(fresh) <= 2
    got = sorted(((r.k, r.v) for r in spark.read.parquet(path).collect()), key=repr)
    assert got == sorted([(i, f"o{i}") for i in range(200) if i not in (5, 6)] + new + [(None, "null")], key=repr)
    after, rewritten = files(), {f"_bucket={b}" for b in changed}
    assert all(after.get(f) == t for f, t in before.items() if f.parent.name not in rewritten)
    again = upsert.upsert_buckets(spark.createDataFrame(new[:3], "k int, v string"), path, ["k"], 20)
    assert again == (sorted({bucket[5], bucket[6], *([b for b in fresh if b in again[0]])}), [])
    assert spark.read.parquet(path).count() == 203


def test_coscreen_layer_by_blocks(spark):
    from heddle.plans import builders

    r = np.random.default_rng(7)
    rows = {(int(g), int(s)) for g, s in r.integers(0, 30, (250, 2))}
    sets = {g: {s for h, s in rows if h == g} for g, _ in rows}
    want = set()
    for a in sets:
        w = {b: len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) for b in sets if b != a and sets[a] & sets[b]}
        want |= {(a, b, round(w[b], 9)) for b in sorted(w, key=lambda b: (-round(w[b], 9), b))[:4]}
    df = spark.createDataFrame([*rows, *list(rows)[:9]], "gene long, screen_id long")
    for sizes in ({}, {"block_items": 7, "task_cells": 40}):
        assert {(q.gene, q.neighbour, round(q.weight, 9)) for q in builders.coscreen_layer(df, 4, **sizes).collect()} == want
