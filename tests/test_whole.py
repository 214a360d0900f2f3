"""Queries over all ids, on tables where half of the ids lie far above the others."""

import math
import os

import pytest

from heddle.plans import networks
from heddle.queries.bindings import scored
from heddle.queries.catalog import ORACLE_SQL, QUERIES
from tests.oracle import TABLES, connect, same

FAR = 100_000
WHOLE = [
    "blocked_screen_moments", "cohit_pairs", "cohit_best_partners", "profile_neighbours", "similar_screens", "neighbourhood_jaccard", "gene_summary", "gene_histogram",
    "gene_extremes", "resolve_gene_names", "layered_neighbours", "predicted_terms", "backtest_auroc", "hypergeometric_tail", "anchored_correlations", "partner_dossiers",
    "unpivoted_models",
]
KEYS = {"lineitem": {"l_partkey": 100, "l_suppkey": 5}, "part": {"p_partkey": 100}, "supplier": {"s_suppkey": 5}, "documents": {"doc_id": 100}}


@pytest.fixture(scope="module")
def far_dir(sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("far")
    con = connect(sf_dir)
    for name in TABLES.split():
        moved = "".join(f"CASE WHEN {k} > {n} THEN {k} + {FAR} ELSE {k} END AS {k}, " for k, n in KEYS.get(name, {}).items())
        if moved:
            con.sql(f"COPY (SELECT * REPLACE ({moved.rstrip(', ')}) FROM {name}) TO '{out}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{sf_dir}/{name}.parquet", out / f"{name}.parquet")
    return str(out)


def moved(value, n):
    return value + FAR if value > n else value


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_matches_its_sql(spark, far_dir, name):
    same(spark, far_dir, connect(far_dir), QUERIES[name], ORACLE_SQL[name])


def test_coessential_network_reaches_far_ids(spark, far_dir):
    assert any(max(r.a, r.b) > FAR for r in QUERIES["coessential_network"](spark, far_dir).collect())


def test_organism_network_keeps_some_edges_and_drops_others(spark, far_dir):
    """With its gate at 0.05, on documents: an early letter's words alone, and all of them."""
    edges = {(r.a, r.b) for r in QUERIES["organism_network"](spark, far_dir).collect()}
    assert any(max(e) > FAR for e in edges) and len(edges) < 200 * 25 / 2


def test_screen_similarity_without_component_reaches_far_ids(spark, sf_dir, far_dir):
    near, far = ({(r.screen_a, r.screen_b) for r in QUERIES["screen_similarity_without_component"](spark, d).collect()} for d in (sf_dir, far_dir))
    assert far == {(moved(a, 5), moved(b, 5)) for a, b in near} and any(max(p) > FAR for p in far)


def test_cohit_network_reaches_far_ids_and_counts_its_tests(spark, tmp_path):
    genes, screens = [*range(1, 21), *range(FAR, FAR + 20)], range(60)
    rows = [(s, g, float((g * 7919 + s * 104729) % 1009), "R" if (s * 31 // 7 + g // 2 * 13) % 60 < 20 and (s + g // 2) % 3 else "N", s, 1) for g in genes for s in screens]
    schema = "l_suppkey long, l_partkey long, l_extendedprice double, l_returnflag string, l_orderkey long, l_linenumber int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    hits = {g: {s for s, h, _, flag, _, _ in rows if h == g and flag == "R"} for g in genes}
    tested, found = len(genes) ** 2, {(r.a, r.b): r for r in networks.cohit_network(scored(spark, str(tmp_path)), alpha=0.5).collect()}
    p = {}
    for a in genes:
        for b in genes:
            x, r, k = len(hits[a] & hits[b]), len(hits[a]), len(hits[b])
            if a != b and x >= 3:
                p[a, b] = sum(math.comb(r, i) * math.comb(60 - r, k - i) for i in range(x, min(r, k) + 1)) / math.comb(60, k)
    order = sorted(p.values())
    limit = max((v for n, v in enumerate(order, 1) if v <= 0.5 * n / tested), default=0)
    assert {e for e, v in p.items() if e[0] < e[1] and v <= limit + 1e-9} == set(found)
    assert any(min(e) >= FAR for e in found)
    for e, r in found.items():
        assert math.isclose(r.q_ref, min(1, p[e] * tested / len(p)), rel_tol=1e-6)


@pytest.mark.parametrize(
    "name,key",
    [
        ("gene_summary", "gene"), ("gene_histogram", "gene"), ("gene_extremes", "gene"), ("partner_dossiers", "gene"), ("resolve_gene_names", "gene_id"),
        ("layered_neighbours", "gene"), ("predicted_terms", "gene"), ("hypergeometric_tail", "p_partkey"), ("unpivoted_models", "model"),
    ],
)
def test_report_reaches_far_ids(far_dir, name, key):
    con = connect(far_dir)
    assert con.sql(f"SELECT count(*) FROM ({ORACLE_SQL[name]}) WHERE {key} > {FAR}").fetchall()[0][0] > 0
