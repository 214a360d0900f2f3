"""Leading components of tables whose largest eigenvalues are close together and each there many times, as of copies."""

from heddle.plans import networks


def test_many_copies_of_close_eigenvalues_converge(spark, monkeypatch):
    monkeypatch.setattr(networks, "MOST_ROUNDS", 24)
    rows = [(c * 100 + k, c * 100 + k, (1 - 0.002 * k * k) ** 0.5) for c in range(12) for k in range(20)]
    v, su = networks.leading_component(spark.createDataFrame(rows, "gene long, screen_id long, x double").coalesce(1))
    of = {r.screen_id: r.v for r in v.collect()}
    assert abs(sum(x * x for x in of.values()) - 1) < 1e-6
    assert all(abs(x) < 1e-4 for s, x in of.items() if s % 100)
    assert len(of) == 240 and su.count() == 240
