"""Panels whose mean is 0 but for rounding are not positive, in whatever order they are summed."""

import itertools

from heddle.operators.windows import flip_by_anchor
from heddle.plans.details import veto_directions


def test_a_panel_with_mean_zero_flips_and_vetoes_nothing(spark):
    values = [0.1, 0.2, -0.3]
    orders = [*itertools.permutations(values)]
    assert any(sum(order) > 0 for order in orders)
    rows = spark.createDataFrame([(k, g, x) for k, order in enumerate(orders) for g, x in enumerate(order)], "screen_id long, gene long, percentile double").coalesce(1)
    panel = spark.range(3).withColumnRenamed("id", "gene")
    assert not any(r.flipped for r in flip_by_anchor(rows, ["screen_id"], "gene", panel, "percentile").collect())
    screens = spark.createDataFrame([(k, "Knockout", "cell proliferation", None) for k in range(6)], "screen_id long, methodology string, phenotype string, rationale string")
    found = veto_directions(rows, screens, screens.select("screen_id"), panel).collect()
    assert len(found) == 6 and not any(r.conflict for r in found)
