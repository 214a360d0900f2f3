"""The sign of a panel's mean is that of the exact sum of its percentiles, in whatever order, as SQL has it where the mean is all but 0."""

import math
import random

import pytest

from __spark_entry__ import oracle_sql, queries
from heddle.operators.windows import flip_by_anchor

from .oracle import connect, same


def test_sign_of_a_panel_is_of_its_exact_sum(spark):
    rng, groups = random.Random(3), []
    while len(groups) < 40:
        n = rng.choice([7, 11, 13, 59])
        ranks = [rng.randrange(n + 1) for _ in range(7)]
        ranks += [n - r for r in ranks]
        values = [2.0 * (r / n) - 1.0 for r in ranks]
        if abs(math.fsum(values)) > 0:  # the mean is 0 but for the rounding of the values themselves
            groups.append(values)
    signs = [math.fsum(v) > 0 for v in groups]
    assert any(signs) and not all(signs)
    rows = [(2 * k + turned, g, x) for k, v in enumerate(groups) for turned in (0, 1) for g, x in enumerate(reversed(v) if turned else v)]
    panel = spark.range(14).withColumnRenamed("id", "gene")
    df = spark.createDataFrame(rows, "screen_id long, gene long, percentile double")
    found = {r.screen_id: r.flipped for r in flip_by_anchor(df, ["screen_id"], "gene", panel, "percentile").select("screen_id", "flipped").distinct().collect()}
    assert found == {2 * k + turned: sign for k, sign in enumerate(signs) for turned in (0, 1)}


def test_values_beyond_the_units_are_averaged(spark):
    rows = [(0, 0, 1e30), (0, 1, 1.0), (0, 2, 2.0), (1, 0, -1e30), (1, 1, 1.0), (1, 2, 2.0)]
    df = spark.createDataFrame(rows, "screen_id long, gene long, percentile double")
    found = flip_by_anchor(df, ["screen_id"], "gene", spark.range(3).withColumnRenamed("id", "gene"), "percentile")
    assert {r.screen_id: r.flipped for r in found.collect()} == {0: True, 1: False}


@pytest.mark.parametrize("name", ["anchor_flip", "direction_vetoes"])
def test_panels_match_their_sql(spark, name):
    d = "/root/testdata/sf0.01"
    same(spark, d, connect(d), queries()[name], oracle_sql()[name])
