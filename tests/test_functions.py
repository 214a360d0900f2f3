import math

import pytest
from pyspark.sql import functions as F

from heddle.functions import requests, rules, scores, stats
from heddle.plans import knowledge
from heddle.queries.catalog import CASES


@pytest.mark.parametrize("name", list(CASES))
def test_rule_cases(spark, name):
    rule, cases = CASES[name]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, given string")
    got = {r.i: r.found for r in rows.select("i", rule(F.col("given")).alias("found")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "values,found",
    [
        (("Knockout", "CRISPRn", "Cas9"), ("KO", 1.0)), (("", "CRISPRi", ""), ("CRISPRi", 1.0)), (("Activation", "", ""), ("CRISPRa", 1.0)),
        (("", "", "dCas9-VPR"), ("CRISPRa", 0.7)), (("", "", "dCas9-KRAB"), ("CRISPRi", 1.0)), (("shRNA", "", ""), ("RNAi", 1.0)),
        (("", "Cytosine base editing", ""), ("KO", 1.0)), (("", "", "SpCas9"), ("KO", 0.9)), ((None, None, None), ("Other", 0.5)),
    ],
)
def test_screen_type(spark, values, found):
    assert tuple(one(spark, rules.screen_type(*[F.lit(v).cast("string") for v in values]))) == found


@pytest.mark.parametrize(
    "available,size,found",
    [("Yes", "18,000", ("Genome-wide", 1.0)), ("No", "20000", ("Genome-wide", 0.8)), ("no", "300", ("Unknown", 0.6)), ("yes", "300", ("Focused", 1.0)), ("", "7000", ("Unknown", 0.5)), (None, "12000", ("Genome-wide", 0.9)), ("yes", "many", ("Unknown", 0.5))],
)
def test_coverage(spark, available, size, found):
    assert tuple(one(spark, rules.coverage_type(F.lit(available).cast("string"), F.lit(size)))) == found


def test_pairs_signs_and_quality(spark):
    assert tuple(one(spark, rules.pair_member(F.lit("pos score p-value")))) == ("pos", True)
    assert tuple(one(spark, rules.pair_member(F.lit("Depletion score")))) == ("neg", False)
    assert one(spark, rules.pair_member(F.lit("log2fc"))) is None
    assert [one(spark, rules.selection_sign(F.lit(x))) for x in ("Negative Selection", "positive selection", "Positive and Negative Selection")] == [-1, 1, None]
    quality = lambda n, d: tuple(one(spark, rules.screen_quality(F.lit(n), F.lit(d))))
    assert [quality(*x) for x in ((1, 1), (10, 1), (500, 19), (5000, 30), (500, 20), (100, 2))] == [(False, "too few values"), (False, "one value"), (False, "collapsed"), (True, "coarse"), (True, None), (True, None)]


def test_scores(spark):
    number = lambda x: one(spark, scores.to_number(F.lit(x)))
    assert [number(x) for x in ("1.5", "-", "", "None", "nan", " 2e-3 ", "abc")] == [1.5, None, None, None, None, 0.002, None]
    assert [one(spark, scores.neglog10(F.lit(x).cast("double"))) for x in (0.01, 0.0, 2.0, None)] == [2.0, 10.0, 0.0, 0.0]
    assert one(spark, scores.dark_score(F.lit(98))) == 5.0
    sign = lambda h, z: one(spark, scores.effect_sign(F.lit(h).cast("double"), F.lit(z).cast("double")))
    assert [sign(-1, 2), sign(0, -1), sign(None, -1), sign(None, None), sign(0, 0)] == ["neg", "neg", "neg", "pos", "pos"]
    assert scores.symbol_variants("Trp53") == ["Trp53", "TRP53", "trp53"]
    assert one(spark, scores.combined_evidence(F.lit(500), F.lit(None).cast("int"), F.lit(200))) == pytest.approx(0.6)
    assert one(spark, scores.in_parentheses(F.lit("a (b) c (d)"))) == "b" and one(spark, scores.in_parentheses(F.lit("a (b) c (d)"), True)) == "b) c (d"
    assert one(spark, scores.search_rank(F.lit(99), F.lit(24))) == 50
    assert one(spark, scores.paper_id(F.lit(" "), F.lit(7))) == "screen:7"


def test_hypergeometric_tail(spark):
    cases = [(3, 20, 5, 6), (0, 10, 2, 3), (6, 10, 5, 6), (5, 5000, 40, 60), (30, 20000, 40, 60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, n int, r int, d int")
    got = {r.i: r.p for r in df.select("i", stats.hypergeom_sf("k", "n", "r", "d").alias("p")).collect()}
    for i, (k, n, r, d) in enumerate(cases):
        want = sum(math.comb(r, x) * math.comb(n - r, d - x) for x in range(k, min(r, d) + 1)) / math.comb(n, d)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_correlation_p(spark):
    # two-sided tails of Student's t: t = 2.0 with 10 degrees of freedom, t = 1 with 1, r = 0, r = 1, undefined
    r10 = 2 / math.sqrt(2 * 2 + 10)
    cases = [(r10, 12.0, 0.07338803), (math.sqrt(0.5), 3.0, 0.5), (0.0, 30.0, 1.0), (1.0, 5.0, 0.0), (0.5, 2.0, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, r double, n double")
    got = {r.i: r.p for r in df.select("i", stats.correlation_p("r", "n").alias("p")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == (pytest.approx(want, abs=1e-7) if want is not None else None)


def test_requests_are_checked_before_any_plan():
    assert (requests.symbol(" ATG5 "), requests.screen_id("381"), requests.context("human:drug")) == ("ATG5", "381", "human:drug")
    assert [requests.organism(x) for x in (None, " ", "Human", "mouse", "MOUSE")] == ["human", "human", "human", "mouse", "mouse"]
    for check, value in ((requests.symbol, "-x"), (requests.symbol, "a" * 41), (requests.symbol, "A;B"), (requests.screen_id, "12x"), (requests.screen_id, "1" * 10), (requests.context, ""), (requests.organism, "yeast")):
        with pytest.raises(ValueError, match="invalid|unknown"):
            check(value)


def test_screen_facets(spark):
    names = "screen_id methodology library_type enzyme screen_type full_size_available full_size phenotype setup condition notes".split()
    rows = [
        (1, "Knockout", "CRISPRn", "Cas9", "Negative Selection", "Yes", "18000", "cell proliferation", "Timecourse", "", ""),
        (2, "Inhibition", "CRISPRi", "dCas9-KRAB", "Positive Selection", "No", "", "response to chemicals", "Drug Exposure", "Olaparib 5uM", ""),
        (3, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'screen_id' else 'string'}" for n in names))
    got = {r.screen_id: r for r in knowledge.screen_facets(df).collect()}
    assert (got[1].perturbation, got[1].selection_method, got[1].assay_domain, got[1].condition_class, got[1].mechanism) == ("KO", "Negative", "fitness", "baseline", None)
    assert (got[2].perturbation, got[2].selection_method, got[2].assay_domain, got[2].condition_class, got[2].mechanism) == ("CRISPRi", "Positive", "stress", "drug", "DDR·PARP")
    assert (got[3].perturbation, got[3].selection_method, got[3].condition_class) == ("Other", "Unknown", "unknown") and len(got) == 3
