"""Deterministic classification rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import fixed_values as V


def _clean(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _has_any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def score_role(label: Column) -> Column:
    """What a score-type label stands for. Exact names first, then logarithms, then markers of p-values and effects."""
    t = _clean(label)
    return (
        F.when(t.isin("", "-"), F.lit(None))
        .when(t.isin(V.DIR_POS), "DIR_POS")
        .when(t.isin(V.DIR_NEG), "DIR_NEG")
        .when(t.isin(V.SIG_MAG), "SIG_MAG")
        .when(t.isin(V.SIG_P), "SIG_P")
        .when(t.isin(V.IGNORE), "IGNORE")
        .when(_has_any(t, V.AMBIGUOUS_LOG_MARKERS), "AMBIGUOUS_LOG")
        .when(_has_any(t, V.P_MARKERS), "SIG_P")
        .when(_has_any(t, V.EFFECT_MARKERS), "DIR_POS")
        .otherwise("UNKNOWN")
    )


def pair_member(label: Column) -> Column:
    """Struct of side (pos or neg) and p_like for a label of one direction of a pair; null for others."""
    t = _clean(label)
    side = F.when(_has_any(t, ["pos", "enrichment"]), "pos").when(_has_any(t, ["neg", "depletion"]), "neg")
    return F.when(~t.isin("", "-") & side.isNotNull(), F.struct(side.alias("side"), _has_any(t, V.PAIR_P_MARKERS).alias("p_like")))


def selection_sign(screen_type: Column) -> Column:
    """-1 or 1 for unsigned significance; null where the selection says no direction. Names must match whole."""
    t = _clean(screen_type)
    return F.when(t == "negative selection", -1).when(t == "positive selection", 1)


def screen_quality(n_valid: Column, n_distinct: Column) -> Column:
    """Struct of ok and note from a screen's number of scores and of different scores."""
    large = n_valid >= V.COLLAPSE_MIN_GENES
    note = (
        F.when(n_valid < 2, "too few values")
        .when(n_distinct <= 1, "one value")
        .when(large & (n_distinct < V.COLLAPSE_DISTINCT), "collapsed")
        .when(large & (n_distinct / n_valid < V.COARSE_SHARE), "coarse")
    )
    return F.struct((note.isNull() | (note == "coarse")).alias("ok"), note.alias("note"))


def _decided(value: Column | str, confidence: float) -> Column:
    return F.struct((F.lit(value) if isinstance(value, str) else value).alias("value"), F.lit(confidence).alias("confidence"))


def screen_type(methodology: Column, library_type: Column, enzyme: Column) -> Column:
    """Kind of perturbation with a confidence."""
    m, lib, e = _clean(methodology), _clean(library_type), _clean(enzyme)
    has = lambda x, *words: _has_any(x, list(words))
    return (
        F.when(has(lib, "base editing"), _decided("KO", 1.0))
        .when(has(lib, "crispri") | has(m, "inhibition") | has(e, "krab"), _decided("CRISPRi", 1.0))
        .when(has(lib, "crispra") | has(m, "activation"), _decided("CRISPRa", 1.0))
        .when(has(e, "dcas9") & ~has(e, "krab"), _decided("CRISPRa", 0.7))
        .when(has(m, "rnai", "shrna", "sirna"), _decided("RNAi", 1.0))
        .when(has(lib, "crisprn") | has(m, "knockout"), _decided("KO", 1.0))
        .when(has(e, "cas9") & ~has(e, "dcas9"), _decided("KO", 0.9))
        .otherwise(_decided("Other", 0.5))
    )


def selection_method(screen_type: Column) -> Column:
    t = _clean(screen_type)
    negative, positive = F.contains(t, F.lit("negative")), F.contains(t, F.lit("positive"))
    return (
        F.when(t == "negative selection", _decided("Negative", 1.0))
        .when(t == "positive selection", _decided("Positive", 1.0))
        .when(t == "positive and negative selection", _decided("Bidirectional", 1.0))
        .when(t == "phenotype screen", _decided("Phenotype", 1.0))
        .when(negative & ~positive, _decided("Negative", 0.9))
        .when(positive & ~negative, _decided("Positive", 0.9))
        .when(_has_any(t, ["phenotype", "sort", "facs"]), _decided("Phenotype", 0.9))
        .otherwise(_decided("Unknown", 0.5))
    )


def coverage_type(available: Column, full_size: Column) -> Column:
    """Scope of the library from whether all scores are there and how many genes it has."""
    a = _clean(available)
    n = F.coalesce(F.regexp_replace(full_size.cast("string"), ",", "").try_cast("int"), F.lit(0))
    return (
        F.when((a == "yes") & (n >= 10000), _decided("Genome-wide", 1.0))
        .when((a == "no") & (n >= 10000), _decided("Genome-wide", 0.8))
        .when(a == "no", _decided("Unknown", 0.6))
        .when((n > 0) & (n < 5000), _decided("Focused", 1.0))
        .when(n >= 10000, _decided("Genome-wide", 0.9))
        .otherwise(_decided("Unknown", 0.5))
    )


def assay_domain(phenotype: Column) -> Column:
    p = _clean(phenotype)
    return (
        F.when(p == "", _decided("other", 0.5))
        .when(p.startswith("response to") | F.contains(p, F.lit("resistance")), _decided("stress", 1.0))
        .when(_has_any(p, V.FITNESS_PHENOTYPES), _decided("fitness", 1.0))
        .when(_has_any(p, V.REPORTER_PHENOTYPES), _decided("reporter", 1.0))
        .otherwise(_decided("other", 0.5))
    )


def condition_class(setup: Column, condition: Column, notes: Column) -> Column:
    """Struct of class and method: by the setup's name, else by key words of condition and notes."""
    s = _clean(setup)
    text = F.concat_ws(" ", F.coalesce(condition, F.lit("")), F.coalesce(notes, F.lit("")))
    says = lambda pattern: F.rlike(text, F.lit(pattern))
    keyword = (
        F.when(says(V.SIGNAL_AGENT) & says(V.SIGNAL_WITHDRAWN), "signal")
        .when(says(V.NUTRIENT), "nutrient")
        .when(says(V.BINDING), "binding")
        .when(says(V.DEATH), "drug")
    )
    by_setup = F.lit(None).cast("string")
    for name, kind in V.SETUP_CLASS.items():
        by_setup = F.when(s == name, kind).otherwise(by_setup)
    method = F.when(by_setup.isNotNull(), "setup").when(keyword.isNotNull(), "keyword").otherwise("unknown")
    return F.struct(F.coalesce(by_setup, keyword, F.lit("unknown")).alias("class"), method.alias("method"))


def growth_direction(kind: Column) -> Column:
    return F.when(kind.isin(V.NO_PRESSURE), "none").when(kind.isin(V.SUPPRESSING), "suppressing").otherwise("UNRESOLVED")


def readout_type(kind: Column, domain: Column, notes: Column) -> Column:
    return (
        F.when((F.coalesce(domain, F.lit("")) == "reporter") | F.rlike(F.coalesce(notes, F.lit("")), F.lit(V.MARKER)), "marker")
        .when(kind.isin(V.NO_PRESSURE), "proliferation")
        .when(kind.isin(V.SUPPRESSING), "survival")
        .when(kind == "binding", "binding")
        .otherwise("UNRESOLVED")
    )


def expected_domain(kind: Column) -> Column:
    return F.when(kind.isin(V.NO_PRESSURE), "fitness").when(kind.isin([*V.SUPPRESSING, "signal"]), "stress")


def derived_domain(kind: Column, readout: Column, growth: Column) -> Column:
    baseline = kind.isin(V.NO_PRESSURE) & (growth == "none")
    return (
        F.when(readout.isin("marker", "binding"), "reporter")
        .when(readout == "survival", "stress")
        .when((readout == "proliferation") & baseline, "fitness")
        .when(readout == "proliferation", "stress")
    )


def mechanism(drug: Column) -> Column:
    """The mechanism of a drug, by the first bucket with a part of its name; null for unknown ones."""
    name = F.lower(drug)
    found = F.lit(None).cast("string")
    for bucket, parts in reversed(V.MECHANISMS):
        found = F.when(_has_any(name, parts), bucket).otherwise(found)
    return found


def edge_tier(reciprocal: Column, has_cohit: Column) -> Column:
    """1: mutual best and co-hit, 2: mutual best only, 3: co-hit only, 4: neither."""
    return F.when(reciprocal & has_cohit, 1).when(reciprocal, 2).when(has_cohit, 3).otherwise(4)


def prediction_confidence(n_layers: Column, n_support: Column) -> Column:
    return (
        F.when((n_layers >= 2) & (n_support >= 3), "high")
        .when((n_support >= 4) | (n_layers >= 2), "moderate")
        .otherwise("tentative")
    )


def override_status(mode: Column, confidence: Column, unresolved: Column) -> Column:
    """Of a proposed direction: binary_only without a continuous score, auto when defined and confident, else needs_review."""
    sure = (mode != "UNDEFINED") & (F.coalesce(confidence, F.lit(0.0)) >= V.DIRECTION_CONFIDENCE)
    return F.when(unresolved, "binary_only").when(sure, "auto").otherwise("needs_review")


def is_viability_knockout(methodology: Column, phenotype: Column, rationale: Column) -> Column:
    """Whether core-essential genes must be at the negative end of a screen."""
    text = F.lower(F.concat_ws(" ", F.coalesce(phenotype, F.lit("")), F.coalesce(rationale, F.lit(""))))
    return (_clean(methodology) == "knockout") & _has_any(text, V.VIABILITY_MARKERS)


def score_bucket(label: Column) -> Column:
    """effect, significance, rank, unusable or unknown; labels must match exactly."""
    found = F.lit("unknown")
    for bucket in sorted(set(V.SCORE_BUCKETS.values())):
        found = F.when(label.isin([k for k, v in V.SCORE_BUCKETS.items() if v == bucket]), bucket).otherwise(found)
    return found


def modality(methodology: Column) -> Column:
    """Struct of modality and sign; unknown methodologies stand for themselves, with sign 0."""
    found = F.struct(F.coalesce(F.nullif(methodology, F.lit("")), F.lit("unknown")).alias("modality"), F.lit(0).alias("sign"))
    for name, (kind, sign) in V.MODALITIES.items():
        found = F.when(methodology == name, F.struct(F.lit(kind).alias("modality"), F.lit(sign).alias("sign"))).otherwise(found)
    return found


def organism(name: Column, default: str | None = "human") -> Column:
    """human or mouse; anything else is ``default``."""
    n = _clean(name)
    return (
        F.when(n.isin("mouse", "mus musculus", "10090"), "mouse")
        .when(n.isin("human", "homo sapiens", "9606"), "human")
        .otherwise(F.lit(default))
    )
