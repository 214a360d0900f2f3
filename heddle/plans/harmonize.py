"""Harmonization: every screen's deposited scores onto one signed axis, in one job over all screens.

A screen's way is decided once, from its metadata and a row of statistics per score column; then one
expression scores its rows. Screens that no way fits get a reason in place of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import rules, scores
from heddle.functions.fixed_values import MAD_TO_SIGMA
from heddle.operators.windows import average_rank
from heddle.storage import written

SLOTS = [1, 2, 3, 4, 5]
OVERRIDES_SCHEMA = "screen_id long, semantics string, transform string, confidence string, slot int, is_directional boolean, sentinel double"
DIRECTIONS_SCHEMA = "screen_id long, mode string, sign int, positive_slot int, negative_slot int, confidence string, status string"


def numeric_scores(rows: DataFrame) -> DataFrame:
    """Rows with scores s1 to s5 as numbers; missing ones are null."""
    return rows.withColumns({f"s{i}": scores.to_number(F.col(f"score_{i}").cast("string")) for i in SLOTS})


def column_statistics(rows: DataFrame) -> DataFrame:
    """Per screen and slot: n, the share of negative values, min and max."""
    stats = [
        F.struct(
            F.lit(i).alias("slot"), F.count(f"s{i}").alias("n"), F.try_divide(F.count_if(F.col(f"s{i}") < 0), F.count(f"s{i}")).alias("negative"),
            F.min(f"s{i}").alias("low"), F.max(f"s{i}").alias("high"),
        )
        for i in SLOTS
    ]
    return rows.groupBy("screen_id").agg(*[s.alias(f"stat_{i}") for i, s in zip(SLOTS, stats)])


def decide(metadata: DataFrame, statistics: DataFrame, overrides: DataFrame, directions: DataFrame) -> DataFrame:
    """One row per screen: way, slot, second slot, factor, whether the sign is final, basis, and the reason of a failure.

    In this order: a confirmed direction, frozen semantics, a pair of columns, a directional column, an ambiguous
    logarithm (which fails), a magnitude (signed if the data say so), a p-value (something else if out of range).
    """
    joined = (
        metadata.join(statistics, "screen_id", "left")
        .join(overrides.withColumnsRenamed({"confidence": "sem_confidence", "slot": "sem_slot"}), "screen_id", "left")
        .join(directions.filter("status = 'auto'").withColumnsRenamed({"confidence": "dir_confidence"}).drop("status"), "screen_id", "left")
    )
    # The rules run over arrays of the five slots, so that a plan holds each of them once.
    slots = joined.withColumns({"stats": F.array(*[F.col(f"stat_{i}") for i in SLOTS]), "types": F.array(*[F.coalesce(f"type_{i}", F.lit("")) for i in SLOTS])})
    used = lambda i: F.get("stats", i).isNotNull()
    ruled = slots.withColumns(
        {
            "roles": F.transform("types", lambda t, i: F.when(used(i), rules.score_role(t))),
            "pairs": F.transform("types", lambda t, i: F.when(used(i), rules.pair_member(t))),
        }
    )

    def first(array: str, fits) -> Column:
        """The first slot (from 1) whose element fits."""
        found = F.array_position(F.transform(array, lambda x: F.coalesce(fits(x), F.lit(False))), F.lit(True))
        return F.nullif(found, F.lit(0)).cast("int")

    chosen = ruled.select(
        "*",
        first("pairs", lambda x: x["side"] == "pos").alias("pos"),
        first("pairs", lambda x: x["side"] == "neg").alias("neg"),
        first("roles", lambda x: x.isin("DIR_POS", "DIR_NEG")).alias("directional"),
        first("roles", lambda x: x == "AMBIGUOUS_LOG").alias("ambiguous"),
        first("roles", lambda x: x == "SIG_MAG").alias("magnitude"),
        first("roles", lambda x: x == "SIG_P").alias("p"),
        F.col("pairs.p_like").alias("p_likes"),
        rules.selection_sign(F.col("screen_type")).alias("selection"),
    )
    at = lambda array, slot: F.get(F.col(array), F.col(slot) - 1)
    selection = F.coalesce("selection", F.lit(1))
    unsure = F.when(F.col("selection").isNull(), "[AMBIGUOUS_SELECTION]").otherwise("")
    tag = F.when(F.coalesce("sem_confidence", F.lit("high")) == "high", "").otherwise("[POLARITY_UNVERIFIED]")
    semantic = F.concat(F.lit("SEMANTICS_OVERRIDE("), "semantics", F.lit(")"), tag)
    sem_slot = F.coalesce("sem_slot", F.lit(1))
    directed = F.coalesce("is_directional", F.lit(False))

    def way(kind: str, slot, second=None, factor=1, final=False, basis="", reason=None) -> list[Column]:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return [
            F.lit(kind), as_column(slot).cast("int"), as_column(second).cast("int"), as_column(factor).cast("int"), as_column(final), as_column(basis),
            as_column(reason).cast("string"),
        ]

    signed = lambda s: (s["negative"] > 0.05) & (s["low"] < -0.5)
    mag, prob = at("stats", "magnitude"), at("stats", "p")
    in_range = prob["n"].isNull() | (prob["n"] == 0) | ((prob["low"] >= 0) & (prob["high"] <= 1 + 1e-9))
    pair_p = F.coalesce(at("p_likes", "pos"), F.lit(False)) | F.coalesce(at("p_likes", "neg"), F.lit(False))
    sem_factor = F.when(F.col("transform") == "negate", -1).otherwise(1)
    has_semantics = F.col("transform").isNotNull()
    ladder = [
        (
            (F.col("mode") == "SINGLE") & has_semantics,
            way("value", sem_slot, factor=sem_factor, final=True, basis=F.concat(F.lit("DIRECTION_BYPASSED("), semantic, F.lit(")"))),
        ),
        ((F.col("mode") == "SINGLE") & F.col("magnitude").isNotNull(), way("magnitude", F.col("magnitude"), factor=F.col("sign"), final=True, basis="DIRECTION_SINGLE")),
        ((F.col("mode") == "SINGLE") & F.col("p").isNotNull(), way("p", F.col("p"), factor=F.col("sign"), final=True, basis="DIRECTION_SINGLE")),
        (F.col("mode") == "SINGLE", way("value", 1, factor=F.col("sign"), final=True, basis="DIRECTION_SINGLE")),
        (F.col("mode") == "PAIR", way("pair", F.col("positive_slot"), F.col("negative_slot"), final=True, basis="DIRECTION_PAIR")),
        (F.col("transform") == "quarantine", way("none", sem_slot, basis=semantic)),
        (has_semantics & directed, way("value", sem_slot, factor=sem_factor, final=True, basis=semantic)),
        (has_semantics, way("value", sem_slot, factor=sem_factor * selection, basis=F.concat(semantic, unsure))),
        (F.col("pos").isNotNull() & F.col("neg").isNotNull() & pair_p, way("pair_p", F.col("pos"), F.col("neg"), basis="PAIR_PVALUE")),
        (F.col("pos").isNotNull() & F.col("neg").isNotNull(), way("pair", F.col("pos"), F.col("neg"), basis="PAIR_SCORE")),
        (
            F.col("directional").isNotNull(),
            way("value", F.col("directional"), factor=F.when(at("roles", "directional") == "DIR_NEG", -1).otherwise(1), basis=at("roles", "directional")),
        ),
        (F.col("ambiguous").isNotNull(), way("none", F.col("ambiguous"), basis="FAILED", reason="ambiguous logarithm")),
        (F.col("magnitude").isNotNull() & signed(mag), way("value", F.col("magnitude"), basis="SIGNED_MAG")),
        (F.col("magnitude").isNotNull() & (mag["high"] <= 0), way("none", F.col("magnitude"), basis="FAILED", reason="magnitude without positive values")),
        (F.col("magnitude").isNotNull(), way("magnitude", F.col("magnitude"), factor=selection, basis=F.concat(F.lit("SIG_MAG"), unsure))),
        (F.col("p").isNotNull() & in_range, way("p", F.col("p"), factor=selection, basis=F.concat(F.lit("SIG_P"), unsure))),
        (F.col("p").isNotNull() & signed(prob), way("value", F.col("p"), basis="SIGNED_EFFECT")),
        (F.col("p").isNotNull() & (prob["low"] >= 0), way("filled", F.col("p"), factor=selection, basis=F.concat(F.lit("SIG_MAGNITUDE"), unsure))),
        (F.col("p").isNotNull(), way("none", F.col("p"), basis="FAILED", reason="p-value out of range")),
        (F.lit(True), way("none", F.lit(None), basis="UNRESOLVED")),
    ]
    # the first step of the ladder that fits, as a number; each field is then a short lookup by that number
    step = F.lit(len(ladder) - 1)
    for number in reversed(range(len(ladder) - 1)):
        step = F.when(ladder[number][0], number).otherwise(step)
    fields = ["way", "slot", "second", "factor", "sign_final", "basis", "reason"]
    numbered = chosen.withColumn("step", step)
    of_step = lambda i: F.element_at(F.array(*[w[i] for _, w in ladder]), F.col("step") + 1)
    activation = F.contains(F.upper(F.coalesce("methodology", F.lit(""))), F.lit("ACTIVATION")) | F.contains(F.upper(F.coalesce("library_type", F.lit(""))), F.lit("CRISPRA"))
    decided = numbered.select("screen_id", "sentinel", activation.alias("is_activation"), *[of_step(i).alias(f) for i, f in enumerate(fields)])
    return decided.withColumn("perturbation", F.when(F.col("sign_final") | ~F.col("is_activation"), 1).otherwise(-1)).drop("is_activation")


def harmonize(rows: DataFrame, metadata: DataFrame, overrides: DataFrame | None = None, directions: DataFrame | None = None) -> DataFrame:
    """Columns screen_id, gene, harmonized, percentile, robust_z, is_hit, basis, note.

    ``rows``: screen_id, gene, score_1 to score_5 (text), hit (text). ``metadata``: screen_id, type_1 to type_5,
    screen_type, methodology, library_type. Percentile and robust z are null for screens whose scores collapsed.
    """
    spark = rows.sparkSession
    overrides = overrides if overrides is not None else spark.createDataFrame([], OVERRIDES_SCHEMA)
    directions = directions if directions is not None else spark.createDataFrame([], DIRECTIONS_SCHEMA)
    numbers = numeric_scores(rows)
    # one row per screen, which the rows' join below reads
    ways = written(decide(metadata, column_statistics(numbers), overrides, directions), "ways")
    joined = numbers.join(ways, "screen_id")
    slots = F.array(*[F.col(f"s{i}") for i in SLOTS])
    x, y = F.get(slots, F.col("slot") - 1), F.get(slots, F.col("second") - 1)
    x = F.when(F.col("sentinel").isNull() | (x != F.col("sentinel")), x)
    kind = F.col("way")
    raw = (
        F.when(kind == "value", x)
        .when(kind == "filled", F.coalesce(x, F.lit(0.0)))
        .when(kind == "magnitude", F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
        .when(kind == "p", scores.neglog10(x))
        .when(kind == "pair", F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
        .when(kind == "pair_p", scores.neglog10(x) - scores.neglog10(y))
    )
    scored = joined.select(
        "screen_id", "gene", (raw * F.col("factor") * F.col("perturbation")).alias("harmonized"),
        (F.upper(F.trim(F.coalesce("hit", F.lit("")))) == "YES").cast("int").alias("is_hit"), "basis", "reason",
    )
    return rank_scores(scored).select("screen_id", "gene", "harmonized", "percentile", "robust_z", "is_hit", "basis", F.coalesce("reason", "note").alias("note"))


def rank_scores(scored: DataFrame) -> DataFrame:
    """``scored`` (screen_id, harmonized, ...) with note, percentile and robust_z; both null where quality fails.

    Counts, ranks and medians are windows over screens, so that rows are exchanged and sorted once. A screen has a row per
    gene and is one task's work.
    """
    screen, x = Window.partitionBy("screen_id"), F.col("harmonized")
    places = screen.orderBy(x.asc_nulls_last())
    ranked = scored.withColumns(
        {"_rank": average_rank(x, ["screen_id"]) - 1.0, "_dense": F.when(x.isNotNull(), F.dense_rank().over(places))}
    ).withColumns(
        {
            "_n": F.count(x).over(screen), "_d": F.coalesce(F.max("_dense").over(screen), F.lit(0)), "_top": F.max("_rank").over(screen),
            "_median": F.median(x).over(screen), "_deviation": F.stddev_samp(x).over(screen),
        }
    ).withColumn("_mad", F.median(F.abs(x - F.col("_median"))).over(screen))
    judged = ranked.withColumn("_q", rules.screen_quality(F.col("_n"), F.col("_d")))
    ok, scale = F.col("_q.ok"), F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_deviation"))
    return judged.withColumns(
        {
            "note": F.col("_q.note"), "percentile": F.when(ok, 2.0 * F.try_divide(F.col("_rank"), F.col("_top")) - 1.0),
            "robust_z": F.when(ok & (scale > 0), (x - F.col("_median")) / scale),
        }
    ).drop("_rank", "_dense", "_n", "_d", "_top", "_median", "_deviation", "_mad", "_q")


def panel_check(scores_: DataFrame, panel: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Per group: the mean percentile of a panel of essential genes, and whether it fails (not negative, with ``least`` rows)."""
    means = scores_.join(panel, "gene", "left_semi").groupBy(*by).agg(F.count("percentile").alias("n"), F.avg("percentile").alias("mean_percentile"))
    return means.withColumn("failed", (F.col("n") >= least) & (F.col("mean_percentile") >= 0))
