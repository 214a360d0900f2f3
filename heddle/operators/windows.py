"""Ranks, first-of-key, top-k and their kin. Every order is total if the caller's keys make it so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.fixed_values import MAD_TO_SIGMA
from heddle.storage import written

_UNITS = 2.0**53  # percentiles, which are 2 q - 1 in double precision, are multiples of its inverse


def positive_mean(value: str) -> Column:
    """Whether the mean of a group's values is above 0: an aggregate that does not depend on the order of the rows.

    Values are summed exactly, as multiples of 2**-53, which percentiles are; finer digits are rounded. Where one is not finite or
    1,000 or more in size, the mean is taken in double precision.
    """
    units = (F.col(value) * _UNITS).try_cast("decimal(19,0)")
    whole = F.count(units) == F.count(value)
    return F.when(whole, F.sum(units) > 0).otherwise(F.avg(value) > 0)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_observation(df: DataFrame, keys: list[str], hit: str, score: str, last: list[str]) -> DataFrame:
    """One row per key: hits first, then the highest score, then the order of ``last``."""
    return first_per_key(df, keys, [F.col(hit).desc(), F.col(score).desc_nulls_last(), *[F.col(c) for c in last]])


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1 within ``by``, ties sharing their mean rank; null for null.

    Ties are the peers of one ordered window, so that one exchange and one sort serve both counts.
    """
    order = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(value.isNotNull(), F.rank().over(order) + (F.count("*").over(peers) - 1) / F.lit(2.0))


def add_signed_percentile(df: DataFrame, by: list[str], value: str, out: str = "percentile") -> DataFrame:
    """Average rank from 0, divided by the largest one, on -1 to 1; null where a group has one value or none."""
    ranked = df.withColumn("_rank", average_rank(F.col(value), by) - 1.0)
    top = F.max("_rank").over(Window.partitionBy(*by))
    return ranked.withColumn(out, 2.0 * F.try_divide(F.col("_rank"), top) - 1.0).drop("_rank")


def add_rank_fraction(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Average rank divided by the number of values."""
    n = F.count(value).over(Window.partitionBy(*by))
    return df.withColumn(out, average_rank(F.col(value), by) / n)


def add_robust_z(df: DataFrame, by: list[str], value: str, out: str = "robust_z") -> DataFrame:
    """(x - median) / (1.4826 MAD); the sample deviation stands in where the MAD is 0; null where that is 0 too.

    Medians and deviations are one row per group; they are joined back, so that no group is gathered as rows.
    """
    x = F.col(value)
    medians = df.groupBy(*by).agg(F.median(x).alias("_median"), F.stddev_samp(x).alias("_deviation"))
    centred = df.join(medians, by, "left")
    mads = centred.groupBy(*by).agg(F.median(F.abs(x - F.col("_median"))).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_deviation"))
    scaled = centred.join(mads, by, "left").withColumn("_scale", scale)
    return scaled.withColumn(out, F.when(F.col("_scale") > 0, (x - F.col("_median")) / F.col("_scale"))).drop(
        "_median", "_deviation", "_mad", "_scale"
    )


def add_reciprocal(df: DataFrame, a: str, b: str, out: str = "reciprocal") -> DataFrame:
    """1 where the row (b, a) is there too."""
    swapped = df.select(F.col(b).alias(a), F.col(a).alias(b)).distinct().withColumn("_there", F.lit(1))
    return df.join(swapped, [a, b], "left").withColumn(out, F.coalesce("_there", F.lit(0))).drop("_there")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Counts per bin (from 1) of equal width, the upper end belonging to the last one; empty bins have 0."""
    inside = df.filter(F.col(value).between(low, high))
    place = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1, F.lit(bins))
    counts = inside.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    groups = inside.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def focal_rank(df: DataFrame, by: list[str], value: str, focal: str) -> DataFrame:
    """Per group the share of values below a focal one, ties counting half."""
    v, f = F.col(value), F.col(focal)
    return df.groupBy(*by).agg(((F.count_if(v < f) + 0.5 * F.count_if(v == f)) / F.count(v)).alias("focal_rank"))


def add_background_z(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """z against mean and population deviation of the whole group; to be filtered afterwards."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def add_running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows up to this one in ``order``, peers included.

    Rows are dealt into ranges of ``order``; the totals of ranges, one row each, are added up first, so that no
    task holds all rows.
    """
    placed = _ranges(df, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order))
    return placed.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + inside).drop("_range", "_start")


def add_least_from(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``out``: the least ``value`` of all rows from this one on in ``order``; by ranges, as in ``add_running_total``."""
    placed = _ranges(df, order)
    after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    least = placed.groupBy("_range").agg(F.min(value).alias("_min"))
    ends = least.select("_range", F.min("_min").over(after).alias("_end"))
    inside = F.min(value).over(Window.partitionBy("_range").orderBy(F.desc(order)))
    return placed.join(F.broadcast(ends), "_range").withColumn(out, F.least(inside, F.col("_end"))).drop("_range", "_end")


def _ranges(df: DataFrame, order: str) -> DataFrame:
    """``df`` with the number of the range of ``order`` that each row is in: as many as partitions. Equal values share one."""
    return written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")


def bh_threshold(df: DataFrame, p: str, tested: int | Column, alpha: float) -> DataFrame:
    """One row, threshold: the largest p of rank k with p <= k / tested x alpha, or 0 (Benjamini and Hochberg).

    The rank of a p-value is counted from totals per value, over ranges of values.
    """
    return bh_threshold_of(value_ranks(df, p), tested, alpha)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Per different value (p): its rows (n) and its rank (k), the number of rows up to it."""
    counts = df.groupBy(F.col(value).alias("p")).agg(F.count("*").alias("n"))
    return add_running_total(counts, "p", "n", "k")


def bh_threshold_of(ranks: DataFrame, tested: int | Column, alpha: float) -> DataFrame:
    """``bh_threshold`` from the rows of ``value_ranks``."""
    tested = F.lit(tested) if isinstance(tested, int) else tested
    return ranks.agg(F.coalesce(F.max(F.when(F.col("p") <= F.col("k") / tested * alpha, F.col("p"))), F.lit(0.0)).alias("threshold"))


def fdr_sweep(real: DataFrame, null: DataFrame, value: str, start: float, stop: float, step: float, fdr: float) -> DataFrame:
    """One row, threshold: the first t from ``start`` with null(t) / real(t) <= ``fdr``; ``stop`` if there is none.

    Values are counted per step first: the steps, not the values, are sorted.
    """
    steps = round((stop - start) / step)

    def counts(df: DataFrame, name: str) -> DataFrame:
        place = F.least(F.floor((F.col(value) - start) / step + 1e-9).cast("int"), F.lit(steps))
        return df.filter(F.col(value) >= start).groupBy(place.alias("step")).agg(F.count("*").alias(name))

    above = Window.orderBy(F.desc("step"))
    grid = real.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    table = grid.join(counts(real, "r"), "step", "left").join(counts(null, "n"), "step", "left")
    summed = table.select("step", F.coalesce(F.sum("r").over(above), F.lit(0)).alias("r"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))
    good = (F.col("step") < steps) & (F.col("r") >= 1) & (F.col("n") <= fdr * F.col("r"))
    return summed.agg(F.round(F.coalesce(F.min(F.when(good, start + F.col("step") * step)), F.lit(stop)), 3).alias("threshold"))


def sum_layers(df: DataFrame, by: list[str], layer: str, node: str, weight: str) -> DataFrame:
    """Weights scaled by the largest of their layer, summed per node, with the layers that a node is in."""
    top = F.max(weight).over(Window.partitionBy(*by, layer))
    scaled = df.withColumn("_w", F.try_divide(F.col(weight), top))
    return scaled.groupBy(*by, node).agg(F.sum("_w").alias("weight"), F.array_sort(F.collect_set(layer)).alias("layers"))


def flip_by_anchor(df: DataFrame, by: list[str], member: str, panel: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Negates the values of groups in which a panel, that must be negative, has a positive mean over ``least`` members.

    ``panel`` has the column ``member`` and is broadcast by Spark where small. The mean's sign does not depend on the order of its values (``positive_mean``).
    """
    means = df.join(panel, member, "left_semi").groupBy(*by).agg(positive_mean(value).alias("_positive"), F.count(value).alias("_n"))
    flipped = F.coalesce((F.col("_n") >= least) & F.col("_positive"), F.lit(False))
    return (
        df.join(means, by, "left")
        .withColumn("flipped", flipped)
        .withColumn(value, F.when(flipped, -F.col(value)).otherwise(F.col(value)))
        .drop("_positive", "_n")
    )


def auroc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve from rank sums with average ranks; null where a class is missing. ``label`` is 0 or 1."""
    ranked = df.withColumn("_rank", average_rank(F.col(score), by))
    p, n = F.sum(label), F.count("*") - F.sum(label)
    area = F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_rank"))) - p * (p + 1) / 2, p * n)
    return ranked.groupBy(*by).agg(area.alias("auroc")) if by else ranked.agg(area.alias("auroc"))
