"""Gene networks from screens: co-essentiality and co-hits.

Matrices stay in long form. After imputing a gene's missing values with its own mean and centring, they are
exactly 0, so that products run over measured values only. The leading components, which would fill the
matrix, are kept as two factor tables u and v: the product of two cleaned rows is the product of the sparse
rows minus, per component, the product of their entries in u.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from heddle.operators.graph import both_ways
from heddle.operators.pairwise import Factor, PairBlock, PairRows, best_partners, cohit_tally, count_pairs, first_cohits, present
from heddle.operators.windows import add_least_from, add_reciprocal, add_running_total, bh_threshold_of, fdr_sweep, top_k
from heddle.storage import rewritten, written

COLUMNS, MOST_COLUMNS, KEPT_COLUMNS = 2, 60, 20  # vectors that a round adds to the basis, how many it has before it is begun anew, and with how many
WHOLE_SCREENS = 1024  # up to so many screens the matrix of all their pairs is made, which is then 8 MB or less
GRAM_CELLS = 1 << 20  # measured values of a part of it, about
MOST_ROUNDS = 1000  # copies of a table have its largest eigenvalues that often, so that a wide block is no help and a deep basis is


def network_genes(observations: DataFrame, hit_min: int = 5, min_coverage: float = 0.5, min_hit_rate: float = 0.02, min_screens: int = 15) -> DataFrame:
    """Genes that are hits often enough, measured in enough screens, and not less often hits than by chance."""
    rows = observations.filter("percentile is not null")
    screens = rows.agg(F.count_distinct("screen_id").alias("screens"))
    genes = rows.groupBy("gene").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).join(F.broadcast(screens))
    enough = (F.col("n") >= min_screens) & (F.col("hits") >= hit_min) & (F.col("n") >= min_coverage * F.col("screens"))
    return genes.filter(enough & (F.col("hits") >= min_hit_rate * F.col("n"))).select("gene")


def centred(observations: DataFrame) -> DataFrame:
    """Rows (gene, screen_id, x): the percentile minus the gene's mean over the screens that measured it."""
    rows = observations.filter("percentile is not null")
    means = rows.groupBy("gene").agg(F.avg("percentile").alias("mean"))
    return rows.join(means, "gene").select("gene", "screen_id", (F.col("percentile") - F.col("mean")).alias("x"))


def leading_components(x: DataFrame, count: int = 1, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """The ``count`` leading right singular vectors: v per screen, and su (s times u) per gene, as arrays.

    Of few screens (``WHOLE_SCREENS``) the products of all pairs are summed over genes, and their eigenvectors taken: noise, as in null models,
    has no gap for an iteration to use. Else block Krylov iteration: a basis of screens' vectors grows by the residuals of its best approximations, several at a time, and is
    begun anew from the best of it when it gets large. It ends when each wanted vector's residual is ``tolerance`` of the largest
    eigenvalue or less; a basis that cannot grow holds them. Each round is two aggregations over the measured values; the basis has a row per screen
    and is stored after each, in place of the one before. What reaches the driver is one small matrix per partition of it. Starts jobs while the plan is built.
    """
    def applied(r: DataFrame, width: int) -> DataFrame:
        """r (screen_id, new) with the products of its vectors and the matrix of all pairs of screens."""
        part = lambda c, k: F.sum(F.col("x") * F.get(c, F.lit(k)))
        u = x.join(r.select("screen_id", "new"), "screen_id").groupBy("gene").agg(F.array(*[part("new", k) for k in range(width)]).alias("u"))
        return x.join(u, "gene").groupBy("screen_id").agg(F.array(*[part("u", k) for k in range(width)]).alias("image"))

    def matrices(basis: DataFrame, size: int) -> np.ndarray:
        """The products of vectors with vectors, vectors with images, and images with images."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((3, size, size))
            for frame in frames:
                q, a = _stacked(frame)
                total += np.stack([q.T @ q, q.T @ a, a.T @ a])
            yield pd.DataFrame({"m": [total.ravel()]})

        found = basis.select("q", "a").mapInPandas(run, "m array<double>").collect()
        return sum((np.array(row.m).reshape(3, size, size) for row in found), np.zeros((3, size, size)))

    kind = x.schema["screen_id"].dataType.simpleString()
    cells = x.agg(F.count("*").alias("n"), F.approx_count_distinct("screen_id").alias("screens")).first()
    if cells["screens"] <= WHOLE_SCREENS * 3 // 4 and x.select("screen_id").distinct().count() <= WHOLE_SCREENS:
        v = _whole_components(x, count, cells["n"])
        return v, _along_components(x, v, min(count, len((v.first() or {"v": []})["v"])))
    hashed = [(F.pmod(F.xxhash64(F.lit(k), "screen_id"), F.lit(1009)) - 504).cast("double") for k in range(1, COLUMNS + count - 1)]
    start = x.groupBy("screen_id").agg((F.sum("x") + F.lit(1e-9)).alias("s")).select("screen_id", F.array("s", *hashed).alias("new"))
    start = written(start, "start")
    width = len(hashed) + 1
    basis = written(start.join(applied(start, width), "screen_id").select("screen_id", F.col("new").alias("q"), F.col("image").alias("a")), "basis")
    size, before = width, None
    for _ in range(MOST_ROUNDS):
        gram, product, images = matrices(basis, size)
        values, ritz = _ritz(gram, product)
        wanted = min(count, len(values))
        if not wanted:
            break
        best = slice(0, min(width, len(values)))
        y, top = ritz[:, best], values[best]
        squares = np.sum(y * (images @ y - (product + product.T) @ y * top + gram @ y * top**2), axis=0)
        open_ = np.sqrt(np.maximum(squares, 0)) > tolerance * values[0]
        state = (len(values), *np.round(values[:wanted], 12))
        if not open_[:wanted].any() or state == before:
            break
        before = state
        kept = ritz[:, : max(width + 1, KEPT_COLUMNS)] if size + width > MOST_COLUMNS else ritz
        lengths = np.sqrt(squares[open_])

        def grown(frames: Iterator[pd.DataFrame], kept=kept, y=y[:, open_], top=top[open_], lengths=lengths) -> Iterator[pd.DataFrame]:
            for frame in frames:
                q, a = _stacked(frame)
                new = (a @ y - (q @ y) * top) / lengths
                yield pd.DataFrame({"screen_id": frame["screen_id"], "q": [*(q @ kept)], "a": [*(a @ kept)], "new": [*new]})

        more = basis.mapInPandas(grown, f"screen_id {kind}, q array<double>, a array<double>, new array<double>")
        added = int(open_.sum())
        joined = more.join(applied(more, added), "screen_id")
        basis = rewritten(basis, joined.select("screen_id", F.concat("q", "new").alias("q"), F.concat("a", "image").alias("a")), "basis")
        size = kept.shape[1] + added
    else:
        raise RuntimeError(f"no convergence to {tolerance} in {MOST_ROUNDS} rounds")
    mix = ritz[:, :count] if len(values) else np.zeros((size, 0))
    v = basis.select("screen_id", F.array(*[sum((F.get("q", F.lit(k)) * float(mix[k, c]) for k in range(size)), F.lit(0.0)) for c in range(mix.shape[1])]).cast("array<double>").alias("v"))
    v = written(v, "component")
    return v, _along_components(x, v, mix.shape[1])


def _along_components(x: DataFrame, v: DataFrame, count: int) -> DataFrame:
    sums = [F.sum(F.col("x") * F.get("v", F.lit(c))) for c in range(count)]
    return x.join(v, "screen_id").groupBy("gene").agg(F.array(*sums).cast("array<double>").alias("su"))


def _whole_components(x: DataFrame, count: int, cells: int) -> DataFrame:
    """The leading right singular vectors of a table of few screens, from the products of all pairs of them; parts of it are made by blocks of genes."""
    places = written(x.select("screen_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("screen_id")) - 1), "places")
    screens = places.count()
    blocks = max(1, -(-cells // GRAM_CELLS))

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        row, place, value = np.unique(frame["gene"].to_numpy(), return_inverse=True)[1], frame["place"].to_numpy(), frame["x"].to_numpy(float)
        order = np.argsort(row, kind="stable")
        row, place, value = row[order], place[order], value[order]
        total = np.zeros((screens, screens))
        for start in range(0, int(row[-1]) + 1, 1024):
            here = slice(*np.searchsorted(row, [start, start + 1024]))
            tile = np.bincount((row[here] - start) * screens + place[here], value[here], 1024 * screens).reshape(1024, screens)
            total += tile.T @ tile
        return pd.DataFrame({"place": np.arange(screens), "products": [*total]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": frame["place"].iloc[:1], "products": [np.sum([*frame["products"]], axis=0)]})

    placed = x.join(F.broadcast(places), "screen_id").select("gene", "place", "x", F.pmod(F.xxhash64("gene"), F.lit(blocks)).alias("block"))
    schema = "place int, products array<double>"
    found = placed.groupBy("block").applyInPandas(part, schema).groupBy("place").applyInPandas(summed, schema).toPandas().sort_values("place")
    gram = np.stack([*found["products"]]) if len(found) else np.zeros((0, 0))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    real = min(count, int(np.sum(values > 1e-14 * max(values.max(initial=0), 1e-300))))
    v = vectors[:, ::-1][:, :real]
    rows = x.sparkSession.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "place int, v array<double>")
    return written(places.join(rows, "place").select("screen_id", "v"), "component")


def _stacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([*frame["q"]]), np.stack([*frame["a"]])


def _ritz(gram: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best approximations that a basis holds, largest first: eigenvalues, and each one's share of the basis' vectors."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    lengths, axes = np.linalg.eigh(gram * np.outer(scale, scale))
    real = lengths > 1e-10
    to = scale[:, None] * axes[:, real] / np.sqrt(lengths[real])
    inside = to.T @ ((product + product.T) / 2) @ to
    values, turns = np.linalg.eigh(inside)
    order = np.argsort(-values)
    order = order[values[order] > 1e-14 * max(values.max(initial=0), 1e-300)]
    return values[order], to @ turns[:, order]


def leading_component(x: DataFrame, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """The leading right singular vector of rows (gene, screen_id, x): v per screen, and su (s times u) per gene."""
    v, su = leading_components(x, 1, tolerance)
    return v.withColumn("v", F.coalesce(F.get("v", F.lit(0)), F.lit(0.0))), su.withColumn("su", F.coalesce(F.get("su", F.lit(0)), F.lit(0.0)))


def _value(x: np.ndarray, *v: np.ndarray) -> np.ndarray:
    return x


def _square_of(x: np.ndarray, *v: np.ndarray) -> np.ndarray:
    return x * x


def _along(k: int) -> Factor:
    return lambda x, *v: x * v[k]


def similar_profiles(x: DataFrame, k: int, min_r: float, min_support: int = 0, components: DataFrame | None = None, count: int = 1, digits: int | None = None, **sizes: int) -> DataFrame:
    """Each gene's ``k`` most alike genes (a, b, r, rank, and support where a least one is asked for) by the cosine of their centred rows.

    With ``components`` (screen_id, v: array of ``count``), of their rows without these components. The best are taken inside each pair of blocks.
    Genes need a common screen, and r must be ``min_r``, above 0, or more.
    """
    columns = [f"v{c}" for c in range(count)] if components is not None else []
    if components is not None:
        x = x.join(components.select("screen_id", *[F.get("v", F.lit(c)).alias(f"v{c}") for c in range(count)]), "screen_id")
    counted = min_support > 0 or components is not None
    sums = {"dot": (_value, _value)} | ({"n": (present, present)} if counted else {})
    totals = {"square": _square_of} | {c: _along(k) for k, c in enumerate(columns)}

    def rows(held: PairBlock, side: int) -> np.ndarray:
        along = [held.total(side, c) for c in columns]
        of = held.total(side, "square") - sum((u * u for u in along), 0.0)
        scale = np.where(of > 1e-12, 1 / np.sqrt(np.maximum(of, 1e-12)), 0.0)
        return np.column_stack([held.cells(side, _value), *(u if side else -u for u in along)]) * scale[:, None]

    def strength(held: PairBlock | PairRows) -> np.ndarray:
        along = [[held.total(side, c) for c in columns] for side in (0, 1)]
        left, right = (held.total(side, "square") - sum((u * u for u in along[side]), 0.0) for side in (0, 1))
        r = held.sum("dot")
        for u, v in zip(*along):
            r = r - held.product(u, v)
        with np.errstate(divide="ignore", invalid="ignore"):
            return r * held.product(*(np.where(of > 1e-12, 1 / np.sqrt(of), np.nan) for of in (left, right)))

    least = max(min_support, 1) if counted else 0
    if least > 1:  # no pair of a gene of fewer screens has the support
        x = x.join(x.groupBy("gene").agg(F.count("x").alias("_n")).filter(F.col("_n") >= least).select("gene"), "gene", "left_semi")
    return best_partners(x, "gene", "screen_id", ["x", *columns], sums, totals, strength, k, "n" if counted else None, digits, min_r, least, rows=rows, **sizes)


def mutual_top(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (a < b) that one of the two has among its ``k`` strongest, with reciprocal = 1 where both have."""
    both = both_ways(pairs)
    best = add_reciprocal(top_k(both, ["a"], [F.desc("r"), F.col("b")], k), "a", "b")
    turned = best.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).drop("rank")
    return turned.dropDuplicates(["a", "b"])


def mutual(best: DataFrame) -> DataFrame:
    """Pairs (a < b) of directed rows (a, b) of best partners, with reciprocal = 1 where both directions are there."""
    both = add_reciprocal(best.drop("rank"), "a", "b")
    return both.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["a", "b"])


def _permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each place of n moved by a permutation of 0 to n - 1 that the key chooses: a Feistel network over pairs, walked until it lands within."""
    wide = np.ceil(np.sqrt(n)).astype(np.int64)
    high = -(-n // wide)
    out, walking = place.astype(np.int64), np.arange(len(place))
    while len(walking):
        w, h, k = wide[walking], high[walking], key[walking]
        left, right = np.divmod(out[walking], w)
        for step in range(_FEISTEL):
            if step % 2:
                right = (right + (_scrambled(left, k, step) % w.view(np.uint64)).view(np.int64)) % w
            else:
                left = (left + (_scrambled(right, k, step) % h.view(np.uint64)).view(np.int64)) % h
        out[walking] = left * w + right
        walking = walking[out[walking] >= n[walking]]
    return out


_FEISTEL = 6  # rounds


def _scrambled(value: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """64 bits of a value under a key, by the finishing steps of SplitMix64."""
    h = value.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(step + 1) ^ key.view(np.uint64)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@pandas_udf(T.LongType())
def permuted(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(_permuted(*(c.to_numpy(np.int64) for c in (place, n, key))))


def numbered(observations: DataFrame) -> DataFrame:
    """Observations with their place among the genes of their screen (from 0) and how many these are: sorted once for all null models."""
    of = Window.partitionBy("screen_id")
    rows = observations.withColumns({"place": F.row_number().over(of.orderBy("gene")) - 1, "of": F.count("*").over(of)})
    return written(rows.withColumns({"place": F.col("place").cast("long")}), "numbered")


def shuffled(placed: DataFrame, seed: int = 0) -> DataFrame:
    """Percentiles dealt anew among the genes of their screen: the null model, from ``numbered`` rows. Nothing is sorted."""
    key = F.xxhash64(F.lit(seed), "screen_id")
    values = placed.select("screen_id", "percentile", permuted("place", "of", key).alias("place"))
    return placed.drop("percentile", "of").join(values, ["screen_id", "place"]).drop("place")


def coessential_network(
    observations: DataFrame, context: str = "all", hit_min: int = 5, min_coverage: float = 0.5, min_hit_rate: float = 0.02, min_screens: int = 15,
    min_support: int = 20, min_corr: float = 0.15, k: int = 25, fdr: float = 0.05, remove_leading: bool = True, nulls: int = 1,
) -> DataFrame:
    """Edges (a, b, context, channel, strength, support, reciprocal) of genes with alike profiles.

    ``observations``: screen_id, gene, percentile, hit, one row per gene and screen. The threshold is the first at which mutual-best pairs
    of shuffled screens, the mean of ``nulls`` shuffles, are at most ``fdr`` of the real ones.
    """
    nodes = network_genes(observations, hit_min, min_coverage, min_hit_rate, min_screens)
    rows = observations.filter("percentile is not null").join(nodes, "gene", "left_semi").select("screen_id", "gene", "percentile")
    rows = written(rows, "network")  # read by each mean, and again for null models

    def best(of: DataFrame) -> DataFrame:
        x = written(centred(of), "centred")
        v = leading_components(x)[0] if remove_leading else None
        v = v.withColumn("v", F.array(F.coalesce(F.get("v", F.lit(0)), F.lit(0.0)))) if v is not None else None
        partners = written(similar_profiles(x, k, min_corr, max(min_support, 1), v, digits=9), "partners")  # at most k rows per gene, which meet themselves
        return written(mutual(partners), "best")

    real, placed = best(rows), numbered(rows)
    null = [best(shuffled(placed, seed)).filter("reciprocal = 1").select("r") for seed in range(nulls)]
    for more in null[1:]:
        null[0] = null[0].unionByName(more)
    limit = fdr_sweep(real.filter("reciprocal = 1"), null[0], "r", min_corr, 0.90, 0.005, fdr * nulls)
    return real.join(F.broadcast(limit)).filter(F.col("r") >= F.col("threshold")).select(
        "a", "b", F.lit(context).alias("context"), F.lit("coessential").alias("channel"), F.round("r", 4).alias("strength"), "support", "reciprocal"
    )


def profile_neighbours(observations: DataFrame, min_r: float = 0.25, top: int = 14, share: float = 0.11, least: int = 30) -> DataFrame:
    """Each gene's ``top`` most alike genes (gene, neighbour, r, rank), among genes that enough screens measured."""
    rows = observations.filter("percentile is not null")
    screens = rows.agg(F.count_distinct("screen_id").alias("screens"))
    counts = rows.groupBy("gene").agg(F.count("*").alias("n")).join(F.broadcast(screens))
    kept = counts.filter(F.col("n") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("screens")))).select("gene")
    best = similar_profiles(centred(rows.join(kept, "gene", "left_semi")), top, min_r)
    return best.withColumnsRenamed({"a": "gene", "b": "neighbour"}).select("gene", "neighbour", "r", "rank")


def cohit_network(observations: DataFrame, tested: int | None = None, min_cohit: int = 3, min_screens: int = 1, k: int = 25, alpha: float = 0.05) -> DataFrame:
    """Co-hit edges (a < b) that pass the Benjamini-Hochberg threshold and are among one gene's ``k`` most significant.

    ``tested``: the number of ordered pairs counted as tests; by default all pairs of genes measured together, a
    gene with itself included. q_ref is min(1, p x tested / candidates); q_bh the monotone adjusted p-value.

    Pairs are measured twice: once to count tests and p-values, and once, with the threshold known, for each gene's best partners that pass it. No
    pair becomes a row but these: the threshold, at which rank / tested x ``alpha`` is reached, is ``alpha`` or less, and an adjusted
    p-value that passes it depends on p-values that do, as larger ones are adjusted to more than ``alpha``.
    """
    columns = (observations, "gene", "screen_id", "percentile", "hit")
    measured, found, tally = cohit_tally(*columns, min_cohit, min_screens, alpha)
    tally = written(tally, "tally")
    if tested is None:
        rows = observations.filter("percentile is not null")
        tested = 2 * measured + rows.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_screens).count()
    ranks = add_running_total(tally.select("p", (2 * F.col("times")).alias("n")), "p", "n", "k")
    threshold = bh_threshold_of(ranks, tested, alpha).first()["threshold"]
    fewest = tally.filter(F.col("p") <= threshold).agg(F.min("fewest")).first()[0]  # no pair with fewer common hits passes
    best = written(first_cohits(*columns, max(min_cohit, fewest or 0), min_screens, threshold, k), "best").withColumn("candidates", F.lit(2 * found))
    edges = add_reciprocal(best, "a", "b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["a", "b"])
    steps = ranks.filter(F.col("p") <= threshold).withColumn("q", F.least(F.lit(1.0), F.col("p") * tested / F.col("k")))
    adjusted = add_least_from(steps, "p", "q", "q_bh")
    return edges.join(adjusted.select("p", "q_bh"), "p").select(
        "a", "b", "cohit", F.round("expected", 3).alias("expected"), F.round("fold", 3).alias("fold"), "p",
        F.least(F.lit(1.0), F.col("p") * tested / F.col("candidates")).alias("q_ref"), "q_bh", F.col("n").alias("support"),
        F.round("concordance", 3).alias("concordance"), "reciprocal",
    )


def measured_pairs(observations: DataFrame, min_screens: int = 1) -> int:
    """The number of ordered pairs of genes that some screen measured both of, each gene with itself included."""
    rows = observations.filter("percentile is not null").select("gene", "screen_id").distinct()
    kept = rows.join(rows.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_screens), "gene", "left_semi")
    return 2 * count_pairs(kept, "gene", "screen_id") + kept.select("gene").distinct().count()


def complex_precision(edges: DataFrame, complexes: DataFrame) -> DataFrame:
    """Per tier of evidence: the share of edges whose ends are in a common complex, among edges with both ends in one.

    ``complexes``: complex_id, gene. ``edges`` has a tier.
    """
    members = complexes.select("gene").distinct()
    evaluable = edges.join(members.withColumnRenamed("gene", "a"), "a", "left_semi").join(members.withColumnRenamed("gene", "b"), "b", "left_semi")
    together = evaluable.join(complexes.withColumnRenamed("gene", "a"), "a").join(complexes.withColumnRenamed("gene", "b"), ["complex_id", "b"]).select("a", "b").distinct()
    marked = evaluable.join(together.withColumn("_true", F.lit(1)), ["a", "b"], "left")
    return marked.groupBy("tier").agg(F.count("*").alias("n"), F.avg(F.coalesce("_true", F.lit(0))).alias("precision"))
