"""Exact top-k search by inner product as a Voronoi join.

Pivots, from a bounded sample, cut the space into cells; a vector belongs to the nearest one. A cell's
summary holds its size, its radius around the pivot and its largest norm, for all its rows and for its queries.
A cell's queries are a group. From the summaries alone follows a score that the k best of every query of a group
reach: no product of a query within s of pivot q and a row within r of pivot p is less than
q.p - |q| r - s |p| - s r, nor more than q.p + |q| r + s |p| + s r; cells whose most is less are not searched.
Each query first searches its home cell; its k-th best score there, if higher, is a sharper bound for that query.
Of a cell, a group gets those rows that some query of it needs, and solves there: a row d from pivot p gives a query q no more than
q.p + |q| d, nor more than |q| times its own norm, so that each query asks for a least distance and a least norm. Groups of
neighbouring cells are put together up to a block.

Cells and groups of queries are split by hash into blocks of bounded size, so that a cell with a third of
all rows is many blocks. Rows alike in id and vector are one row with a count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.llm.common import numbered, table, written

PIVOTS, MOST_PIVOTS = 32, 1024  # an eighth of the square root of the number of rows, within these
SAMPLE_PER_PIVOT = 16  # about so many vectors, chosen by a hash of ids and vectors, place the pivots; 2,048 or more
ROUNDS = 5
BLOCK_ROWS = 4096  # rows of a cell, and queries of a group, in one block

#: Longest products whose sums are exact in doubles, and scores that leave room for a place in their key.
_EXACT, _KEYED = 2.0**53, 2**46


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as longs; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def choose_pivots(rows: int) -> int:
    """How many pivots so many rows have."""
    return min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows) // 8))


def _pivots(vectors: DataFrame, n: int, rows: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: rounds of k-means over a bounded sample, from evenly spaced members."""
    sample = max(2048, SAMPLE_PER_PIVOT * n)
    bound = math.ceil(min(1.0, sample / max(rows, 1)) * (1 << 30))
    of_hash = vectors.filter(F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.lit(1 << 30)) < bound)
    chosen = of_hash.select("v").limit(2 * sample).collect()
    by_dim: dict[int, list] = {}
    for row in chosen:
        by_dim.setdefault(len(row.v), []).append(row.v)
    pivots = {}
    for dim, rows in by_dim.items():
        points = np.unique(np.array(rows, float).reshape(-1, dim), axis=0)
        centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
        for _ in range(ROUNDS):
            near = _nearest(points, centres)[0]
            centres = np.array([points[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
        pivots[dim] = centres
    return pivots


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the distance to it (computed from differences, as a safe radius must be)."""
    near = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1))


def _assign(frames: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        dims = frame["v"].map(len).to_numpy()
        cell, distance, norm = np.zeros(len(frame), np.int32), np.zeros(len(frame)), np.zeros(len(frame))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            points = np.array(frame["v"].iloc[at].tolist(), float).reshape(-1, dim)
            cell[at], distance[at] = _nearest(points, pivots.get(int(dim), np.zeros((1, dim))))
            norm[at] = np.sqrt((points**2).sum(axis=1))
        yield frame.assign(dim=dims.astype(np.int32), cell=cell, distance=distance, norm=norm)


class _Cells:
    """Summaries of the cells of one length of vectors, with what each group of queries has to search."""

    def __init__(self, summaries: list, pivots: np.ndarray, k: int, rows_per_id: int, block_rows: int):
        self.cells = np.array([s.cell for s in summaries], np.int32)
        self.pivots = pivots[self.cells]
        self.subs = np.array([-(-s.n // block_rows) for s in summaries], np.int32)
        self.radius, self.norm = (np.array([s[c] for s in summaries], float) for c in ("radius", "norm"))
        counts = np.array([s.n for s in summaries])
        spread = np.array([s.query_radius or 0.0 for s in summaries])
        sizes = np.sqrt((self.pivots**2).sum(axis=1))
        product = self.pivots @ self.pivots.T
        margin = sizes[:, None] * self.radius + spread[:, None] * sizes + spread[:, None] * self.radius
        slack = 0.5 + 1e-9 * (sizes[:, None] + spread[:, None]) * (sizes + self.radius)
        #: A score that the k-th best of each query of a group reaches, its own rows left out.
        self.floors = np.full(len(summaries), -np.inf)
        for group, least in enumerate(product - margin - slack):
            order = np.argsort(-least, kind="stable")
            enough = np.searchsorted(np.cumsum(counts[order]), k + rows_per_id)
            if enough < len(order):
                self.floors[group] = least[order[enough]]
        #: By group and cell: whether the summaries leave the cell to be searched.
        self.reach = product + margin + slack >= self.floors[:, None]

    def _bounds(self, points: np.ndarray, own: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, ...]:
        """The group and norm of each query, and by query and cell the least bound that a row has to have, with its slack."""
        group = np.searchsorted(self.cells, own)
        norms = np.sqrt((points**2).sum(axis=1))
        slack = 0.5 + 1e-9 * norms[:, None] * (self.radius + self.norm)
        return group, norms[:, None], np.fmax(floors, self.floors[group])[:, None] - slack

    def needed(self, points: np.ndarray, own: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """By query and cell: whether the query has to search the cell, its own one excepted."""
        group, norms, lowest = self._bounds(points, own, floors)
        most = np.minimum(points @ self.pivots.T + norms * self.radius, norms * self.norm)
        return self.reach[group] & (most >= lowest) & (self.cells != own[:, None])

    def least(self, points: np.ndarray, own: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query and cell: the least distance from the pivot and the least norm of a row that the query needs."""
        _, norms, lowest = self._bounds(points, own, floors)
        with np.errstate(divide="ignore", invalid="ignore"):
            far, large = (lowest - points @ self.pivots.T) / norms, lowest / norms
        return np.where(norms > 0, far, -np.inf), np.where(norms > 0, large, -np.inf)


def _query_groups(summaries: list, pivots: dict[int, np.ndarray], block_rows: int) -> dict[tuple[int, int], int]:
    """The group of each cell's queries: neighbouring cells, along the pivots' main direction, up to ``block_rows`` queries.

    Each group gets its own copy of the rows it needs, so that there should be no more groups than blocks of queries.
    """
    groups: dict[tuple[int, int], int] = {}
    for dim in {s.dim for s in summaries}:
        own = [s for s in summaries if s.dim == dim]
        points = np.array([pivots[dim][s.cell] if dim in pivots else np.zeros(dim) for s in own]).reshape(len(own), dim)
        centred = points - points.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if dim else np.zeros(len(own))
        before = 0
        for k in np.argsort(along, kind="stable"):
            groups[dim, own[k].cell] = before // block_rows
            before += own[k].queries
    return groups


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    if most < _EXACT:
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    return queries @ data.T


def best_of_block(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of a block: by score, then smaller id; rows with its own id don't count."""
    data = data.sort_values("id")
    ids = data["id"].to_numpy()
    dim = len(data["v"].iloc[0])
    vectors = np.array(data["v"].tolist(), np.int64).reshape(-1, dim)
    n, out = len(ids), []
    tile = max(1, (1 << 21) // n)
    for a in range(0, len(queries), tile):
        part = queries.iloc[a : a + tile]
        scores = _scores(np.array(part["qv"].tolist(), np.int64).reshape(-1, dim), vectors)
        own = part["query_id"].to_numpy()[:, None] == ids[None, :]
        if np.abs(scores).max() < _KEYED:
            # own rows come last: the least long that can be negated, as that of int64.min is itself
            keys = np.where(own, np.iinfo(np.int64).min + 1, scores * n + (n - 1 - np.arange(n)))
            top = np.argpartition(-keys, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), keys.shape)
        else:
            top = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, own), axis=1)[:, :k]
        row = np.repeat(np.arange(len(part)), top.shape[1])
        col = top.ravel()
        real = ~own[row, col]
        row, col = row[real], col[real]
        out.append(
            pd.DataFrame(
                {
                    "query_id": part["query_id"].to_numpy()[row],
                    "qhash": part["qhash"].to_numpy()[row],
                    "vec_id": ids[col],
                    "score": scores[row, col],
                    "copies": data["copies"].to_numpy()[col],
                }
            )
        )
    return pd.concat(out)


_BLOCK = ["dim", "cell", "sub", "group"]
_RESULT = {"query_id": "long", "qhash": "long", "vec_id": "long", "score": "long", "copies": "long"}


def _sent(targets: DataFrame, data: DataFrame) -> DataFrame:
    """The rows of ``data`` that the groups of ``targets`` need, with the block that each goes to."""
    needed = targets.groupBy(*_BLOCK).agg(F.min("far").alias("far"), F.min("large").alias("large"))
    held = data.select("id", "v", "copies", "dim", "cell", "sub", "distance", "norm").join(needed, ["dim", "cell", "sub"])
    held = held.filter("distance >= far and norm >= large")
    return held.select("id", "v", "copies", *(F.col(c).alias(f"to_{c}") for c in _BLOCK))  # fresh names: both sides of the cogroup come from one table


def _solve(targets: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Local results of queries (with the block each is to search) in ``data``, whose rows go where a group needs them."""
    sent = _sent(targets, data)

    def solve(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: [] for c in _RESULT})
        return best_of_block(queries, rows, k)

    cogrouped = targets.groupBy(*_BLOCK).cogroup(sent.groupBy(*(f"to_{c}" for c in _BLOCK)))
    return cogrouped.applyInPandas(solve, ", ".join(f"{c} {t}" for c, t in _RESULT.items()))


def search(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    n_pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each row whose id ``is_query``.

    Components x count as floor(``scale`` * x). Candidates are all rows but those with the query's own id; ties
    go to the smaller id; a query with fewer candidates has all of them.

    Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id. Vectors meet only others of their length. A repeated row is a candidate as often as it
    comes; a repeated query is answered once, one id with several vectors once for each. Scores must fit a long.
    Other columns are ignored; without queries there are no rows.
    """
    places = {c: f"_{vectors.columns.index(c)}" for c in (id_col, vector_col)}
    known = numbered(vectors).select(F.col(places[id_col]).cast("long").alias("id"), quantise(F.col(places[vector_col]), scale).alias("v"))
    known = known.filter("id is not null and v is not null").groupBy("id", "v").agg(F.count("*").alias("copies"))
    known = written(known.withColumn("is_query", F.coalesce(is_query(F.col("id")), F.lit(False))), "vectors")
    rows = known.count()
    rows_per_id = known.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    pivots = _pivots(known, n_pivots or choose_pivots(rows), rows)
    fields = [*known.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("dim", "cell")), *(T.StructField(c, T.DoubleType()) for c in ("distance", "norm"))]
    assigned = written(known.mapInPandas(lambda frames: _assign(frames, pivots), T.StructType(fields)), "cells")
    # One row per dimension and pivot: no more than pivots for each length of vectors.
    summaries = (
        assigned.groupBy("dim", "cell")
        .agg(
            F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.max("distance").alias("radius"), F.max("norm").alias("norm"),
            F.max(F.when(F.col("is_query"), F.col("distance"))).alias("query_radius"),
        )
        .orderBy("dim", "cell")
        .collect()
    )
    by_dim = {
        dim: _Cells([s for s in summaries if s.dim == dim], pivots.get(dim, np.zeros((1, dim))), k, rows_per_id, block_rows) for dim in {s.dim for s in summaries}
    }
    parties = _query_groups(summaries, pivots, block_rows)
    schema = "dim int, cell int, subs int, party int, groups int"
    splits = [(s.dim, s.cell, -(-s.n // block_rows), parties[s.dim, s.cell], max(1, -(-s.queries // block_rows))) for s in summaries]
    splits = F.broadcast(assigned.sparkSession.createDataFrame(splits, schema))
    placed = assigned.join(splits, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int"))
    # a query's group: that of its cell and, in a large cell, a hash
    group = F.concat_ws("-", "party", F.pmod(F.xxhash64("id", "v"), F.col("groups")))
    queries = placed.filter("is_query").select(
        F.col("id").alias("query_id"), F.xxhash64("v").alias("qhash"), F.col("v").alias("qv"), "dim", "cell", "subs", group.alias("group"),
        F.lit(float("-inf")).alias("far"), F.lit(float("-inf")).alias("large"),
    )
    every_sub = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    home = written(_solve(queries.withColumn("sub", every_sub).drop("subs"), placed, k), "home")
    ranked = Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id")
    floor = home.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", "qhash", F.col("score").alias("floor"))

    sent_columns = queries.columns

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                cells = by_dim[dim]
                points = np.array(part["qv"].tolist(), float).reshape(-1, dim)
                own, floors = part["cell"].to_numpy(), part["floor"].to_numpy(float)
                query, cell = np.nonzero(cells.needed(points, own, floors))
                far, large = cells.least(points, own, floors)
                for at in range(0, len(query), 10_000):
                    here = slice(at, at + 10_000)
                    sent = part.iloc[query[here]].assign(cell=cells.cells[cell[here]], subs=cells.subs[cell[here]])
                    yield sent.assign(far=far[query[here], cell[here]], large=large[query[here], cell[here]])[sent_columns]

    others = (
        queries.join(floor, ["query_id", "qhash"], "left")
        .select("query_id", "qhash", "qv", "dim", "cell", "subs", "group", "far", "large", F.col("floor").cast("double").alias("floor"))
        .mapInPandas(needed, queries.schema)
        .withColumn("sub", every_sub)
        .drop("subs")
    )
    everywhere = home.unionByName(_solve(others, placed, k))
    last = F.sum("copies").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        everywhere.withColumn("last", last)
        .withColumn("first", F.col("last") - F.col("copies") + 1)
        .filter(F.col("first") <= k)
        .select("query_id", F.explode(F.sequence(F.col("first").cast("int"), F.least("last", F.lit(k)).cast("int"))).alias("rank"), "vec_id", "score")
    )


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
