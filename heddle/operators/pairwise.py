"""Statistics of all pairs of items over the members they share.

An item's missing values are missing rows. ``block_pairs`` deals items into blocks and members into slices, packs the cells
of a block and slice into one record, and multiplies dense blocks in Arrow batches: of data in which most pairs share most
members, a join on the member would make a row for each pair and member. What a pair of blocks yields is decided inside the
task (a floor, the best few of each item), so that not every pair becomes a row. Where few pairs share many members, a block is sent
only to the blocks that it shares members with, and only these, and pairs are made of shared members alone (``_shared_pairs``).
``pair_moments`` is the join in SQL.
Nothing gathers an item or a member as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.stats import correlation_p, hypergeom_sf, hypergeom_tail
from heddle.operators.windows import top_k
from heddle.storage import written

MOMENTS = ["n", "sx", "sy", "sxy", "sxx", "syy"]
BLOCK_ITEMS = 1024  # of a block; a task holds the sums of two blocks' pairs
TASK_CELLS = 1 << 20  # measured values of a task, about
_TILE = 2048  # members multiplied at a time
_MERGED = 8  # slices of a pair of blocks whose sums are added in one task
_SPARSE = 100  # products of a dense block that take the time of one pair of cells with a common member
_PAIRS = 1 << 19  # pairs of cells with a common member that a task holds at a time
_BLOCK_PAIRS = 40_000_000  # such pairs of a block's cells, about
_RANGE = 16  # blocks of a range, at most: a task holds the records of one range, and reads another
_LONG = 1e3  # rows in single precision are shorter than this, so that their products stay exact enough to leave pairs out
_FEW_PAIRS = 4  # pairs with common hits for each gene, at most, that are joined with all rows
_COUNTED = 1 << 16  # pairs of blocks have common members counted for all pairs at once, where so many are asked for
_SENT = 6  # how often a block of sparse data is sent to others, on the average, at most
_HELD = 1 << 19  # rows that a task of sparse data merges before they leave it, about
_NEAR = 4  # blocks of sparse data in a range, where they are not sent

#: A factor takes a cell's values, one array for each value column.
Factor = Callable[..., np.ndarray]
one: Factor = np.ones_like
same: Factor = np.positive
square: Factor = np.square


def present(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """``one`` of several columns."""
    return np.ones_like(x)


#: Sums over shared members of one factor of x times one of y.
MOMENT_FACTORS: dict[str, tuple[Factor, Factor]] = {
    "n": (one, one), "sx": (same, one), "sy": (one, same), "sxy": (same, same), "sxx": (square, one), "syy": (one, square),
}


def pair_moments(values: DataFrame, item: str, member: str, value: str, within: list[str] | None = None) -> DataFrame:
    """Rows (a, b, n, sx, sy, sxy, sxx, syy) for a < b over shared members; ``within``: columns that must agree."""
    within = within or []
    rows = values.filter(F.col(value).isNotNull())
    left = rows.select(*within, F.col(member).alias("m"), F.col(item).alias("a"), F.col(value).alias("x"))
    right = rows.select(*within, F.col(member).alias("m"), F.col(item).alias("b"), F.col(value).alias("y"))
    pairs = left.join(right, [*within, "m"]).filter("a < b")
    x, y = F.col("x"), F.col("y")
    terms = {"n": F.lit(1), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}
    return pairs.groupBy(*within, "a", "b").agg(*[F.sum(e).alias(c) for c, e in terms.items()])


class _Side:
    """A block's items with its cells over some members: the item's number, the member's number (in order) and the values of each."""

    def __init__(self, items: np.ndarray, row: np.ndarray, at: np.ndarray, cells: list[np.ndarray]):
        self.items, self.row, self.at, self.cells = items, row, at, cells
        self.kept: dict = {}  # what pairs of blocks that have this side in common need of it again

    def tile(self, factor: Factor, start: int, width: int, dtype: type) -> np.ndarray:
        """The factor of the cells over ``width`` members, by item and member."""
        here = slice(*np.searchsorted(self.at, [start, start + width]))
        flat = self.row[here] * width + self.at[here] - start
        return np.bincount(flat, factor(*[x[here] for x in self.cells]), len(self.items) * width).reshape(len(self.items), width).astype(dtype)

    def total(self, factor: Factor) -> np.ndarray:
        return np.bincount(self.row, factor(*self.cells), len(self.items))


class PairBlock:
    """The sums of all pairs of two blocks' items (``a`` and ``b``; ``diagonal`` where both are one block), and totals of the items.

    Sums are worked out when they are asked for, of all pairs or of some; those of several slices are given as arrays.
    """

    def __init__(self, sides: tuple[_Side, _Side], members: int, sums: dict, totals: dict, diagonal: bool, dtype: type):
        self.a, self.b = sides[0].items, sides[1].items
        self.sides, self.members, self.sums, self.totals, self.diagonal, self.dtype = sides, members, sums, totals, diagonal, dtype
        self.held: dict[str, np.ndarray] = {}
        self.summed: dict[tuple[int, str], np.ndarray] = {}

    def _tile(self, side: int, factor: Factor, start: int) -> np.ndarray:
        side = 0 if self.diagonal else side
        if self.members > _TILE:
            return self.sides[side].tile(factor, start, _TILE, self.dtype)
        own = self.sides[side]
        if factor not in own.kept:
            own.kept[factor] = own.tile(factor, start, self.members, self.dtype)
        return own.kept[factor]

    def sum(self, name: str) -> np.ndarray:
        """By item of ``a`` and item of ``b``."""
        if name not in self.held:
            f, g = self.sums[name]
            if self.members <= _TILE:
                self.held[name] = self._tile(0, f, 0) @ self._tile(1, g, 0).T
                return self.held[name]
            products = (self._tile(0, f, start) @ self._tile(1, g, start).T for start in range(0, self.members, _TILE))
            self.held[name] = reduce(np.add, products, np.zeros((len(self.a), len(self.b))))
        return self.held[name]

    def at(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The sums of the pairs (a[i], b[j]): if they are few, without those of the others."""
        f, g = self.sums[name]
        if name not in self.held and self.members <= _TILE and f in (one, present) and g in (one, present):
            return self.common(f, g, i, j).astype(float)
        if name in self.held or len(i) * 64 > len(self.a) * len(self.b):
            return self.sum(name)[i, j]
        found = np.zeros(len(i))
        for start in range(0, self.members, _TILE):
            x, y = self._tile(0, f, start), self._tile(1, g, start)
            for k in range(0, len(i), 1024):
                found[k : k + 1024] += np.einsum("ij,ij->i", x[i[k : k + 1024]], y[j[k : k + 1024]])
        return found

    def bits(self, side: int, factor: Factor) -> np.ndarray:
        """By item, the members of which the factor is not 0, as 64-bit words."""
        side = 0 if self.diagonal else side
        own = self.sides[side]
        if (factor, "bits") not in own.kept:
            marks = np.zeros((len(own.items), -(-max(self.members, 1) // 64) * 64), bool)
            real = factor(*own.cells) != 0
            marks[own.row[real], own.at[real]] = True
            own.kept[factor, "bits"] = np.packbits(marks, axis=1).view(np.uint64)
        return own.kept[factor, "bits"]

    def common(self, f: Factor, g: Factor, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many members of the pairs (a[i], b[j]) have both factors other than 0."""
        x, y, step = self.bits(0, f), self.bits(1, g), 1 << 16
        parts = [np.bitwise_count(x[i[k : k + step]] & y[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def total(self, side: int, name: str) -> np.ndarray:
        side = 0 if self.diagonal else side
        if (side, name) in self.summed:
            return self.summed[side, name]
        own = self.sides[side]
        if (name, "total") not in own.kept:
            own.kept[name, "total"] = own.total(self.totals[name])
        return own.kept[name, "total"]

    def shared(self) -> np.ndarray:
        """How many members each pair has in common, of ``_TILE`` members or fewer: in single precision, which holds such counts."""
        for own in self.sides:
            if "marks" not in own.kept:
                own.kept["marks"] = own.tile(present, 0, self.members, np.float32)
        return self.sides[0].kept["marks"] @ self.sides[1].kept["marks"].T

    def cells(self, side: int, factor: Factor) -> np.ndarray:
        """The factor of a side's cells by item and member, of ``_TILE`` members or fewer."""
        return self._tile(side, factor, 0)

    def single(self, side: int, rows: Callable) -> tuple[np.ndarray, np.ndarray]:
        """What ``rows`` makes of a side, in single precision, and its rows' lengths; 0 where such a row is too long for it."""
        own = self.sides[0 if self.diagonal else side]
        if (side, rows) not in own.kept:
            exact = rows(self, side)
            lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
            exact[~(lengths < _LONG)] = 0.0
            own.kept[side, rows] = exact.astype(np.float32), lengths
        return own.kept[side, rows]

    def pairs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted pairs of different items, each pair once."""
        return np.nonzero(np.triu(wanted, 1) if self.diagonal else wanted)

    @staticmethod
    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For all pairs, a value of an item of ``a`` times one of an item of ``b``."""
        return x[:, None] * y[None, :]


class _SomePairs:
    """Some pairs (a[i], b[j]) of a ``PairBlock``: sums and totals have one entry for each of them."""

    def __init__(self, held: PairBlock, i: np.ndarray, j: np.ndarray):
        self.held, self.ends = held, (i, j)

    def sum(self, name: str) -> np.ndarray:
        return self.held.at(name, *self.ends)

    def total(self, side: int, name: str) -> np.ndarray:
        return self.held.total(side, name)[self.ends[side]]

    @staticmethod
    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x * y


class _Cells:
    """A block's cells by member, then item: of each cell the item's number and the values, of each member where its cells start and how many it has."""

    def __init__(self, items: np.ndarray, members: np.ndarray, places: bytes, data: bytes, columns: int, totals: list[str]):
        self.items, self.members = np.asarray(items), np.asarray(members)
        self.counts, self.row = np.split(np.frombuffer(places, np.int32), [len(self.members)])
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        own = np.frombuffer(data, float)
        self.values = [own[k * len(self.row) : (k + 1) * len(self.row)] for k in range(columns)]
        self.totals = dict(zip(totals, own[columns * len(self.row) :].reshape(len(totals), len(self.items))))
        self.by_row = np.argsort(self.row, kind="stable")
        self.held: dict[Factor, np.ndarray] = {}

    @staticmethod
    def packed(items: np.ndarray, member: np.ndarray, values: list[np.ndarray], totals: dict[str, Factor]) -> dict:
        items, row = np.unique(items, return_inverse=True)
        order = np.lexsort((row, member))
        members, counts = np.unique(member, return_counts=True)
        sums = [np.bincount(row, f(*values), len(items)) for f in totals.values()]
        places = np.concatenate([counts, row[order]]).astype(np.int32).tobytes()
        return {"items": [items.tolist()], "members": [members], "places": [places], "data": [b"".join(x.astype(float).tobytes() for x in (*(v[order] for v in values), *sums))]}

    def factor(self, f: Factor) -> np.ndarray:
        if f not in self.held:
            self.held[f] = np.asarray(f(*self.values), float)
        return self.held[f]


class PairRows:
    """``PairBlock`` of the pairs that share a member only, each once: ``a``, ``b``, sums and totals have one entry for each of them.

    ``both``: each pair is there in both directions, and ``a``'s partners of the other block are all in one such object.
    """

    def __init__(self, sides: tuple[_Cells, _Cells], left: np.ndarray, right: np.ndarray, sums: dict, both: bool):
        self.sides, self.left, self.right, self.sums, self.both = sides, left, right, sums, both
        own, other = sides
        row, width = own.row[left], len(other.items)
        low = int(row[0])
        flat = (row - low).astype(np.int64) * width + other.row[right]
        span = (int(row[-1]) - low + 1) * width
        if span <= 8 * len(left) + 1024:
            self.flat, self.span = flat, span
            self.count = np.bincount(flat, minlength=span)
            if own is other:
                self.count[np.arange(low, int(row[-1]) + 1) * (width + 1) - low * width] = 0  # an item with itself
            self.seen = np.flatnonzero(self.count)
            self.count, found = self.count[self.seen].astype(float), self.seen
        else:
            if own is other:
                real = row != other.row[right]
                self.left, self.right, flat = left[real], right[real], flat[real]
            found, self.flat, self.count = np.unique(flat, return_inverse=True, return_counts=True)
            self.count, self.span, self.seen = self.count.astype(float), len(found), np.arange(len(found))
        self.ends = (found // width + low, found % width)
        self.a, self.b = own.items[self.ends[0]], other.items[self.ends[1]]
        self.held: dict[str, np.ndarray] = {}
        self.picked: tuple | None = None

    def _products(self, name: str, rows: np.ndarray | slice) -> np.ndarray:
        f, g = self.sums[name]
        return self.sides[0].factor(f)[self.left[rows]] * self.sides[1].factor(g)[self.right[rows]]

    def sum(self, name: str) -> np.ndarray:
        if name not in self.held:
            counted = all(f in (one, present, _measured) for f in self.sums[name])
            self.held[name] = self.count if counted else np.bincount(self.flat, self._products(name, slice(None)), self.span)[self.seen]
        return self.held[name]

    def at(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if name in self.held or len(i) * 4 > len(self.seen):
            return self.sum(name)[i]
        if self.picked is None or self.picked[0] is not i:
            places, at = np.unique(i, return_inverse=True)
            slot = np.full(self.span, -1)
            slot[self.seen[places]] = np.arange(len(places))
            of = slot[self.flat]
            rows = np.flatnonzero(of >= 0)
            self.picked = i, rows, of[rows], len(places), at
        _, rows, of, n, at = self.picked
        return np.bincount(of, self._products(name, rows), n)[at]

    def total(self, side: int, name: str) -> np.ndarray:
        return self.sides[side].totals[name][self.ends[side]]

    def pairs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(wanted)
        return found, found

    @staticmethod
    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x * y


def _cell_pairs(own: _Cells, other: _Cells, sums: dict, both: bool) -> Iterable[PairRows]:
    """The pairs of two blocks' items by their cells, some items of the first block at a time; of one block each once, or ``both`` ways."""
    place = np.minimum(np.searchsorted(other.members, own.members), len(other.members) - 1)
    met = other.members[place] == own.members
    n, start = (np.repeat(x, own.counts) for x in (np.where(met, other.counts[place], 0), other.starts[place]))
    if own is other and not both:  # of each cell, those after it
        at = np.arange(len(own.row))
        n, start = n - (at - start) - 1, at + 1
    left = own.by_row[n[own.by_row] > 0]
    if not len(left):
        return
    of_item = np.bincount(own.row[left], n[left], len(own.items))
    ends = np.cumsum(of_item)[own.row[left]]
    of_item = of_item[own.row[left]]
    batch = (ends - of_item) // _PAIRS
    for part in np.split(left, np.flatnonzero(np.diff(batch)) + 1):
        size = n[part]
        right = np.arange(size.sum()) + np.repeat(start[part] - (np.cumsum(size) - size), size)
        yield PairRows((own, other), np.repeat(part, size), right, sums, both)


def _shared_pairs(
    rows: DataFrame, within: list[str], given: list[str], sums: dict, totals: dict, finish: Callable, merge: Callable | None, schema: str, cells: int, cell_pairs: int, both: bool,
) -> DataFrame:
    """``block_pairs`` of sparse data: cells (``within``, item, member, values) meet only where a member is shared.

    Blocks are ranges of items, one record each. A task has one block and reads, one after the other, the blocks that share a member with it, or where
    most do, ranges of blocks (as in ``_met``): it holds two blocks and ``_PAIRS`` pairs of cells at a time, however the members are dealt over blocks. What ``finish`` makes leaves the task at once, or with ``merge`` once for each block, or ``_HELD`` rows of it.
    """
    spark = rows.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(cells / TASK_CELLS), min(tasks, math.ceil(cell_pairs * (1 + both) / _BLOCK_PAIRS)))
    kind = rows.schema["item"].dataType.simpleString()
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in within)

    def pack(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        frames = [*frames]
        if not frames:
            return
        frame = pd.concat(frames)
        for key, part in frame.groupby(within, sort=False, dropna=False) if within else [((), frame)]:
            found = _Cells.packed(part["item"].to_numpy(), part["member"].to_numpy(), [part[c].to_numpy(float) for c in given], totals)
            yield pd.DataFrame({**{c: [k] for c, k in zip(within, key)}, "block": [int(part["block"].iloc[0])], **found})

    ranged = rows.repartitionByRange(blocks, *within, "item").withColumn("block", F.spark_partition_id())
    packed = written(ranged.mapInPandas(pack, f"{head}block int, items array<{kind}>, members array<bigint>, places binary, data binary"), "packed")
    seen = packed.select(*within, "block", F.explode("members").alias("member")).groupBy(*within, "member").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select(*within, "blocks").distinct()
    near = seen.select(*within, "blocks", F.explode("blocks").alias("low")).select(*within, "low", F.explode("blocks").alias("block"))
    near = written((near if both else near.filter("low <= block")).distinct(), "near")
    record, width = ["items", "members", "places", "data"], len(given)

    def of(row: dict, more: str = "") -> _Cells:
        return _Cells(*(row[c + more] for c in record), width, [*totals])

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        left, parts = None, []

        def given_out(parts: list[pd.DataFrame], key: tuple) -> Iterable[pd.DataFrame]:
            for found in parts:
                for k, c in enumerate(within):
                    found.insert(k, c, key[k])
                yield found

        for frame in frames:
            for row in frame.to_dict("records"):
                key, low, high = tuple(row[c] for c in within), row["low"], row["block"]
                if left is None or left[0] != (key, low):
                    if parts:
                        yield from given_out([merge(pd.concat(parts))], left[0][0])
                    left, parts = ((key, low), of(row)), []
                for held in _cell_pairs(left[1], left[1] if low == high else of(row, "2" if "data2" in row else ""), sums, both):
                    if merge is None:
                        yield from given_out([finish(held)], key)
                    else:
                        parts.append(finish(held))
                        if sum(map(len, parts)) > max(2 * len(parts[0]), _PAIRS):
                            parts = [merge(pd.concat(parts))]
                        if len(parts[0]) > _HELD:  # the same rows may follow from another block: they are added or ranked again
                            yield from given_out(parts, key)
                            parts = []
        if parts:
            yield from given_out([merge(pd.concat(parts))], left[0][0])

    if near.count() <= _SENT * packed.count():
        first = [*within, "low", F.col("low") != F.col("block"), "block"]
        sent = packed.join(F.broadcast(near), [*within, "block"]).repartitionById(blocks, "low").sortWithinPartitions(*first)
        return sent.select(*within, "low", "block", *record).mapInPandas(run, head + schema)
    ranges = max(1, math.ceil(blocks / _NEAR))
    ways = packed.repartitionByRange(ranges, "block")
    other = ways.select(*[F.col(c).alias(f"{c}2") for c in ways.columns])
    where = [F.lit(True) if both else F.col("block") <= F.col("block2"), *[F.col(c) == F.col(f"{c}2") for c in within]]
    met = ways.hint("shuffle_replicate_nl").join(other, reduce(Column.__and__, where))
    return met.select(*within, F.col("block").alias("low"), F.col("block2").alias("block"), *record, *[f"{c}2" for c in record]).mapInPandas(run, head + schema)


def _record(items: np.ndarray, row: np.ndarray, member: np.ndarray, cells: list[np.ndarray]) -> dict:
    """Cells in the order of their members: the members once, how many cells each has, then the cells' items and values."""
    order = np.argsort(member, kind="stable")
    members, counts = np.unique(member, return_counts=True)
    head = np.array([len(members), len(member)], np.int64)
    narrow = np.uint16 if len(items) <= 1 << 16 else np.int32
    parts = [head, members, counts.astype(np.int32), row[order].astype(narrow), *(x[order] for x in cells)]
    return {"items": [items.tolist()], "data": [b"".join(np.ascontiguousarray(p).tobytes() for p in parts)]}


def _unpacked(items: Iterable, data: bytes, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A record's items, of each cell the item's number, the members (in order) and how many cells each has, and of each cell the values."""
    items, narrow = np.asarray(items), np.uint16 if len(items) <= 1 << 16 else np.int32
    place = 0

    def take(dtype: type, n: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(data, dtype, n, place)
        place += found.nbytes
        return found

    m, n = take(np.int64, 2).tolist()
    members, counts = take(np.int64, m), take(np.int32, m)
    row = take(narrow, n).astype(np.int64)
    return items, row, members, counts, [take(float, n) for _ in range(columns)]


class _Sides:
    """A task's sides of pairs of blocks. They are over the members of all blocks so far while these are few, so that a first block's side serves again."""

    def __init__(self):
        self.members, self.first, self.side = np.zeros(0, np.int64), None, None

    def of(self, first: tuple, second: tuple) -> tuple[tuple[_Side, ...], int]:
        for record in (first, second):
            if len(self.members) <= _TILE and not np.isin(record[2], self.members, assume_unique=True).all():
                self.members, self.first = np.union1d(self.members, record[2]), None
        if not len(self.members) <= min(_TILE, 2 * len(first[2]), 2 * len(second[2])):
            return _sides((first, second))
        if self.first is not first:
            self.first, self.side = first, self.over(first)
        return (self.side, self.side if second is first else self.over(second)), len(self.members)

    def over(self, record: tuple) -> _Side:
        items, row, own, counts, cells = record
        return _Side(items, row, np.repeat(np.searchsorted(self.members, own), counts), cells)


def _sides(records: Iterable[tuple]) -> tuple[tuple[_Side, ...], int]:
    """Two blocks' sides over the members of either, and how many these are."""
    records = [*records]
    members = reduce(np.union1d, [r[2] for r in records])
    return tuple(_Side(items, row, np.repeat(np.searchsorted(members, own), counts), cells) for items, row, own, counts, cells in records), len(members)


def _met(packed: DataFrame, within: list[str], blocks: int) -> DataFrame:
    """Each pair of blocks once, as a row with both records; names of the second one's columns end with 2.

    A task meets two ranges of blocks, which it reads from one exchange of the records: none is written once for each other block.
    """
    tasks = 4 * packed.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, min(blocks, max(math.ceil(math.sqrt(2 * tasks)), math.ceil(blocks / _RANGE))))
    left = packed.repartitionByRange(ranges, "block")
    right = left.select(*[F.col(c).alias(f"{c}2") for c in left.columns])
    where = [F.col("block") <= F.col("block2"), *[F.col(c).eqNullSafe(F.col(f"{c}2")) for c in within]]
    return left.hint("shuffle_replicate_nl").join(right, reduce(Column.__and__, where))


def block_pairs(
    values: DataFrame, item: str, member: str, columns: list[str], sums: dict[str, tuple[Factor, Factor]], finish: Callable[[PairBlock], pd.DataFrame], schema: str,
    within: list[str] | None = None, totals: dict[str, Factor] | None = None, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS, dtype: type = float,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, running: Callable | None = None, both: bool = False,
) -> DataFrame:
    """The rows (``within``, then ``schema``) that ``finish`` makes of each pair of blocks of items.

    A sum is over the members that both items have of f(x) g(y), for a pair of factors (f, g) of the ``columns``; a total is over
    one item's members. Items are dealt into blocks and members into slices, as many as the numbers of items and values ask
    for. Cells are shuffled once. Where blocks have one slice, their records are exchanged once more, and tasks read them by ranges
    (``_met``); else a block's packed slice is sent once for each block, and sums of several slices are added as arrays, some slices at a time. Rows with a null item, member or value don't count. The cells are stored
    and counted while the plan is built. ``dtype``: float32 will do for counts of up to 2**24 members.

    Where pairs share few of the members, ``finish`` gets ``PairRows`` instead of ``PairBlock``, with the same sums, of pairs that share
    one; others must not count for it. ``merge`` may shorten what several calls of ``finish`` in one task have made.
    With ``both``, each pair is in ``PairRows`` in both directions, and all of an item's are in one task where blocks are few that share members.
    ``running`` makes what takes the place of ``finish`` in a task that meets many pairs of blocks: it has ``add(held, low, high)`` for a
    pair of blocks, and ``rows()``, the frames of all of them. Only without ``within``.
    """
    within, totals = within or [], totals or {}
    rows = values.select(*within, F.col(item).alias("item"), F.xxhash64(F.col(member)).alias("member"), F.col(member).isNull().alias("_none"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    given = [f"x{k}" for k in range(len(columns))]
    rows = written(rows.filter(" and ".join(["item is not null and not _none", *[f"{c} is not null" for c in given]])).drop("_none"), "cells")
    size = rows.agg(F.count("*").alias("cells"), F.approx_count_distinct("item").alias("items")).first()
    shared = rows.groupBy(*within, "member").agg(F.count("*").alias("d")).groupBy(*within).agg(F.count("*").alias("members"), F.sum(F.expr("d * (d - 1) / 2")).alias("shared"))
    items = rows.groupBy(*within).agg(F.approx_count_distinct("item").alias("items"))
    joined = shared.join(items, within) if within else shared.crossJoin(items)
    work = joined.agg(F.sum("shared").alias("shared"), F.sum(F.expr("members * (double(items) * items / 2)")).alias("dense")).first()
    if (work["shared"] or 0) * _SPARSE < (work["dense"] or 0):
        return _shared_pairs(rows, within, given, sums, totals, finish, merge, schema, size["cells"], int(work["shared"]), both)
    blocks = max(1, math.ceil(size["items"] / block_items))
    slices = max(1, math.ceil(2 * size["cells"] / (blocks * task_cells)))
    kind = values.schema[item].dataType.simpleString()
    groups = [f"`{c}` {values.schema[c].dataType.simpleString()}" for c in within]

    def keyed(key: tuple, found: dict | pd.DataFrame, names: list[str]) -> pd.DataFrame:
        found = pd.DataFrame(found)
        for name, part in zip(reversed(names), reversed(key)):
            found.insert(0, name, part)
        return found

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        items, row = np.unique(frame["item"].to_numpy(), return_inverse=True)
        return keyed(key, _record(items, row, frame["member"].to_numpy(), [frame[c].to_numpy(float) for c in given]), [*within, "block", "slice"])

    def block_of(low: int, high: int, frame: pd.DataFrame) -> PairBlock | None:
        own = {b: _unpacked(items, data, len(columns)) for b, items, data in zip(frame["block"], frame["items"], frame["data"])}
        if low not in own or high not in own:
            return None  # the other block has no member in this slice
        return PairBlock(*_sides((own[low], own[high])), sums, totals, low == high, dtype)

    def whole(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        task, parts, left, sides = running() if running else None, [], None, _Sides()
        for frame in frames:
            for k in range(len(frame)):
                row = frame.iloc[k]
                key, low, high = tuple(row[c] for c in within), row["block"], row["block2"]
                if left is None or left[0] != (key, low):
                    left = (key, low), _unpacked(row["items"], row["data"], len(columns))
                second = left[1] if low == high else _unpacked(row["items2"], row["data2"], len(columns))
                held = PairBlock(*sides.of(left[1], second), sums, totals, low == high, dtype)
                if task:
                    task.add(held, low, high)
                elif merge and not within:
                    parts.append(finish(held))
                    parts = [merge(pd.concat(parts))] if len(parts) == _MERGED else parts
                else:
                    yield keyed(key, finish(held), within)
        if task:
            yield from task.rows()
        elif parts:
            yield merge(pd.concat(parts))

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low, high = key[len(within)], key[len(within) + 1]
        held = block_of(low, high, frame)
        if held is None:  # the totals of a block without a partner still count
            own = [_unpacked(items, data, len(columns)) for items, data in zip(frame["items"], frame["data"])]
            empty = _Side(own[0][0][:0], np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * len(columns))
            mine = _Side(own[0][0], own[0][1], np.arange(len(own[0][1])), own[0][4])
            held = PairBlock((mine, empty) if frame["block"].iloc[0] == low else (empty, mine), 0, sums, totals, False, dtype)
        return keyed(key, _arrays(held, list(sums), list(totals)), [*within, "low", "high", "slice"])

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return keyed(key, _arrays(_added(frame, sums, totals, key[len(within)] == key[len(within) + 1], dtype), list(sums), list(totals)), [*within, "low", "high", "slice"])

    def last(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return keyed(key[: len(within)], finish(_added(frame, sums, totals, key[len(within)] == key[len(within) + 1], dtype)), within)

    head = ", ".join([*groups, ""])
    packed = (
        rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        .withColumn("slice", F.pmod("member", F.lit(slices)).cast("int"))
        .groupBy(*within, "block", "slice")
        .applyInPandas(pack, f"{head}block int, slice int, items array<{kind}>, data binary")
    )
    out = f"{head}{schema}"
    if slices == 1:
        met = _met(written(packed.drop("slice"), "packed"), within, blocks)
        return met.mapInPandas(whole, out)
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        *within, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slice", "block", "items", "data"
    )
    arrays = f"{head}low int, high int, slice int, a array<{kind}>, b array<{kind}>, sums binary, a_totals binary, b_totals binary"
    partial = sent.groupBy(*within, "low", "high", "slice").applyInPandas(part, arrays)
    while slices > _MERGED:
        slices = -(-slices // _MERGED)
        partial = partial.withColumn("slice", F.floor(F.col("slice") / _MERGED).cast("int")).groupBy(*within, "low", "high", "slice").applyInPandas(added, arrays)
    return partial.groupBy(*within, "low", "high").applyInPandas(last, out)


def _arrays(held: PairBlock, sums: list[str], totals: list[str]) -> dict:
    return {
        "a": [held.a.tolist()], "b": [held.b.tolist()], "sums": [b"".join(np.ascontiguousarray(held.sum(c), float).tobytes() for c in sums)],
        "a_totals": [b"".join(held.total(0, c).astype(float).tobytes() for c in totals)], "b_totals": [b"".join(held.total(1, c).astype(float).tobytes() for c in totals)],
    }


def _added(frame: pd.DataFrame, sums: dict, totals: dict, diagonal: bool, dtype: type) -> PairBlock:
    """The sums of some slices of a pair of blocks; an item need not be in every slice."""
    a, b = (np.unique(np.concatenate([np.asarray(x) for x in frame[c] if len(x)] or [np.zeros(0)])) for c in ("a", "b"))
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    held = PairBlock((_Side(a, *nothing), _Side(b, *nothing)), 0, sums, totals, diagonal, dtype)
    held.held = {c: np.zeros((len(a), len(b))) for c in sums}
    held.summed = {(side, c): np.zeros(len(items)) for side, items in enumerate((a, b)) for c in totals}
    for row in frame.itertuples():
        i, j = (np.searchsorted(all_, np.asarray(own)) if len(own) else np.zeros(0, np.int64) for all_, own in ((a, row.a), (b, row.b)))
        parts = np.frombuffer(row.sums, float).reshape(len(sums), len(i), len(j))
        for c, part in zip(sums, parts):
            held.held[c][np.ix_(i, j)] += part
        for side, (own, data) in enumerate(((i, row.a_totals), (j, row.b_totals))):
            for c, part in zip(totals, np.frombuffer(data, float).reshape(len(totals), len(own))):
                held.summed[side, c][own] += part
    return held


def block_sums(
    values: DataFrame, item: str, member: str, value: str, sums: dict[str, tuple[Factor, Factor]], within: list[str] | None = None, least: int = 1,
    block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS,
) -> DataFrame:
    """Rows (``within``, a, b, n, and the ``sums``) for a < b that share ``least`` members or more.

    A sum is over shared members of f(x) g(y), for a pair of factors (f, g); with each pair (g, f) must be there too.
    """
    sums = {"n": (one, one)} | sums
    mirror = {name: next(k for k, v in sums.items() if v == (g, f)) for name, (f, g) in sums.items()}

    def rows(held: PairBlock) -> pd.DataFrame:
        i, j = held.pairs(held.sum("n") > max(least, 1) - 0.5)
        turned = held.a[i] > held.b[j]
        found = {name: held.at(name, i, j) for name in sums}
        found = {name: np.where(turned, found[mirror[name]], x) for name, x in found.items()}
        ends = {"a": np.where(turned, held.b[j], held.a[i]), "b": np.where(turned, held.a[i], held.b[j])}
        return pd.DataFrame(ends | found).astype({"n": "int64"})

    kind = values.schema[item].dataType.simpleString()
    schema = ", ".join([f"a {kind}", f"b {kind}", *[f"{c} {'long' if c == 'n' else 'double'}" for c in sums]])
    return block_pairs(values, item, member, [value], sums, rows, schema, within, block_items=block_items, task_cells=task_cells)


class _FirstSoFar:
    """The ``k`` first partners so far of each of a block's items, by a key (smaller is better) and more keys; ``bound``: what an item's next one's key may be at most."""

    def __init__(self, items: np.ndarray, k: int, bound: float, slack: float = 0.0):
        self.items, self.k, self.first, self.slack = items, k, bound, slack
        self.bound, self.parts, self.waiting = np.full(len(items), bound), [], 0

    def add(self, row: np.ndarray, keys: list[np.ndarray], others: list[np.ndarray]) -> None:
        if len(row):
            self.parts.append((row, keys, others))
            self.waiting += len(row)
        if self.waiting > len(self.items) * self.k:
            self.shorten()

    def shorten(self) -> None:
        if not self.waiting:
            return
        row = np.concatenate([p[0] for p in self.parts])
        keys, others = ([np.concatenate(x) for x in zip(*(p[c] for p in self.parts))] for c in (1, 2))
        order = np.lexsort((*reversed(keys), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.bound[row[last]] = np.minimum(self.bound[row[last]], keys[0][order[last]] + self.slack)
        order, row = order[place < self.k], row[place < self.k]
        self.parts, self.waiting = [(row, [x[order] for x in keys], [x[order] for x in others])], 0

    def widen(self, items: np.ndarray) -> None:
        """More items, among those of before."""
        every = np.union1d(self.items, items)
        at = np.searchsorted(every, self.items)
        bound = np.full(len(every), self.first)
        bound[at] = self.bound
        self.parts = [(at[row], keys, others) for row, keys, others in self.parts]
        self.items, self.bound = every, bound

    def rows(self) -> tuple | None:
        self.shorten()
        return (self.items[self.parts[0][0]], *self.parts[0][1:]) if self.parts else None


class _StrongestSoFar:
    """A task's ``best_partners``: a pair counts on only if it reaches the k-th best so far of one of its items.

    With ``rows``, pairs that can't, by products in single precision and a bound of their error, are left out before the strengths of the others are worked out.
    """

    def __init__(self, strength: Callable, k: int, support: str | None, digits: int | None, floor: float, least: int, rows: Callable | None = None):
        self.strength, self.k, self.support, self.digits, self.floor, self.least, self.of_side = strength, k, support, digits, floor, least, rows
        self.slack = 0.0 if digits is None else 10.0**-digits
        self.blocks: dict[int, _FirstSoFar] = {}

    def near(self, held: PairBlock, own: list[_FirstSoFar]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs that may reach a bound of one of their items, and of some that don't."""
        (x, of_x), (y, of_y) = (held.single(side, self.of_side) for side in (0, 1))
        share = (x.shape[1] + 8) * 2.0**-24  # of the lengths' product: rounding x and y, and their products and sums in any order

        def least(side: _FirstSoFar, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
            long = ~(lengths < _LONG)
            bound = -side.bound - share * np.where(long, 0.0, lengths) * others[others < _LONG].max(initial=0.0)
            return np.nextafter(np.where(long, -np.inf, bound).astype(np.float32), np.float32(-np.inf))

        r = x @ y.T
        if held.diagonal:
            np.fill_diagonal(r, np.nan)
        wanted = r >= least(own[0], of_x, of_y)[:, None]
        if held.diagonal:
            wanted[:, ~(of_x < _LONG)] = True
            np.fill_diagonal(wanted, False)
        else:
            wanted |= r >= least(own[1], of_y, of_x)[None, :]
        if self.support and self.least and np.count_nonzero(wanted) > _COUNTED:
            wanted &= held.shared() > self.least - 0.5
        return np.divmod(np.flatnonzero(wanted), len(held.b))

    def add(self, held: PairBlock, low: int, high: int) -> None:
        ends = [(0, low, held.a, held.b)] if held.diagonal else [(0, low, held.a, held.b), (1, high, held.b, held.a)]
        own = [self.blocks.setdefault(block, _FirstSoFar(items, self.k, -self.floor, self.slack)) for _, block, items, _ in ends]

        most = 4 * self.k * (len(held.a) + len(held.b))
        if self.of_side and held.members <= _TILE:
            i, j = self.near(held, own)
            if len(i) <= most:
                i, j, n = self.supported(held, i, j)
                self.reach(i, j, self.strength(_SomePairs(held, i, j)), n, ends, own)
                return
        r = self.strength(held)
        if held.diagonal:
            np.fill_diagonal(r, np.nan)

        def wanted() -> np.ndarray:
            found = r >= -own[0].bound[:, None]
            return found if held.diagonal else found | (r >= -own[1].bound[None, :])

        i, j = np.nonzero(wanted())
        if len(i) > most:  # nothing is known yet: the k-th best of these
            if self.support and self.least:
                r[~(held.sum(self.support) > self.least - 0.5)] = np.nan
            real = np.where(np.isfinite(r), r, -np.inf)
            for side, x in zip(own, (real, real.T)):
                if x.shape[1] >= self.k:
                    side.bound = np.minimum(side.bound, self.slack - np.partition(x, x.shape[1] - self.k, axis=1)[:, x.shape[1] - self.k])
            i, j = np.nonzero(wanted())
        i, j, n = self.supported(held, i, j)
        self.reach(i, j, r[i, j], n, ends, own)

    def supported(self, held: PairBlock, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs that have the least support, with it."""
        n = np.rint(held.at(self.support, i, j)).astype(np.int64) if self.support else np.zeros(len(i), np.int64)
        real = n > self.least - 0.5
        return i[real], j[real], n[real]

    def reach(self, i: np.ndarray, j: np.ndarray, found: np.ndarray, n: np.ndarray, ends: list[tuple], own: list[_FirstSoFar]) -> None:
        """Pairs with their strengths and support: those that reach a bound are kept."""
        real = np.isfinite(found)
        i, j, found, n = i[real], j[real], found[real], n[real]
        for side, (which, _, _, partners) in zip(own, ends):
            row, other = (j, i) if which else (i, j)
            here = found >= -side.bound[row]
            key = found[here] if self.digits is None else np.round(found[here], self.digits)
            side.add(row[here], [-key, partners[other[here]]], [found[here], n[here]])

    def rows(self) -> Iterable[pd.DataFrame]:
        for block in self.blocks.values():
            if (held := block.rows()) is not None:
                a, (key, b), (r, n) = held
                yield pd.DataFrame({"a": a, "b": b, "r": r, "key": -key} | ({"support": n} if self.support else {}))


def _leading(row: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that are among their row's ``k`` largest keys, with ties; equal rows are adjacent."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(start, append=len(row))
    most = int(n.max(initial=0))
    if most <= k or len(n) * most > 8 * len(row):  # few to leave out, or rows too different for one table
        return np.arange(len(row))
    table = np.full((len(n), most), -np.inf)
    at = np.repeat(np.arange(len(n)), n)
    table[at, np.arange(len(row)) - start[at]] = key
    return np.flatnonzero(key >= np.partition(table, most - k, axis=1)[at, most - k])


def best_partners(
    values: DataFrame, item: str, member: str, columns: list[str], sums: dict[str, tuple[Factor, Factor]], totals: dict[str, Factor],
    strength: Callable[[PairBlock], np.ndarray], k: int, support: str | None = None, digits: int | None = None, floor: float = -np.inf, least: int = 0,
    block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS, rows: Callable[[PairBlock, int], np.ndarray] | None = None,
) -> DataFrame:
    """Rows (a, b, r, rank, and support): each item's ``k`` strongest partners, ties by the smaller partner.

    ``strength`` gives a pair of blocks' strengths, by item and item, as an array of its own; those that are not finite or below ``floor`` don't count.
    Each task keeps the ``k`` best of each of its items, so that at most blocks x items x k rows leave the tasks. ``support`` names a sum to
    return, which must be ``least`` or more; r is rounded to ``digits`` to rank. ``rows`` gives an array of its own with a row for each item of a side (0 or 1),
    whose products are the strengths, but for those that are not finite: then only pairs that may be among the best are worked out in full; the support
    is then the number of common members.
    """
    from pyspark.sql.window import Window

    def strongest(found: pd.DataFrame) -> pd.DataFrame:
        a = found["a"].to_numpy()
        found = found.iloc[np.lexsort((found["b"].to_numpy(), -found["key"].to_numpy(), a))]
        a = np.unique(a, return_inverse=True)[1]
        a.sort()
        return found[np.arange(len(a)) - np.searchsorted(a, a) < k]

    def best(held: PairBlock | PairRows) -> pd.DataFrame:
        r = np.array(strength(held), float)
        r[~(r >= floor)] = np.nan
        if support and least:
            r[~(held.sum(support) > least - 0.5)] = np.nan
        if isinstance(held, PairRows):
            i, _ = held.pairs(np.isfinite(r))
            i = i[_leading(held.ends[0][i], r[i] if digits is None else np.round(r[i], digits), k)]
            key = r[i] if digits is None else np.round(r[i], digits)
            shared = {"support": np.rint(held.at(support, i, i)).astype(np.int64)} if support else {}
            return strongest(pd.DataFrame({"a": held.a[i], "b": held.b[i], "r": r[i], "key": key, **shared}))
        if held.diagonal:
            np.fill_diagonal(r, np.nan)
        parts = []
        for turned in (False,) if held.diagonal else (False, True):
            x, own, other = (r.T, held.b, held.a) if turned else (r, held.a, held.b)
            key = x if digits is None else np.round(x, digits)
            order = np.argsort(np.where(np.isfinite(key), -key, np.inf), axis=1, kind="stable")[:, :k]  # items ascend: ties go to the smaller
            i = np.repeat(np.arange(len(own)), order.shape[1])
            j = order.ravel()
            real = np.isfinite(x[i, j])
            i, j = i[real], j[real]
            part = {"a": own[i], "b": other[j], "r": x[i, j], "key": key[i, j]}
            if support:
                part["support"] = np.rint(held.at(support, *((j, i) if turned else (i, j)))).astype(np.int64)
            parts.append(pd.DataFrame(part))
        return pd.concat(parts)

    kind = values.schema[item].dataType.simpleString()
    schema = f"a {kind}, b {kind}, r double, key double" + (", support long" if support else "")
    running = lambda: _StrongestSoFar(strength, k, support, digits, floor, least, rows)
    found = block_pairs(values, item, member, columns, sums, best, schema, totals=totals, block_items=block_items, task_cells=task_cells, merge=strongest, running=running, both=True)
    order = Window.partitionBy("a").orderBy(F.desc("key"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("key")


def count_pairs(values: DataFrame, item: str, member: str, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS) -> int:
    """The number of unordered pairs of different items that share a member."""
    def count(held: PairBlock) -> pd.DataFrame:
        return pd.DataFrame({"pairs": [len(held.pairs(held.sum("n") > 0.5)[0])]})

    rows = values.withColumn("_one", F.lit(1.0))
    found = block_pairs(rows, item, member, ["_one"], {"n": (one, one)}, count, "pairs long", block_items=block_items, task_cells=task_cells, dtype=np.float32)
    return found.agg(F.sum("pairs").alias("pairs")).first()["pairs"] or 0


def blocked_moments(values: DataFrame, item: str, member: str, value: str, within: list[str] | None = None, **sizes: int) -> DataFrame:
    """The rows of ``pair_moments`` by ``block_sums``."""
    return block_sums(values, item, member, value, MOMENT_FACTORS, within, **sizes)


def pearson(n="n", sx="sx", sy="sy", sxy="sxy", sxx="sxx", syy="syy") -> Column:
    """Pearson's r from moments; null where a variance is 0."""
    n, sx, sy, sxy, sxx, syy = (F.col(c) for c in (n, sx, sy, sxy, sxx, syy))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def _weight(x: np.ndarray) -> np.ndarray:
    return np.abs(x)


def _weighted(x: np.ndarray) -> np.ndarray:
    return np.abs(x) * x


def _weighted_square(x: np.ndarray) -> np.ndarray:
    return np.abs(x) * x * x


#: With weights |x y|: each moment's factors times |x| and |y|.
WEIGHTED_FACTORS = {
    "w": (_weight, _weight), "wx": (_weighted, _weight), "wy": (_weight, _weighted), "wxy": (_weighted, _weighted),
    "wxx": (_weighted_square, _weight), "wyy": (_weight, _weighted_square),
}


def weighted_pearson(values: DataFrame, item: str, member: str, value: str, min_overlap: int = 1) -> DataFrame:
    """Rows (a, b, n, r, r_plain) for a < b with weights |x y|; null where the weights or a weighted variance are 0."""
    sums = block_sums(values, item, member, value, MOMENT_FACTORS | WEIGHTED_FACTORS, least=min_overlap)
    r = pearson("w", "wx", "wy", "wxy", "wxx", "wyy")
    return sums.select("a", "b", "n", F.when(F.col("w") > 0, r).alias("r"), pearson().alias("r_plain"))


def _within(factor: Factor, most: float) -> Factor:
    """The factor of values of ``most`` or less in size, and 0 for others. The same object for the same arguments."""
    return _WITHIN.setdefault((factor, most), lambda x: np.where(np.abs(x) <= most, factor(x), 0.0))


_WITHIN: dict[tuple[Factor, float], Factor] = {}


def item_correlations(
    values: DataFrame, item: str, member: str, value: str, within: list[str], min_overlap: int = 500, min_rho: float = 0.3,
    tail: float = 0.5, min_tail: int = 20,
) -> DataFrame:
    """Correlations of items over all members that two or more of them have.

    Columns ``within``, a, b, n, rho, p, overlap_fraction (of the smaller item), tail_rho (over members beyond
    ``tail`` in either item, null under ``min_tail`` of them).
    """
    usable = values.filter(F.col(value).isNotNull())
    universe = usable.groupBy(*within, member).agg(F.count_distinct(item).alias("_items")).filter("_items >= 2").drop("_items")
    rows = usable.join(universe, [*within, member], "left_semi")
    sizes = rows.groupBy(*within, item).agg(F.count("*").alias("size"))
    a_size = sizes.select(*within, F.col(item).alias("a"), F.col("size").alias("a_size"))
    b_size = sizes.select(*within, F.col(item).alias("b"), F.col("size").alias("b_size"))
    # what lies beyond the tail in either item is what does not lie within it in both
    inner = {f"in_{c}": (_within(f, tail), _within(g, tail)) for c, (f, g) in MOMENT_FACTORS.items()}
    sums = block_sums(rows, item, member, value, MOMENT_FACTORS | inner, within, least=min_overlap)
    sums = sums.withColumns({f"part_{c}": F.col(c) - F.col(f"in_{c}") for c in MOMENTS})
    kept = sums.withColumn("rho", pearson()).filter(F.abs("rho") >= min_rho)
    tail_rho = F.when(F.col("part_n") >= min_tail, pearson(*[f"part_{c}" for c in MOMENTS]))
    return (
        kept.join(a_size, [*within, "a"])
        .join(b_size, [*within, "b"])
        .select(
            *within, "a", "b", "n", "rho", correlation_p("rho", F.col("n").cast("double")).alias("p"),
            (F.col("n") / F.least("a_size", "b_size")).alias("overlap_fraction"), tail_rho.alias("tail_rho"),
        )
    )


def hit_overlaps(hits: DataFrame, measured: DataFrame, item: str, member: str, within: list[str], min_shared: int = 3) -> DataFrame:
    """Overlap of the hit sets of items: shared, a_hits, b_hits, jaccard and p, the hypergeometric upper tail.

    The population of the test is the number of members measured in the group (``within``).
    """
    sizes = hits.groupBy(*within, item).agg(F.count("*").alias("hits"))
    left = hits.select(*within, F.col(member).alias("m"), F.col(item).alias("a"))
    right = hits.select(*within, F.col(member).alias("m"), F.col(item).alias("b"))
    shared = left.join(right, [*within, "m"]).filter("a < b").groupBy(*within, "a", "b").agg(F.count("*").alias("shared"))
    population = measured.groupBy(*within).agg(F.count_distinct(member).alias("population"))
    joined = (
        shared.filter(F.col("shared") >= min_shared)
        .join(sizes.select(*within, F.col(item).alias("a"), F.col("hits").alias("a_hits")), [*within, "a"])
        .join(sizes.select(*within, F.col(item).alias("b"), F.col("hits").alias("b_hits")), [*within, "b"])
    )
    joined = joined.join(population, within) if within else joined.withColumn("population", F.lit(0)).drop("population").join(F.broadcast(population))
    return joined.select(
        *within, "a", "b", "shared", "a_hits", "b_hits", (F.col("shared") / (F.col("a_hits") + F.col("b_hits") - F.col("shared"))).alias("jaccard"),
        hypergeom_sf("shared", "population", "a_hits", "b_hits").alias("p"),
    )


def _hit(value: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return hit


def _up(value: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return hit * (value > 0)


def _down(value: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return hit * (value < 0)


def _measured(value: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return np.ones_like(value)


COHIT_SUMS = {"cohit": (_hit, _hit), "n": (_measured, _measured), "a_hits": (_hit, _measured), "b_hits": (_measured, _hit), "up": (_up, _up), "down": (_down, _down)}
_MEASURED, _COHITS, _TALLY, _FIRST = 0, 1, 2, 3  # what a row of a task of co-hits tells
_COHIT_ROW = "what int, a {0}, b {0}, cohit long, n long, a_hits long, b_hits long, same long, p double, times long"
_BASE = 50_000  # its fourth power is a long


def _hit_rows(observations: DataFrame, gene: str, screen: str, value: str, hit: str, min_screens: int) -> DataFrame:
    rows = observations.filter(F.col(value).isNotNull()).select(
        F.col(gene).alias("g"), F.col(screen).alias("s"), F.signum(F.col(value)).alias("v"), F.coalesce(F.col(hit), F.lit(False)).cast("int").alias("h")
    )
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_screens), "g", "left_semi") if min_screens > 1 else rows


class _Tails:
    """Hypergeometric tails of co-hits, each asked for once in a task."""

    def __init__(self):
        self.keys, self.p = np.zeros(0, np.int64), np.zeros(0)

    def of(self, cohit: np.ndarray, n: np.ndarray, r: np.ndarray, d: np.ndarray) -> np.ndarray:
        few, many = np.minimum(r, d), np.maximum(r, d)
        if n.max(initial=0) >= _BASE:
            return hypergeom_tail(cohit, n, few, many)
        key = ((n * _BASE + many) * _BASE + few) * _BASE + cohit
        asked, place = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.keys, asked)
        new = np.append(self.keys, -1)[at] != asked
        if new.any():
            k, rest = asked[new] % _BASE, asked[new] // _BASE
            p = hypergeom_tail(k, rest // _BASE**2, rest % _BASE, rest // _BASE % _BASE)
            self.keys, self.p = np.insert(self.keys, at[new], asked[new]), np.insert(self.p, at[new], p)
            at = np.searchsorted(self.keys, asked)
        return self.p[at][place]


class _CohitsSoFar:
    """A task's co-hits: of its pairs the numbers measured together and with enough common hits and how often each p occurs, or each item's ``k`` first partners."""

    def __init__(self, least: int, most: float, k: int | None):
        self.least, self.most, self.k, self.tails = max(least, 1), most, k, _Tails()
        self.measured = self.found = 0
        self.tally: dict[float, tuple[int, int]] = {}  # of each p, how often it occurs, and the fewest common hits that have it
        self.blocks: dict[int, _FirstSoFar] = {}

    def add(self, held: PairBlock | PairRows, low: int, high: int) -> None:
        i, j = self._cohits(held)
        cohit = np.rint(held.at("cohit", i, j)).astype(np.int64) if isinstance(held, PairRows) or held.members > _TILE or "cohit" in held.held else held.common(_hit, _hit, i, j)
        if self.k is None:
            self.measured += self._measured_pairs(held)
            self.found += len(i)
        counts = {"n": (_measured, _measured), "a_hits": (_hit, _measured), "b_hits": (_measured, _hit)}
        packed = isinstance(held, PairBlock) and held.members <= _TILE and not held.held.keys() & counts.keys()
        n, a, b = (held.common(*f, i, j) if packed else np.rint(held.at(c, i, j)).astype(np.int64) for c, f in counts.items())
        if self.most < 0.5:  # the median is the mean, rounded down or up: a tail from there on is a half or more
            more = cohit * n > a * b
            i, j, cohit, n, a, b = (x[more] for x in (i, j, cohit, n, a, b))
        p = self.tails.of(cohit, n, a, b)
        real = p <= self.most
        if self.k is None:
            values, place, times = np.unique(p[real], return_inverse=True, return_counts=True)
            fewest = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(fewest, place, cohit[real])
            for value, n, few in zip(values.tolist(), times.tolist(), fewest.tolist()):
                before = self.tally.get(value, (0, few))
                self.tally[value] = before[0] + n, min(before[1], few)
            return
        i, j, cohit, n, p = (x[real] for x in (i, j, cohit, n, p))
        same = sum(held.common(f, f, i, j) if packed else np.rint(held.at(c, i, j)).astype(np.int64) for c, f in (("up", _up), ("down", _down)))
        expected = {"a_hits": a[real], "b_hits": b[real]}
        left, right = held.a[i], held.b[j]
        ends = ((low, left, right, expected["a_hits"], expected["b_hits"]), (high, right, left, expected["b_hits"], expected["a_hits"]))
        for block, own, partner, own_hits, other_hits in ends:
            at = self.blocks.get(block)
            items = np.unique(own) if isinstance(held, PairRows) else (held.a if block == low else held.b)
            if at is None:
                at = self.blocks[block] = _FirstSoFar(items, self.k, self.most)
            elif isinstance(held, PairRows):
                at.widen(items)
            row = np.searchsorted(at.items, own)
            here = p <= at.bound[row]
            at.add(row[here], [p[here], -cohit[here], partner[here]], [n[here], own_hits[here], other_hits[here], same[here]])

    def _cohits(self, held: PairBlock | PairRows) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs with enough common hits: from each member's hits, if they are few."""
        if isinstance(held, PairBlock) and "cohit" not in held.held:
            (ra, ma), (rb, mb) = ((s.row[x], s.at[x]) for s in (held.sides[0], held.sides[0 if held.diagonal else 1]) for x in (s.cells[1] != 0,))
            start, end = np.searchsorted(mb, ma, "left"), np.searchsorted(mb, ma, "right")
            size = end - start
            if size.sum() < 4 * len(held.a) * len(held.b):
                right = rb[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]
                times = np.bincount(np.repeat(ra, size) * len(held.b) + right, minlength=len(held.a) * len(held.b))
                i, j = np.divmod(np.flatnonzero(times >= self.least), len(held.b))
                return (i[i < j], j[i < j]) if held.diagonal else (i, j)
        return held.pairs(held.sum("cohit") > self.least - 0.5)

    @staticmethod
    def _measured_pairs(held: PairBlock | PairRows) -> int:
        """The number of pairs that share a member: their words of members are compared, some rows at a time."""
        if isinstance(held, PairRows) or held.members > _TILE or "n" in held.held:
            return len(held.pairs(held.sum("n") > 0.5)[0])
        x, y = held.bits(0, _measured), np.ascontiguousarray(held.bits(1, _measured).T)
        shared, step = 0, max(1, (1 << 15) // max(1, y.shape[1]))
        met, more = np.empty((2, step, y.shape[1]), np.uint64)
        for start in range(0, len(x), step):
            some = x[start : start + step]
            all_, one_ = met[: len(some)], more[: len(some)]
            np.bitwise_and(some[:, :1], y[0], out=all_)
            for w in range(1, x.shape[1]):
                all_ |= np.bitwise_and(some[:, w : w + 1], y[w], out=one_)
            shared += np.count_nonzero(all_)
        return (shared - len(held.a)) // 2 if held.diagonal else shared

    def rows(self) -> Iterable[pd.DataFrame]:
        nothing = {"a": None, "b": None, "cohit": 0, "n": 0, "a_hits": 0, "b_hits": 0, "same": 0}
        if self.k is None:
            yield pd.DataFrame({"what": [_MEASURED, _COHITS], **nothing, "p": 0.0, "times": [self.measured, self.found]})
            times, fewest = ([v[c] for v in self.tally.values()] for c in (0, 1))
            yield pd.DataFrame({"what": _TALLY, **nothing, "p": [*self.tally], "times": times}).assign(cohit=fewest)
            return
        for block in self.blocks.values():
            if (held := block.rows()) is not None:
                a, (p, cohit, b), (n, own, other, same) = held
                yield pd.DataFrame({"what": _FIRST, "a": a, "b": b, "cohit": -cohit, "n": n, "a_hits": own, "b_hits": other, "same": same, "p": p, "times": 1})


def _cohits(rows: DataFrame, least: int, most: float, k: int | None, block_items: int, task_cells: int) -> DataFrame:
    def finish(held: PairBlock | PairRows) -> pd.DataFrame:
        task = _CohitsSoFar(least, most, k)
        task.add(held, 0, 0 if isinstance(held, PairBlock) and held.diagonal else 1)
        return pd.concat([*task.rows()] or [pd.DataFrame({c.split(" ")[0]: [] for c in _COHIT_ROW.split(", ")})])

    schema = _COHIT_ROW.format(rows.schema["g"].dataType.simpleString())
    more = {"running": lambda: _CohitsSoFar(least, most, k), "block_items": block_items, "task_cells": task_cells, "dtype": np.float32}
    return block_pairs(rows, "g", "s", ["v", "h"], COHIT_SUMS, finish, schema, **more)


def cohit_tally(
    observations: DataFrame, gene: str, screen: str, value: str, hit: str, min_cohit: int, min_screens: int, most: float, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS
) -> tuple[int, int, DataFrame]:
    """The numbers of pairs that share a screen and that share ``min_cohit`` hits, and rows (p, times, fewest) of how many of the latter have a p of ``most`` or less, and with how few common hits.

    The pairs of ``cohit_pairs``, which are counted inside the tasks: no row is made of a pair.
    """
    found = written(_cohits(_hit_rows(observations, gene, screen, value, hit, min_screens), min_cohit, most, None, block_items, task_cells), "tally")
    total = {r["what"]: r["n"] for r in found.filter(F.col("what") != _TALLY).groupBy("what").agg(F.sum("times").alias("n")).collect()}
    return total.get(_MEASURED, 0), total.get(_COHITS, 0), found.filter(F.col("what") == _TALLY).groupBy("p").agg(F.sum("times").alias("times"), F.min("cohit").alias("fewest"))


def first_cohits(
    observations: DataFrame, gene: str, screen: str, value: str, hit: str, min_cohit: int, min_screens: int, most: float, k: int, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS
) -> DataFrame:
    """Each gene's ``k`` partners (rows as of ``cohit_pairs``, in both directions, with rank) of the smallest p, ``most`` or less; then by more common hits, then the smaller one."""
    found = _cohits(_hit_rows(observations, gene, screen, value, hit, min_screens), min_cohit, most, k, block_items, task_cells)
    kept = top_k(found, ["a"], [F.col("p"), F.desc("cohit"), F.col("b")], k)
    expected = F.col("a_hits") * F.col("b_hits") / F.col("n")
    return kept.select("a", "b", "cohit", "n", "a_hits", "b_hits", expected.alias("expected"), (F.col("cohit") / expected).alias("fold"), "p", (F.col("same") / F.col("cohit")).alias("concordance"), "rank")


def _common_hits(rows: DataFrame, least: int, block_items: int, task_cells: int) -> DataFrame:
    """Pairs (a < b, cohit) of genes with ``least`` common hits or more, from the hits alone."""
    def counts(held: PairBlock | PairRows) -> pd.DataFrame:
        i, j = held.pairs(held.sum("cohit") > least - 0.5)
        a, b = held.a[i], held.b[j]
        return pd.DataFrame({"a": np.where(a > b, b, a), "b": np.where(a > b, a, b), "cohit": np.rint(held.at("cohit", i, j)).astype(np.int64)})

    kind = rows.schema["g"].dataType.simpleString()
    hits = rows.filter("h = 1").select("g", "s", "h")
    return block_pairs(hits, "g", "s", ["h"], {"cohit": (one, one)}, counts, f"a {kind}, b {kind}, cohit long", block_items=block_items, task_cells=task_cells, dtype=np.float32)


def cohit_pairs(
    observations: DataFrame, gene: str, screen: str, value: str, hit: str, min_cohit: int = 3, min_screens: int = 1, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS
) -> DataFrame:
    """Genes that are hits in the same screens: a < b, cohit, n (screens that measured both), a_hits and b_hits among
    these, expected, fold, p and concordance (share of common hits with the same strict sign).

    Each block of genes is a set of planes (measured, hit, hit upwards, hit downwards) over its screens. A pair of blocks is one product
    for the common hits; only of pairs with ``min_cohit`` of them the other counts are taken. Where these are few for the genes (``_FEW_PAIRS``), blocks
    hold hits only, and the pairs' other counts come from joins with all rows. Observations are one per gene and screen. Stored while the plan is built.
    """
    rows, sums = written(_hit_rows(observations, gene, screen, value, hit, min_screens), "measured"), COHIT_SUMS
    expected = F.col("a_hits") * F.col("b_hits") / F.col("n")
    of_pair = [
        "a", "b", "cohit", "n", "a_hits", "b_hits", expected.alias("expected"), (F.col("cohit") / expected).alias("fold"),
        hypergeom_sf("cohit", "n", "a_hits", "b_hits").alias("p"), (F.col("same") / F.col("cohit")).alias("concordance"),
    ]
    few = written(_common_hits(rows, max(min_cohit, 1), block_items, task_cells), "cohits")
    if few.count() <= _FEW_PAIRS * rows.agg(F.approx_count_distinct("g")).first()[0]:
        x, y = (rows.select(F.col("g").alias(end), "s", *[F.col(c).alias(f"{c}_{end}") for c in ("v", "h")]) for end in ("a", "b"))
        both_hit = (F.col("h_a") == 1) & (F.col("h_b") == 1)
        counts = few.join(x, "a").join(y, ["b", "s"]).groupBy("a", "b", "cohit").agg(
            F.count("*").alias("n"), F.sum("h_a").alias("a_hits"), F.sum("h_b").alias("b_hits"), F.count_if(both_hit & (F.col("v_a") * F.col("v_b") > 0)).alias("same")
        )
        return counts.select(*of_pair)

    def counts(held: PairBlock) -> pd.DataFrame:
        i, j = held.pairs(held.sum("cohit") > max(min_cohit, 1) - 0.5)
        found = {c: np.rint(held.at(c, i, j)).astype(np.int64) for c in sums}
        turned = held.a[i] > held.b[j]
        return pd.DataFrame(
            {
                "a": np.where(turned, held.b[j], held.a[i]), "b": np.where(turned, held.a[i], held.b[j]), "cohit": found["cohit"], "n": found["n"],
                "a_hits": np.where(turned, found["b_hits"], found["a_hits"]), "b_hits": np.where(turned, found["a_hits"], found["b_hits"]), "same": found["up"] + found["down"],
            }
        )

    kind = observations.schema[gene].dataType.simpleString()
    schema = f"a {kind}, b {kind}, cohit long, n long, a_hits long, b_hits long, same long"
    pairs = block_pairs(rows, "g", "s", ["v", "h"], sums, counts, schema, block_items=block_items, task_cells=task_cells, dtype=np.float32)
    return pairs.select(*of_pair)


def _moment_of(f: Factor, masked: bool) -> Factor:
    """A moment's factor of a value, where ``masked`` only of hits. The same object for the same arguments."""
    return _MASKED.setdefault((f, masked), (lambda x, h: f(x) * h) if masked else (lambda x, h: f(x)))


_MASKED: dict[tuple[Factor, bool], Factor] = {}


def anchored_correlations(
    observations: DataFrame, gene: str, screen: str, value: str, hit: str, least: int, block_items: int = BLOCK_ITEMS, task_cells: int = TASK_CELLS
) -> DataFrame:
    """Pearson's r of genes (a < b, n, r) over the screens that measured both and in which one of them is a hit; null r are left out.

    By inclusion and exclusion: a sum over screens where a or b is a hit is that over a's hits, plus that over b's, minus that over
    common ones; each is a product of two blocks, of the values or of the hits' values.
    """
    rows = observations.select(gene, screen, F.col(value).alias("_x"), F.coalesce(F.col(hit), F.lit(False)).cast("int").alias("_h"))
    ways = {"in_a": (True, False), "in_b": (False, True), "in_both": (True, True)}
    sums = {f"{c}_{w}": (_moment_of(f, p), _moment_of(g, q)) for c, (f, g) in MOMENT_FACTORS.items() for w, (p, q) in ways.items()} | {"common": (one, one)}

    def correlated(held: PairBlock | PairRows) -> pd.DataFrame:
        few = isinstance(held, PairRows)  # then pairs are first told by the screens they share, of which those with a hit are some
        i, j = held.pairs(held.sum("common") > max(least, 1) - 0.5) if few else (..., ...)
        n = held.at("n_in_a", i, j) + held.at("n_in_b", i, j) - held.at("n_in_both", i, j) if few else held.sum("n_in_a") + held.sum("n_in_b") - held.sum("n_in_both")
        enough = n > max(least, 1) - 0.5
        i, j = (i[enough], j[enough]) if few else held.pairs(enough)
        n, sx, sy, sxy, sxx, syy = (held.at(f"{c}_in_a", i, j) + held.at(f"{c}_in_b", i, j) - held.at(f"{c}_in_both", i, j) for c in MOMENTS)
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        real = (vx > 1e-9 * n * sxx) & (vy > 1e-9 * n * syy)  # sums added and taken off leave rests where nothing varies
        r = (n * sxy - sx * sy)[real] / np.sqrt(vx[real] * vy[real])
        a, b = held.a[i][real], held.b[j][real]
        return pd.DataFrame({"a": np.where(a > b, b, a), "b": np.where(a > b, a, b), "n": np.rint(n[real]).astype(np.int64), "r": r})

    kind = observations.schema[gene].dataType.simpleString()
    return block_pairs(rows, gene, screen, ["_x", "_h"], sums, correlated, f"a {kind}, b {kind}, n long, r double", block_items=block_items, task_cells=task_cells)
