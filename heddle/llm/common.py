"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.storage import written  # noqa: F401  operators take it from here

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of ``rows`` at most, which bounds what a worker and Arrow's buffers hold."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > rows or int(spark.conf.get(setting)) <= 0:
        spark.conf.set(setting, str(rows))


def give_back() -> None:
    """Return the memory that allocators keep for later use; a worker that waits for its next task holds none of it."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns named by the values, under the names of the keys.

    Columns are taken by position, so that others may have any names: dots, the same names in other cases,
    or the names that an operator uses inside.
    """
    places = {new: df.columns.index(old) for new, old in wanted.items()}
    return numbered(df).select(*[F.col(f"_{i}").alias(new) for new, i in places.items()])


def numbered(df: DataFrame) -> DataFrame:
    """All columns, named by their places: _0, _1 and so on."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_total(lengths: Column, block: int = 256) -> Column:
    """For each element of an array of longs the sum of the elements before it.

    Built block by block: appending to one array for each element would copy quadratically.
    """
    def blocks_of(xs: Column) -> Column:
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

    def cumulate(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start.cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def build(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(
            cumulate(sums, F.lit(0)),
            lambda starts: F.flatten(
                F.transform(blocks, lambda xs, i: F.slice(cumulate(xs, F.element_at(starts, i + 1)), F.lit(1), F.size(xs)))
            ),
        )

    return let(lengths.cast("array<bigint>"), lambda xs: let(blocks_of(xs), build))


def cut(text: Column, spans: Column, group: int = 64) -> Column:
    """The pieces of ``text`` at sorted ``spans`` (structs of start and exclusive end, in code points).

    Spans are cut out of one stretch per ``group`` of them: ``substring`` walks from the start of its
    string each time, which over the whole text would be quadratic.
    """
    def of_group(xs: Column) -> Column:
        base = F.element_at(xs, 1)["start"]
        stretch = F.substring(text, (base + 1).cast("int"), (F.element_at(xs, -1)["end"] - base).cast("int"))
        return let(
            stretch,
            lambda t: F.transform(
                xs, lambda s: F.substring(t, (s["start"] - base + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            ),
        )

    def groups(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / group).cast("int")
        return F.flatten(
            F.transform(F.sequence(F.lit(0), last), lambda g: of_group(F.slice(xs, g * group + 1, F.lit(group))))
        )

    return F.when(F.size(spans) > 0, let(spans, groups)).otherwise(F.array().cast("array<string>"))
