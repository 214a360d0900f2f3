"""Readers of deposited screens and their metadata. Every column is read as text; numbers are cast leniently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.storage import written

#: Rows of splits that are broadcast, some 300 bytes each.
MOST_SPLITS = 50_000
SCORES = [f"SCORE.{i}" for i in range(1, 6)]
REQUIRED = ["SCREEN_ID", "OFFICIAL_SYMBOL", "HIT"]
SCREEN_COLUMNS = ["SCREEN_ID", "IDENTIFIER_ID", "IDENTIFIER_TYPE", "OFFICIAL_SYMBOL", "ALIASES", "ORGANISM_ID", "ORGANISM_OFFICIAL", *SCORES, "HIT", "SOURCE"]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (screen_id, key, fields) of JSON files that map a screen id to one record or a list of them.

    Files are parsed whole, as maps; entries that are no records are left out.
    """
    text = spark.read.text(path, wholetext=True)
    entry = T.MapType(T.StringType(), T.StringType())
    pairs = text.select(F.explode(F.from_json("value", entry)).alias("key", "json"))
    lists = F.from_json("json", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    single = F.from_json("json", entry)
    records = F.when(F.trim("json").startswith("["), lists).otherwise(F.array(single))
    rows = pairs.select("key", F.explode_outer(records).alias("fields")).filter("fields is not null and size(fields) > 0")
    return rows.select(F.coalesce(F.col("fields")["SCREEN_ID"], F.col("key")).alias("screen_id"), "key", "fields")


_HEADER = r"(?i)^#+\s*SCREEN_ID\t|^SCREEN_ID\t"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their numbers, from 1, within their split of a file; a task reads its splits one after the other, in order."""
    last, reached = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = pa.array(np.arange(batch.num_rows))
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        codes = files.indices.to_numpy()
        new = np.append(True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]))
        starts = np.flatnonzero(new)
        number = ids.to_numpy() - np.repeat(starts, np.diff(np.append(starts, batch.num_rows))) + 1
        first = (files.dictionary[int(codes[0])].as_py(), int(blocks[0]))
        if first == last:
            number[: starts[1] if len(starts) > 1 else None] += reached
        last, reached = (files.dictionary[int(codes[-1])].as_py(), int(blocks[-1])), int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "number"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split of a file: its lines, and its first one if it begins the file. A task has whole splits."""
    seen: dict[tuple[str, int], list] = {}
    for batch in _numbered(batches):
        block, number = batch.column("block").to_numpy(), batch.column("number").to_numpy()
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        for end in np.append(np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])), batch.num_rows - 1).tolist():
            held = seen.setdefault((files.dictionary[int(codes[end])].as_py(), int(block[end])), [0, None])
            held[0], first = int(number[end]), end - int(number[end]) + 1
            if block[end] == 0 and first >= 0:
                held[1] = batch.column("value")[first].as_py()
    found = [(file, block, n, head) for (file, block), (n, head) in seen.items()]
    kinds = {"file": pa.string(), "block": pa.int64(), "n": pa.int64(), "head": pa.string()}
    yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds.values())], [*kinds])


def _split_lines(spark: SparkSession, path: str, in_parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines of all files that are not empty (file, block, value, number in the block); and a row per split of a file: file, block,
    before (lines in the splits before it) and names (the header's, null without one).

    ``in_parts``: the files of a folder are one, in the order of their names, and the headers of all but the first don't count.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").filter("value != ''")
    splits = lines.mapInArrow(_counted, "file string, block long, n long, head string")
    lines = lines.mapInArrow(_numbered, "file string, block long, value string, number long")
    of_file = Window.partitionBy("file").orderBy("block")
    header = F.first("head").over(of_file)
    of_whole = Window.partitionBy(F.regexp_replace("file", "[^/]+$", "")).orderBy("file", "block") if in_parts else of_file
    again = F.coalesce((F.row_number().over(of_whole) > 1) & F.rlike("head", F.lit(_HEADER)), F.lit(False)).cast("long")
    splits = splits.withColumn("again", again)
    before = F.coalesce(F.sum(F.col("n") - F.col("again")).over(of_whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("again")
    names = F.transform(F.split(F.regexp_replace("header", r"^#+\s*", ""), "\t"), lambda c: F.upper(F.trim(c)))
    splits = splits.select("file", "block", before.alias("before"), header.alias("header"))
    return lines, splits.select("file", "block", "before", F.when(F.rlike("header", F.lit(_HEADER)), names).alias("names"))


def _missing(names: str = "names"):
    return F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.coalesce(names, F.array().cast("array<string>")))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` that ``read_tab_files`` leaves out (screen_file), and why (reason)."""
    splits = _split_lines(spark, path)[1].filter("block = 0")
    reason = F.when(F.col("names").isNull(), F.lit("no header")).otherwise(F.concat(F.lit("header without "), F.array_join(_missing(), ", ")))
    return splits.filter(F.size(_missing()) > 0).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("screen_file"), reason.alias("reason"))


def read_tab_files(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """All tab-separated screen files below ``path``: file_screen_id, screen_file, row_number, and one text column per header name.

    Files may differ in their columns, so that each is read by its own header, its first line that is not empty; the last of two columns of
    one name counts. A leading ``#`` of the header is dropped, names are matched without regard to case; files whose header lacks an id,
    symbol or hit column are left out (``rejected_files`` names them). row_number counts the lines of a file that are not empty, the header as 1;
    with ``in_parts`` it goes on through the files of a folder, in the order of their names, as Spark writes one table.

    A file may be read in many splits: lines are numbered within their split, and a row per split tells how many come before it and
    at which places the wanted columns are. These rows are stored while the plan is built and, up to ``MOST_SPLITS``, sent to the
    lines; beyond that, as of very many small files, lines meet them by file and split. So no file is one task.
    """
    lines, splits = _split_lines(spark, path, in_parts)
    last = lambda c: F.when(F.array_contains("names", c), F.size("names") - F.array_position(F.reverse("names"), c)).cast("int")
    places = written(splits.filter(F.size(_missing()) == 0).select("file", "block", "before", F.array(*[last(c) for c in SCREEN_COLUMNS]).alias("places")), "splits")
    places = F.broadcast(places) if places.count() <= MOST_SPLITS else places
    cells = lines.filter(~F.rlike("value", F.lit(_HEADER)) & (F.trim("value") != "")).withColumn("cells", F.split("value", "\t", -1)).join(places, ["file", "block"])
    wanted = [F.trim(F.get("cells", F.get("places", F.lit(k)))).alias(c.lower().replace(".", "_")) for k, c in enumerate(SCREEN_COLUMNS)]
    return cells.select(
        F.regexp_extract("file", r"SCREEN_(\d+)", 1).alias("file_screen_id"), F.regexp_extract("file", r"([^/]+)$", 1).alias("screen_file"),
        (F.col("before") + F.col("number")).alias("row_number"), *wanted,
    )


def staged(rows: DataFrame, version_id: int) -> DataFrame:
    """Rows of ``read_tab_files`` as staging rows: the id in the row counts, blank ones go, scores are numbers or null."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    return rows.filter("screen_id is not null and screen_id != ''").select(
        F.lit(version_id).alias("version_id"), F.col("screen_id").try_cast("long").alias("screen_id"), F.col("identifier_id").try_cast("long").alias("identifier_id"),
        F.col("official_symbol").alias("gene_symbol"), (F.upper("hit") == "YES").alias("hit_flag"), *[number(f"score_{i}").alias(f"score_{i}") for i in range(1, 6)], "screen_file", "row_number",
    )


def unpivot_models(wide: DataFrame, id_col: str) -> DataFrame:
    """A wide table of models by genes, whose headers end in a number in parentheses, as rows (model, gene_id, value)."""
    columns = [c for c in wide.columns if c != id_col]
    rows = wide.unpivot([F.col(f"`{id_col}`").alias("model")], [F.col(f"`{c}`").cast("string").alias(c) for c in columns], "header", "text")
    gene = F.regexp_extract("header", r"\((\d+)\)\s*$", 1).try_cast("long")
    return rows.select("model", gene.alias("gene_id"), F.col("text").try_cast("double").alias("value")).filter("gene_id is not null")
