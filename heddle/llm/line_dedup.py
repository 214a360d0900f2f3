"""Line dedup: windows of three consecutive lines that have occurred before are removed.

Windows overlap. Each is hashed to 128 bits, the first occurrence of every repeated window is found over all
documents, and later occurrences are removed by merging the lines that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import give_back, numbered, table, text_batches

LINES = 3
#: A line that counts holds a word, that is a character other than these.
_BLANKS = " \t\n\x0b\x0c\r"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _without_covered(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed = [], []
        for text, places in zip(batch.column("text"), batch.column("places")):
            text, places = text.as_py(), places.as_py()
            if not places:
                texts.append(text)
                removed.append(0)
                continue
            split = (text or "").split("\n")
            counting = [i for i, line in enumerate(split) if line.strip(_BLANKS)]
            covered = np.zeros(len(split), bool)
            for place in places:
                covered[counting[place : place + lines]] = True
            texts.append("\n".join(line for line, gone in zip(split, covered) if not gone))
            removed.append(int(covered.sum()))
        keys = [c for c in batch.schema.names if c not in ("text", "places")]
        arrays = [*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*keys, "text", "n_removed"])
    give_back()


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """All rows of ``docs`` with ``text_col`` as kept, and n_removed, the number of lines removed.

    Lines are split at line feeds and compared as they are. Windows run over ``lines`` consecutive lines that
    hold a word; blank lines are passed over and stay. A line goes if a window covers it that also starts
    earlier: in a document with a smaller id (none comes first), or earlier in the same one.

    Defined results: a null text stays null. Rows with the same id and text are one document, whose repeats
    count once; rows of one id with different texts are successive documents in a fixed order. Texts with
    fewer counting lines stay whole. Other columns pass through unchanged, whatever their names, except that
    n_removed is replaced.
    """
    text_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c != "n_removed"]
    others = [F.col(f"_{i}") for i in kept if i != text_at] or [F.lit(0).alias("none")]
    packed = numbered(docs).select(
        F.col(f"_{docs.columns.index(id_col)}").alias("id"),
        F.xxhash64(f"_{text_at}").alias("t"),
        F.col(f"_{text_at}").alias("text"),
        F.struct(*others).alias("row"),
    )
    counting = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: F.rlike(line, F.lit(_HAS_WORD)))
    windows = (
        packed.select("id", "t", counting.alias("lines"))
        .filter(F.size("lines") >= lines)
        .select("id", "t", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("lines") - lines + 1),
            lambda i: F.array_join(F.slice("lines", i, F.lit(lines)), "\n"),
        )).alias("place", "window"))
        .select("id", "t", "place", F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2"))
    )
    at = F.struct("id", "t", "place")
    repeated = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    places = (
        windows.join(repeated, ["h1", "h2"])
        .filter(~F.struct("id", "t", "place").eqNullSafe(F.col("first")))
        .groupBy("id", "t")
        .agg(F.collect_set("place").alias("places"))
        .select(F.col("id").alias("id2"), F.col("t").alias("t2"), "places")
    )
    joined = packed.join(places, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left").select("row", "text", "places")
    out = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])
    done = joined.mapInArrow(lambda batches: _without_covered(batches, lines), out)
    ordered = [F.col("text") if i == text_at else F.col(f"row._{i}") for i in kept]
    return done.select(*ordered, "n_removed").toDF(*[docs.columns[i] for i in kept], "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove windows of three lines that occurred before from every document."""
    kept = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln
  FROM documents),
counting AS (
  SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS place
  FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\x0c\\r]')),
windows AS (
  SELECT doc_id, place, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM counting WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
later AS (
  SELECT doc_id, place FROM (
    SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, place) AS occurrence FROM windows WHERE win IS NOT NULL)
  WHERE occurrence > 1),
covered AS (SELECT DISTINCT doc_id, place + shift AS place FROM later, (VALUES (0), (1), (2)) s(shift)),
kept AS (
  SELECT l.doc_id, l.ln, l.line, v.place IS NOT NULL AS gone
  FROM lines l LEFT JOIN counting c USING (doc_id, ln) LEFT JOIN covered v ON v.doc_id = c.doc_id AND v.place = c.place),
texts AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS text
  FROM kept GROUP BY doc_id)
SELECT doc_id, n_removed, CASE WHEN d.text IS NOT NULL THEN length(t.text) END AS kept_chars,
       CASE WHEN d.text IS NOT NULL THEN sha256(t.text) END AS kept_sha256
FROM texts t JOIN documents d USING (doc_id)
"""
