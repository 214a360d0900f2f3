"""Byte-level BPE: whole texts to token ids and back.

A text longer than a chunk is cut into overlapping chunks, which are pre-tokenised in parallel. Two
neighbours are stitched at the first boundary of the overlap that both found and that no earlier
character can move. The pieces between stitches are encoded in parallel and their ids concatenated in
order. Decoding concatenates the tokens' raw bytes.

Such a boundary is fixed whatever stands before: no pre-token goes on from a letter to anything but a
letter, from a number to anything but a number, or from other than white space into white space. As the
character before it is no white space, cutting there leaves both sides' pre-tokens as they were.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heddle.llm.common import give_back, pick, table, text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 65_536, 4_096  # characters
#: A boundary is believed up to so many characters before a chunk's end: a contraction reads three.
MARGIN = 3

_FIXED = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")


@functools.cache
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _token_bytes(path: str) -> list[bytes]:
    ranks = encoding(path)._mergeable_ranks
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _path(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


#: The library's own pattern engine runs out of stack on far longer runs of white space than this.
_LONG_BLANK = regex.compile(r"\s{50000}")


def _ids(text: str, path: str) -> bytes:
    known = encoding(path)
    if len(text) >= 50_000 and _LONG_BLANK.search(text):
        matches = regex.finditer(public_tokenizers.PATTERN, text)
        ids = [i for m in matches for i in known._encode_single_piece(m.group())]
    else:
        ids = known.encode_ordinary(text)
    return np.array(ids, "<u4").tobytes()


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker holds at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _bytes(ids: bytes, path: str) -> bytes:
    """The raw bytes of the ids' tokens, one after the other."""
    tokens = _token_bytes(path)
    return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _with_ids(keys: list[str], text_col: str, vocabulary: str, decoded: bool):
    """For mapInArrow: the columns ``keys``, ids for the text column, and with ``decoded`` the bytes of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _path(vocabulary)
        for batch in _small(batches):
            ids = [_ids(text.as_py(), path) for text in batch.column(text_col)]
            columns = {k: batch.column(k) for k in keys} | {"ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([_bytes(x, path) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return run


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Each text as overlapping chunks: the start of chunk k is k strides in."""
    stride = chunk - overlap
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            n = -(-(len(text) - overlap) // stride)
            for k in range(n):
                part = text[k * stride : (k + 1) * stride + overlap if k < n - 1 else len(text)]
                row = [*(pa.array([batch.column(c)[i].as_py()], batch.column(c).type) for c in ("id", "h1", "h2")), pa.array([k], pa.int32()), pa.array([part])]
                yield pa.RecordBatch.from_arrays(row, ["id", "h1", "h2", "k", "part"])


def boundaries(part: str, overlap: int, pattern: str = public_tokenizers.PATTERN) -> tuple[list[int], list[int]]:
    """Fixed boundaries of a chunk's pre-tokens: in its first and, as far as believed, in its last ``overlap`` characters."""
    ends = [m.end() for m in regex.finditer(pattern, part)]
    fixed = [e for e in ends if e <= len(part) - MARGIN and (e <= overlap or e >= len(part) - overlap) and _FIXED.match(part, e)]
    return [e for e in fixed if e <= overlap], [e for e in fixed if e >= len(part) - overlap]


def _pretokenised(batches: Iterator[pa.RecordBatch], stride: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, tails = [], []
        for k, part in zip(batch.column("k").to_pylist(), batch.column("part")):
            head, tail = boundaries(part.as_py(), overlap)
            heads.append([k * stride + e for e in head])
            tails.append([k * stride + e for e in tail])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
            [*batch.schema.names, "head", "tail"],
        )
    give_back()


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """Columns ``id_col`` and ids (binary: token ids as little-endian unsigned 32-bit integers).

    With ``decoded`` also decoded, the bytes that the ids stand for, from the same worker: as ``decode`` gives
    them, without a second process for each task. ``vocabulary`` is a rank file, by its path or by its name among the public tokenizers.

    Defined results: a null text counts as empty and has no ids. Every row is encoded, repeated ones and
    those with null ids as often as they come. Where an overlap holds no fixed boundary (one word or one run
    of white space longer than it) the chunks are encoded as one piece. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    id_type = rows.schema["id"].dataType
    small = F.length("text") <= chunk
    results = ["ids", "decoded"] if decoded else ["ids"]
    result_fields = [T.StructField(c, T.BinaryType()) for c in results]
    out = T.StructType([T.StructField("id", id_type), *result_fields])
    whole = rows.filter(small).mapInArrow(_with_ids(["id"], "text", vocabulary, decoded), out)

    stride = chunk - overlap
    # Of a long text's rows that are the same, one is encoded; its two hashes stand for the text in keys.
    keys = ["id", "h1", "h2"]
    key_fields = [T.StructField("id", id_type), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    long = rows.filter(~small).select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    chunk_fields = T.StructType([*key_fields, T.StructField("k", T.IntegerType()), T.StructField("part", T.StringType())])
    chunks = (
        long.mapInArrow(lambda b: _cut(b, chunk, overlap), chunk_fields)
        .groupBy(*keys, "k")
        .agg(F.first("part").alias("part"), F.count("*").cast("int").alias("copies"))
    )
    longs = T.ArrayType(T.LongType())
    seen = T.StructType([*chunks.schema.fields, T.StructField("head", longs), T.StructField("tail", longs)])
    by_doc = Window.partitionBy(*keys).orderBy("k")
    start = F.col("k") * F.lit(stride).cast("long")
    stitched = (
        chunks.mapInArrow(lambda b: _pretokenised(b, stride, overlap), seen)
        .withColumn("right", F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc))))
        .withColumn("is_last", F.lead("k").over(by_doc).isNull())
        .withColumn("left", F.lag("right").over(by_doc))
        .withColumn("from", F.coalesce("left", start) - start)
        .withColumn("to", F.when(F.col("is_last"), F.length("part")).otherwise(F.coalesce("right", start + stride) - start))
        .withColumn("piece", F.count("left").over(by_doc))
        .select(
            *keys, "copies", "piece", "k",
            F.substring("part", (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("part"),
        )
    )
    pieces = (
        stitched.groupBy(*keys, "copies", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select(*keys, "copies", "piece", F.array_join(F.col("parts.part"), "").alias("text"))
        .repartition(*keys, "piece")
    )
    encoded_fields = T.StructType(
        [*key_fields, T.StructField("copies", T.IntegerType()), T.StructField("piece", T.LongType()), *result_fields]
    )
    joined = (
        pieces.mapInArrow(_with_ids([*keys, "copies", "piece"], "text", vocabulary, decoded), encoded_fields)
        .groupBy(*keys, "copies")
        .agg(F.array_sort(F.collect_list(F.struct("piece", *[F.hex(c).alias(c) for c in results]))).alias("parts"))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .select("id", *[F.unhex(F.array_join(F.col(f"parts.{c}"), "")).alias(c) for c in results])
    )
    return whole.unionByName(joined).select(F.col("id").alias(id_col), *results)


def decode(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``id_col``, ids and decoded: the raw bytes of each row's ids, one after the other. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _path(vocabulary)
        for batch in _small(batches):
            raw = [_bytes(ids.as_py() or b"", path) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    rows = pick(encoded, id=id_col, ids="ids")
    out = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, out).select(F.col("id").alias(id_col), "ids", "decoded")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    encoded = encode(table(spark, sf_dir, "documents"), decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
