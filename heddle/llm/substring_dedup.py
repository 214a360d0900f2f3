"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Documents are dealt into blocks by a hash of their ids and texts. Three passes over the blocks find the repeats:

1. Each block makes a sketch of its windows: for each row of a count-min sketch the cells its windows fall
   into, once or more often. Sketches are cut into shards by cell and merged shard by shard. A merged cell
   that counts two or more may hold a repeated window, and every repeated window's cells do; each block
   gets back which of its cells these are.
2. Windows whose cells all count two or more are estimated repeated. Each block sends their 128-bit hashes,
   one record per different window with the id of the first document, again in shards; a shard groups them
   exactly and answers which records are not the first of their window.
3. Each block marks the later occurrences and removes the words they cover.

The sketch overestimates only, so that no repeated window is lost. Its width grows with the number of
words, the number of shards with the width and that of blocks with the bytes: no task holds more than one block
or shard. Each block has a record for each shard, so that beyond 32 GiB blocks and shards also get larger, with the
square root of the bytes, up to 16 times: records then stay as large as before up to 8 TiB, and hold about five windows
at 100 TB. The hashes and cells of a block of 64 MiB take 0.9 GB. A window in a third of all documents makes one record per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import give_back, pick, table, text_batches
from heddle.llm.words import mix, window_hashes, window_starts, word_hashes

WINDOW = 20
BLOCK_BYTES = 4 << 20  # of text in a block
ROWS = 2  # of the sketch
CELLS_PER_BYTE = 0.75  # of each row: four or more per word
SHARD_BITS = 22  # cells of a shard, as a power of two
EXACT_SHARD_BYTES = 6 << 20  # of text whose candidate windows meet in one shard
GROW_FROM, MOST_GROWTH = 32 << 30, 4  # bytes of text from which blocks and shards grow, and how often they double

_MESSAGE = "block long, kind int, shard long, answer binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: the high bytes of small numbers take next to nothing."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def growth(size: int, grow_from: int = GROW_FROM) -> int:
    """How often blocks and shards double for ``size`` bytes of text: half as often as the bytes themselves."""
    return min(MOST_GROWTH, max(0, math.ceil(math.log2(max(size, 1) / grow_from) / 2)))


class _Block:
    """The windows of a block's documents, in the order of ids."""

    def __init__(self, frame: pd.DataFrame, window: int, bits: int, which: tuple[int, ...] = (0,)):
        # documents without an id come first, all else by id; rows of one id by their hash, as the blocks are
        frame = frame.sort_values(["missing", "id", "hash", "text"], ascending=[False, True, True, True])
        self.missing, self.ids = frame["missing"].to_numpy(), frame["id"].to_numpy()
        self.texts = [text.encode() for text in frame["text"]]
        self.window, self.bits = window, bits
        hashes, self.counts = word_hashes(self.texts, which)
        self.starts = window_starts(self.counts, window)
        self.hashes = [window_hashes(h, window, w)[self.starts] for h, w in zip(hashes, which)]

    def cells(self, row: int) -> np.ndarray:
        return mix(self.hashes[0] + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> np.uint64(64 - self.bits)

    def estimated(self, answers: dict[tuple[int, int], bytes], shard_bits: int) -> np.ndarray:
        """Places among the windows of those estimated repeated."""
        hit = np.ones(len(self.starts), bool)
        for row in range(ROWS):
            cells, at = np.unique(self.cells(row), return_inverse=True)
            shards = cells >> np.uint64(shard_bits)
            many = np.zeros(len(cells), bool)
            for a, b in _stretches(shards):
                many[a:b] = _mask(answers[0, row << 40 | int(shards[a])], b - a)
            hit &= many[at]
        return np.flatnonzero(hit)

    def firsts(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the candidates by hash, where in it each different window begins, and which one each belongs to."""
        h1, h2 = (h[candidates] for h in self.hashes)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        return order, np.flatnonzero(new), np.cumsum(new) - 1


def _stretches(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal sorted keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return zip([0, *edges] if len(keys) else [], [*edges, len(keys)] if len(keys) else [])


def _answers(frame: pd.DataFrame) -> dict[tuple[int, int], bytes]:
    return {(k, s): a for k, s, a in zip(frame["kind"], frame["shard"], frame["answer"])}


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_bits: int = SHARD_BITS,
    exact_shard_bytes: int = EXACT_SHARD_BYTES,
    grow_from: int = GROW_FROM,
) -> DataFrame:
    """Columns ``id_col``, n_words, n_removed, kept (the kept words joined by one space).

    Words are stretches without white space. A word is removed if a window of ``window`` words of its document
    covers it whose words also start earlier: in a document with a smaller id, or earlier in the same one.
    Windows are judged on the input.

    Ids are integers.

    Defined results: a null text has no words. Texts shorter than the window stay whole. Rows of one id count as
    documents of that id in the order of a hash of id and text. Rows without an id come before all others, in a
    fixed order of their own. Other columns are ignored; an empty table gives no rows. Rows alike in id and text share a block.
    """
    text_batches(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").isNull().alias("missing"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    grown = growth(size, grow_from)
    block_bytes, exact_shard_bytes, shard_bits = block_bytes << grown, exact_shard_bytes << grown, shard_bits + grown
    blocks = max(1, math.ceil(size / block_bytes))
    bits = max(shard_bits, math.ceil(math.log2(size * CELLS_PER_BYTE + 1)))
    exact_bits = max(0, math.ceil(math.log2(size / exact_shard_bytes + 1e-9))) if size else 0
    # blocks are ranges of the hash, so that their order is that of the rows of one id
    place = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * blocks)
    rows = rows.withColumn("hash", F.xxhash64("id", "text"))
    blocked = rows.select(F.least(place, F.lit(blocks - 1)).alias("block"), "missing", "id", "hash", "text")

    def sketch(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = _Block(frame, window, bits)
        out = []
        for row in range(ROWS):
            cells, counts = np.unique(held.cells(row), return_counts=True)
            shards = cells >> np.uint64(shard_bits)
            for a, b in _stretches(shards):
                inside = (cells[a:b] & np.uint64((1 << shard_bits) - 1)).astype(np.uint32)
                out.append((row << 40 | int(shards[a]), key[0], _pack(np.diff(inside, prepend=np.uint32(0))), _bits(counts[a:b] > 1)))
        give_back()
        return pd.DataFrame(out, columns=["shard", "block", "cells", "again"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << shard_bits, np.uint8)
        for data, again in zip(frame["cells"], frame["again"]):
            cells = np.cumsum(_unpack(data, np.uint32), dtype=np.int64)
            total[cells] = np.minimum(total[cells] + 1 + _mask(again, len(cells)), 2)
        answers = [_bits(total[np.cumsum(_unpack(data, np.uint32), dtype=np.int64)] > 1) for data in frame["cells"]]
        return pd.DataFrame({"block": frame["block"], "kind": np.int32(0), "shard": key[0], "answer": answers})

    def candidates(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame):
            held = _Block(frame, window, bits, (0, 1))
            places = held.estimated(_answers(answers), shard_bits)
            order, begins, _ = held.firsts(places)
            first = places[order[begins]]
            h1, h2 = (h[first] for h in held.hashes)
            document = np.searchsorted(np.cumsum(held.counts), held.starts[first], "right")
            ids = np.where(held.missing, np.iinfo(np.int64).min, held.ids)[document]
            shards = h1 >> np.uint64(64 - exact_bits) if exact_bits else np.zeros(len(h1), np.uint64)
            for a, b in _stretches(shards):
                out.append((int(shards[a]), key[0], h1[a:b].tobytes(), h2[a:b].tobytes(), ids[a:b].tobytes()))
        give_back()
        return pd.DataFrame(out, columns=["shard", "block", "h1", "h2", "ids"])

    def group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        columns = [np.frombuffer(b"".join(frame[c]), dtype) for c, dtype in (("h1", np.uint64), ("h2", np.uint64), ("ids", np.int64))]
        h1, h2, ids = columns
        order = np.lexsort((ids, h2, h1))
        later = np.zeros(len(order), bool)
        later[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        ends = np.cumsum([len(x) // 8 for x in frame["ids"]])
        answers = [_bits(x) for x in np.split(later, ends[:-1])]
        return pd.DataFrame({"block": frame["block"], "kind": np.int32(1), "shard": key[0], "answer": answers})

    def remove(key: tuple, frame: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"missing": [], "id": [], "n_words": [], "n_removed": [], "kept": []})
        held = _Block(frame, window, bits, (0, 1))
        answers = _answers(messages)
        places = held.estimated(answers, shard_bits)
        order, begins, of = held.firsts(places)
        h1 = held.hashes[0][places[order[begins]]]
        shards = h1 >> np.uint64(64 - exact_bits) if exact_bits else np.zeros(len(h1), np.uint64)
        later_here = np.zeros(len(h1), bool)
        for a, b in _stretches(shards):
            later_here[a:b] = _mask(answers[1, int(shards[a])], b - a)
        later = np.ones(len(order), bool)  # all but a window's first in the block
        later[begins] = later_here
        starts = held.starts[places[order[later]]]
        n = int(held.counts.sum())
        depth = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)[: n + 1]
        keep = np.cumsum(depth[:n]) == 0
        kept, removed, at = [], [], 0
        for text, count in zip(held.texts, held.counts):
            own = keep[at : at + count]
            at += count
            words = text.split()
            kept.append(b" ".join(words if own.all() else [words[i] for i in np.flatnonzero(own)]).decode())
            removed.append(count - int(own.sum()))
        give_back()
        return pd.DataFrame({"missing": held.missing, "id": held.ids, "n_words": held.counts, "n_removed": removed, "kept": kept})

    by_block = blocked.groupBy("block")
    merged = (
        by_block.applyInPandas(sketch, "shard long, block long, cells binary, again binary")
        .groupBy("shard").applyInPandas(merge, _MESSAGE)
    )
    grouped = (
        by_block.cogroup(merged.groupBy("block"))
        .applyInPandas(candidates, "shard long, block long, h1 binary, h2 binary, ids binary")
        .groupBy("shard").applyInPandas(group, _MESSAGE)
    )
    out = "missing boolean, id long, n_words long, n_removed long, kept string"
    removed = by_block.cogroup(merged.unionByName(grouped).groupBy("block")).applyInPandas(remove, out)
    return removed.select(F.when(~F.col("missing"), F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove windows of 20 words that start earlier elsewhere from every document."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM words WHERE len(ws) >= {WINDOW})),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT i + shift) AS places FROM later, range({WINDOW}) s(shift) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
covered AS (SELECT doc_id, unnest(places) AS i, true AS c FROM gone),
kept AS (
  SELECT doc_id, count(*) FILTER (c) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (c IS NULL) AS text
  FROM each LEFT JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
