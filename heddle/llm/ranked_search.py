"""Ranked lexical search: the best documents for every item of a query set, by WAND over shards of documents.

Two scans of the documents, without a shuffle of texts. The first one counts documents, terms and, of the terms that the
items use, in how many documents each occurs. The second takes each task's documents in shards of bounded bytes. A shard gets
postings of the items' terms, each with its impact (what it adds to its document's score), and each term's largest
impact. WAND then goes through an item's postings by document: in the order of their next documents, terms are
added up until their largest impacts reach the item's threshold, the k-th best score so far. The term where they do is the
pivot; what comes before its document cannot reach the threshold and is skipped. Heaps are kept from shard to shard of a
task, so that thresholds rise, and the heaps of all tasks are merged in two levels.

The query set is taken in blocks of bounded bytes; a block's terms go along with the tasks. All scores are integers.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import give_back, pick, table, text_batches, written

SHARD_BYTES = 4 << 20  # of text in a shard
BLOCK_BYTES = 16 << 20  # of the items' texts in a block
MERGES = 64  # heaps of an item are merged in so many parts first

#: Saturation and length parameters of the score: w * tf / (tf + 2 * (1/2 + 1/2 * n / mean n)), in integers.
SCALE, TF_FACTOR, M_FACTOR, M_BASE, M_SLOPE = 10**9, 1000, 20, 50, 50

#: Separators become blanks, A-Z lower case; all bytes of other characters stay.
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_AS_TERMS = bytes(c if c in _LETTERS else 0x20 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_END = 1 << 62
_NO_ID = 1 << 63  # larger than any id


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: stretches of digits, letters and all characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_AS_TERMS).split()


def weight(documents: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Postings of the known terms in some documents, in the order given: per term documents, impacts and the largest impact."""

    def __init__(self, texts: list[list[bytes]], known: dict[bytes, int], weights: np.ndarray, documents: int, total: int):
        get = known.get
        found = np.fromiter((get(word, -1) for words in texts for word in words), np.int64)
        sizes = [len(words) for words in texts]
        # Python's integers: a very long document times the number of documents may exceed a long
        lengths = np.array([M_BASE + M_SLOPE * n * documents // max(total, 1) for n in sizes], np.int64)
        keys = (found * len(texts) + np.repeat(np.arange(len(texts)), sizes))[found >= 0]
        keys, tf = np.unique(keys, return_counts=True)
        term, self.document = np.divmod(keys, max(len(texts), 1))
        self.impact = weights[term] * (SCALE * tf // (TF_FACTOR * tf + M_FACTOR * lengths[self.document]))
        new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.impact, new) if len(term) else new
        self.where = dict(zip(term[new].tolist(), zip(new.tolist(), np.append(new[1:], len(term)).tolist(), most.tolist())))
        self.lists: dict[int, tuple[list, list, int]] = {}

    def postings(self, term: int) -> tuple[list, list, int] | None:
        if term not in self.lists and term in self.where:
            a, b, most = self.where[term]
            self.lists[term] = [*self.document[a:b].tolist(), _END], self.impact[a:b].tolist(), most
        return self.lists.get(term)


def wand(postings: list[tuple[list, list, int]], ids: list[int], k: int, heap: list[tuple[int, int]]) -> int:
    """Put the best documents of a shard into ``heap``, of at most ``k`` scores with negated ids; how many documents were scored.

    ``postings`` are one item's, each with documents in ascending order and an end mark, impacts, and the largest impact.
    """
    postings = [p for p in postings if p[2] > 0]
    documents, impacts, most = [p[0] for p in postings], [p[1] for p in postings], [p[2] for p in postings]
    at, now = [0] * len(postings), [d[0] for d in documents]
    order, scored = sorted(range(len(postings)), key=now.__getitem__), 0
    while True:
        # an equal score is not enough to skip: a smaller id would go first
        threshold, bound, pivot = heap[0][0] if len(heap) == k else 1, 0, _END
        for t in order:
            bound += most[t]
            if bound >= threshold:
                pivot = now[t]
                break
        if pivot == _END:
            return scored
        if now[order[0]] == pivot:
            score = 0
            for t in order:
                if now[t] != pivot:
                    break
                score += impacts[t][at[t]]
                at[t] += 1
                now[t] = documents[t][at[t]]
            scored += 1
            found = (score, -ids[pivot])
            if len(heap) < k:
                if score > 0:
                    heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)
        else:
            for t in order:
                if now[t] >= pivot:
                    break
                at[t] = bisect_left(documents[t], pivot, at[t])
                now[t] = documents[t][at[t]]
        order.sort(key=now.__getitem__)


def _shards(frames: Iterator[pd.DataFrame], shard_bytes: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Ids and terms of documents, some bytes of text at a time."""
    ids, texts, size = [], [], 0
    for frame in frames:
        for doc, missing, text in zip(frame["id"], frame["missing"], frame["text"]):
            ids.append(_NO_ID if missing else int(doc))
            texts.append(terms_of(text))
            size += len(text)
            if size >= shard_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _counted(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """How many documents have a term, how many terms they have, and how many of them hold each known one."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, holding, documents, total = known.keys(), Counter(), 0, 0
        names = frozenset(names)
        for frame in frames:
            for text in frame["text"]:
                words = terms_of(text)
                documents += bool(words)
                total += len(words)
                holding.update(names.intersection(words))
        rows = [(-2, total), (-1, documents), *((known[word], n) for word, n in holding.items())]
        yield pd.DataFrame(rows, columns=["term", "n"])
        give_back()

    found = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {row.term: row.n for row in found}  # one row per term of the block
    return counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(t, 0) for t in range(len(known))], np.int64)


def _best_of_tasks(docs: DataFrame, items: list[list[bytes]], k: int, shard_bytes: int) -> DataFrame:
    """Columns item (its place in the list), part, score, id, missing: the best documents of every task."""
    known = {word: n for n, word in enumerate(sorted({word for words in items for word in words}))}
    documents, total, holding = _counted(docs, known)
    weights = np.array([weight(documents, n) for n in holding.tolist()], np.int64)
    wanted = [[known[word] for word in words] for words in items]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for ids, texts in _shards(frames, shard_bytes):
            held = Shard(texts, known, weights, documents, total)
            for heap, terms in zip(heaps, wanted):
                wand([p for t in terms if (p := held.postings(t))], ids, k, heap)
        rows = [(item, item_score, -negated) for item, heap in enumerate(heaps) for item_score, negated in heap]
        item, score, doc = zip(*rows) if rows else ((), (), ())
        missing = [x == _NO_ID for x in doc]
        kept = [0 if x == _NO_ID else x for x in doc]
        yield pd.DataFrame({"item": np.array(item, np.int64), "score": np.array(score, np.int64), "id": np.array(kept, np.int64), "missing": np.array(missing, bool)})
        give_back()

    return docs.mapInPandas(search, "item long, score long, id long, missing boolean").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``item_id``, rank (from 1), ``doc_id``, score: the ``k`` best documents of each item with a score above 0.

    Terms are stretches of digits, letters and characters beyond ASCII, with A-Z in lower case. An item's terms count once
    each, a document's as often as they come; a rarer term weighs more, a longer document less. Ids are integers.

    Defined results: a null or empty text has no terms; documents without terms count nowhere, items without terms have no rows.
    Equal scores go by ascending document id, documents without an id last. Each row of ``docs`` is a document, repeated
    ones too. Items alike in id and text are one; one id with several texts is ranked once for each of them. Other columns
    are ignored. A document is one row, and so its terms are one task's.
    """
    text_batches(docs.sparkSession)
    texts = pick(docs, id=doc_id, text=doc_text)
    texts = texts.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNull().alias("missing"), F.coalesce("text", F.lit("")).alias("text"))
    asked = pick(items, id=item_id, text=item_text).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for block in range(blocks):
        here = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        terms = [sorted(set(terms_of(row.text))) for row in here]
        numbers = docs.sparkSession.createDataFrame([(n, row.id) for n, row in enumerate(here)], f"item long, item_id {asked.schema['id'].dataType.simpleString()}")
        best = _best_of_tasks(texts, terms, k, shard_bytes)
        for keys in (["item", "part"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), "missing", "id")
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = best.join(numbers, "item").select(
            F.col("item_id").alias(item_id), "rank", F.when(~F.col("missing"), F.col("id")).alias(doc_id), "score"
        )
        ranked = written(ranked, "ranked") if blocks > 1 else ranked
        found = ranked if found is None else found.unionByName(ranked)
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every item of the benchmark."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
counted AS (SELECT k, doc_id, len(ws) AS n FROM texts WHERE len(ws) > 0),
stats AS (SELECT count(*) AS documents_n, CAST(sum(n) AS BIGINT) AS terms_n FROM counted),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM texts) SEMI JOIN asked USING (term) GROUP BY k, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term),
impacts AS (
  SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents_n) // terms_n))) AS impact
  FROM tf JOIN weighed USING (term) JOIN counted USING (k), stats),
scored AS (SELECT item_id, k, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, k),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored JOIN counted USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
