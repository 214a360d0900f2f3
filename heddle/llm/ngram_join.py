"""N-gram Jaccard join: documents whose sets of word shingles are similar, by MinHash banding.

1. Each text has minima of hash functions over its shingles; bands of them are hashed. How many bands of how
   many rows follows from the recall wanted at the threshold. A byte of each minimum makes the text's sketch.
2. Texts with the same words are one class, which has a number of its own; ids come back at the end.
3. Classes that share a band's hash meet in its bucket; buckets with the same members are one. In a bucket two
   classes are candidates if their sketches agree nearly as often as those of similar texts do, within six
   standard deviations. A bucket ties the candidates to one root each, which makes no more edges than members.
4. Components of these edges hold all candidate pairs. They are verified on the full shingle sets: a matrix
   product over the shingles that two or more members hold counts the common ones of all pairs of two
   blocks. A pair makes no row: a task gives each member its number of links and one edge to a root.
5. Components of the verified links are the classes of near duplicates.

Large buckets and components are cut into blocks, bounded by members and by bytes of text, which meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import give_back, numbered, pick, table, text_batches, written
from heddle.llm.components import connected_components
from heddle.llm.words import mix, text_hashes, window_hashes, window_starts, word_hashes

SHINGLE = 5  # words
THRESHOLD = 0.8
RECALL = 0.99999  # of pairs at the threshold; more similar ones are found more surely
MAX_HASHES = 160
BLOCK_MEMBERS = 1024  # of a bucket or a component compared at a time
BLOCK_BYTES = 4 << 20  # of text in a block, on average
SMALL_MEMBERS = 256  # about so many members of small buckets or components share a task's group
_TILE_WINDOWS, _TILE_COLUMNS = 1 << 15, 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows per band with which ``max_hashes`` hashes reach the recall at the threshold.

    A pair of similarity s shares a band of r rows with probability s**r, one of b bands with 1 - (1 - s**r)**b.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        agree = threshold**rows
        bands = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-agree))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall takes more hashes than allowed")
    return best


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and how many each text has.

    A text of fewer words than a shingle has one shingle, all its words; one without words has none.
    """
    (words,), counts = word_hashes(texts)
    starts = window_starts(counts, size)
    hashes = window_hashes(words, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    n = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes = np.insert(hashes, np.cumsum(n)[short], text_hashes([texts[k] for k in short])[:, 0])
        n[short] = 1
    return hashes, n


def minima(hashes: np.ndarray, n: np.ndarray, functions: int) -> np.ndarray:
    """For each text with shingles, in a row, the least value of each hash function over its shingles."""
    random = np.random.default_rng(5)
    factors = random.integers(0, 2**64, functions, np.uint64) | np.uint64(1)
    shifts = random.integers(0, 2**64, functions, np.uint64)
    sizes = n[n > 0]
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), functions), np.uint64)
    a = 0
    while a < len(sizes):
        begin = int(ends[a] - sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + _TILE_WINDOWS, "right")))
        part = hashes[begin : ends[b - 1]]
        starts = ends[a:b] - sizes[a:b] - begin
        for k in range(functions):
            out[a:b, k] = np.minimum.reduceat(part * factors[k] + shifts[k], starts)
        a = b
    return out


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(least), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(least), band + 1, np.uint64)
        for row in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, band * rows + row])
        out[:, band] = h
    return out.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum: different minima agree in one of 256."""
    return ((least >> np.uint64(16)) & np.uint64(0xFF)).astype(np.uint8)


def fewest_agreements(threshold: float, functions: int) -> int:
    """How many bytes of their sketches similar texts share at least: the mean at the threshold less six standard deviations."""
    mean = threshold * functions
    return max(1, math.floor(mean - 6 * math.sqrt(mean * (1 - threshold))))


def _signatures(frames: Iterator[pd.DataFrame], shingle: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    for whole in frames:
        for start in range(0, len(whole), 500):
            frame = whole.iloc[start : start + 500]
            texts = [t.encode() for t in frame["text"]]
            hashes, n = shingle_hashes(texts, shingle)
            c = text_hashes(texts).view(np.int64)
            has = np.flatnonzero(n > 0)
            keys: list = [None] * len(frame)
            marks: list = [None] * len(frame)
            least = minima(hashes, n, bands * rows)
            for i, key, mark in zip(has, band_hashes(least, bands, rows), sketches(least)):
                keys[i], marks[i] = key, mark.tobytes()
            yield frame[["id", "t", "size"]].assign(c1=c[:, 0], c2=c[:, 1], bands=pd.Series(keys, frame.index, object), sketch=pd.Series(marks, frame.index, object))
        give_back()


def jaccard_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets ``left`` x ``right`` (indices) have a Jaccard similarity of ``threshold`` or more."""
    share = Fraction(threshold).limit_denominator(1_000_000)
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles that one set alone holds are in no intersection
    kept = held[column] > 1
    of, column = of[kept], np.unique(column[kept], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    common = np.zeros((len(left), len(right)))
    row_left, row_right = (np.full(len(sets), -1) for _ in range(2))
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, _TILE_COLUMNS):
        here = slice(*np.searchsorted(column, [a, a + _TILE_COLUMNS]))
        width = min(_TILE_COLUMNS, last - a)
        matrices = []
        for row in (row_left, row_right):
            member = row[of[here]]
            dense = np.zeros(((row >= 0).sum(), width), np.float32)
            dense[member[member >= 0], (column[here] - a)[member >= 0]] = 1
            matrices.append(dense)
        common += matrices[0] @ matrices[1].T
    both = sizes[left][:, None] + sizes[right][None, :] - common
    return (common * share.denominator >= share.numerator * both) & (common > 0)


def _roots(links: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _spread(members: DataFrame, of: str, groups: int) -> DataFrame:
    """Each member of a set (a bucket or component, named by the column ``of``) once for each of the set's ``blocks``.

    New columns: block, its own; low and high, the blocks that meet; group and alone, the task's. Sets of one
    block share groups.
    """
    one = F.col("blocks") == 1
    return (
        members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn("group", F.when(one, F.pmod(F.xxhash64(of), F.lit(groups))).otherwise(F.lit(-1).cast("long")))
        .withColumn("alone", F.when(one, F.lit(0).cast("long")).otherwise(F.col(of)))
        .drop("other", "blocks")
    )


_TASK = ["group", "alone", "low", "high"]


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    block = part["block"].to_numpy()
    return np.flatnonzero(block == part["low"].iloc[0]), np.flatnonzero(block == part["high"].iloc[0])


def _square(n: int, left: np.ndarray, right: np.ndarray, links: np.ndarray) -> np.ndarray:
    """A symmetric matrix of links among ``n`` members from one of some against others."""
    square = np.zeros((n, n), bool)
    square[np.ix_(left, right)] = links
    square |= square.T
    np.fill_diagonal(square, False)
    return square


def _tie(frame: pd.DataFrame, fewest: int) -> pd.DataFrame:
    """Edges (a, b) that tie the candidates of each bucket, or of two of its blocks, to a root."""
    frame = frame.sort_values(["key", "node"])
    marks = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
    nodes, key = frame["node"].to_numpy(), frame["key"].to_numpy()
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(begins, append=len(key))
    twos = begins[sizes == 2]
    block = frame["block"].to_numpy()
    met = (frame["low"].to_numpy()[twos] == frame["high"].to_numpy()[twos]) | (block[twos] != block[twos + 1])
    agree = ((marks[twos] == marks[twos + 1]).sum(axis=1) >= fewest) & met
    out = [pd.DataFrame({"a": nodes[twos + 1][agree], "b": nodes[twos][agree]})]
    for begin, size in zip(begins[sizes > 2], sizes[sizes > 2]):
        left, right = (begin + side for side in _sides(frame.iloc[begin : begin + size]))
        agreed = np.zeros((len(left), len(right)), np.int32)
        for k in range(marks.shape[1]):
            agreed += marks[left, k][:, None] == marks[right, k][None, :]
        roots = _roots(_square(size, left - begin, right - begin, agreed >= fewest))
        tied = np.flatnonzero(roots != np.arange(size))
        out.append(pd.DataFrame({"a": nodes[begin + tied], "b": nodes[begin + roots[tied]]}))
    return pd.concat(out)


def _verify(frame: pd.DataFrame, shingle: int, threshold: float) -> pd.DataFrame:
    """Links within each component of the frame, between its blocks ``low`` and ``high`` (or within the one)."""
    out = []
    for _, part in frame.sort_values(["node", "text"]).drop_duplicates("node").groupby("component"):
        hashes, n = shingle_hashes([t.encode() for t in part["text"]], shingle)
        sets = [np.unique(s) for s in np.split(hashes, np.cumsum(n)[:-1])]
        left, right = _sides(part)
        if not len(left) or not len(right):
            continue
        nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        square = _square(len(nodes), left, right, jaccard_links(sets, left, right, threshold))
        linked = square.any(axis=1)
        out.append(pd.DataFrame({"node": nodes, "root": nodes[_roots(square)], "n": square @ copies})[linked])
    give_back()
    return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "n": []})


class _Found:
    """What the join finds out: tables of signatures and of classes, and which rows are repeated."""

    def __init__(self, given: DataFrame, shingle: int, threshold: float, recall: float, max_hashes: int, block_members: int, block_bytes: int):
        text_batches(given.sparkSession)
        bands, rows = choose_bands(threshold, recall, max_hashes)
        schema = "id long, t long, size long, c1 long, c2 long, bands array<long>, sketch binary"
        #: One row per row with an id; t tells the texts of one id apart.
        self.signatures = written(given.filter("id is not null").mapInPandas(lambda frames: _signatures(frames, shingle, bands, rows), schema), "signatures")
        #: Pairs (id, t) of more than one row.
        self.repeated = self.signatures.groupBy("id", "t").agg(F.count("*").alias("rows")).filter("rows > 1").select("id", "t")
        self.any_repeated = bool(self.repeated.limit(1).count())
        classes = written(
            self.signatures.filter("bands is not null")
            .groupBy("c1", "c2")
            .agg(F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first(F.struct("bands", "sketch")).alias("s"))
            .select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "first", "copies", "size", "s.bands", "s.sketch"),
            "classes",
        )
        candidates = written(connected_components(self._edges(classes, fewest_agreements(threshold, bands * rows), block_members), "candidates"), "candidates")
        verified = written(self._verified(given, classes, candidates, shingle, threshold, block_members, block_bytes), "links")
        tied = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
        links = verified.groupBy("node").agg(F.sum("n").alias("n")).join(tied, "node")
        numbered_classes = classes.select("node", "c1", "c2", "first", "copies").join(links, "node", "left")
        best = numbered_classes.filter("component is not null").groupBy("component").agg(F.min("first").alias("best"))
        #: One row per class: its words' hashes, copies, links to other classes' rows, and the first row (id, t) of its group.
        self.classes = numbered_classes.join(best, "component", "left").select(
            "c1", "c2", "first", F.coalesce("best", "first").alias("best"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        )

    def _edges(self, classes: DataFrame, fewest: int, block_members: int) -> DataFrame:
        keyed = classes.select("node", F.explode("bands").alias("key"))
        members = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
        buckets = keyed.groupBy("key").agg(members.alias("members")).filter("members.n > 1")
        buckets = buckets.groupBy("members").agg(F.min("key").alias("key"))
        blocks = F.ceil(F.col("members.n") / block_members).cast("int")
        met = keyed.join(buckets.select("key", blocks.alias("blocks")), "key").join(classes.select("node", "sketch"), "node")
        groups = math.ceil(classes.count() / SMALL_MEMBERS) + 1
        return _spread(met, "key", groups).groupBy(*_TASK).applyInPandas(lambda frame: _tie(frame, fewest), "a long, b long")

    def _verified(self, given, classes, candidates, shingle, threshold, block_members, block_bytes) -> DataFrame:
        sized = candidates.join(classes.select("node", "first.id", "first.t", "copies", "size"), "node")
        sizes = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_members), F.ceil(F.sum("size") / block_bytes), F.lit(1)).cast("int").alias("blocks"))
        texts = given.select("id", "t", "text")
        if self.any_repeated:
            twice = texts.join(self.repeated, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.min("text").alias("text"))
            texts = texts.join(self.repeated, ["id", "t"], "left_anti").unionByName(twice)
        total = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        groups = max(math.ceil(total.n / SMALL_MEMBERS), math.ceil(total.bytes / block_bytes)) + 1
        spread = _spread(sized.join(sizes, "component").join(texts, ["id", "t"]), "component", groups)
        spread = spread.select(*_TASK, "component", "block", "node", "copies", "text")
        return spread.groupBy(*_TASK).applyInPandas(lambda frame: _verify(frame, shingle, threshold), "node long, root long, n long")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.withColumns({"t": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block_members: int = BLOCK_MEMBERS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, copy_of, class_id, n_links.

    copy_of is the smallest id with the same words in the same order; class_id the smallest id of all that are
    tied by links, each between texts whose shingle sets have a Jaccard similarity of ``threshold`` or more;
    n_links the number of other rows that a row has such a link with, copies included.

    Defined results: words are stretches without white space, as they are. A text of fewer than ``shingle``
    words has all its words as one shingle. A null text or one without words is alone in its class. Ids are
    integers; each row is judged by its own text, so that a repeated row counts as one more copy and rows of
    one id with different texts may be in different classes. Rows without an id have a null class and no links.
    Other columns are ignored.
    """
    given = _given(docs, id_col, text_col)
    found = _Found(given, shingle, threshold, recall, max_hashes, block_members, block_bytes)
    classes = found.classes.select("c1", "c2", F.col("first.id").alias("copy_of"), F.col("best.id").alias("class_id"), "n_links")
    with_words = found.signatures.filter("bands is not null").select("id", "c1", "c2").join(classes, ["c1", "c2"]).drop("c1", "c2")
    alone = lambda rows: rows.select("id", F.col("id").alias("copy_of"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    every = with_words.unionByName(alone(found.signatures.filter("bands is null"))).unionByName(alone(given.filter("id is null")))
    return every.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays of each group of near duplicates: that with the smallest id.

    Of rows of one id the one whose text has the smallest hash stays; of rows alike in id and text the one whose
    columns come first. Rows without an id or without words all stay. Else as in ``near_duplicates``.
    """
    found = _Found(_given(docs, id_col, text_col), shingle, threshold, RECALL, MAX_HASHES, BLOCK_MEMBERS, BLOCK_BYTES)
    rows = found.signatures.filter("bands is not null").select("id", "t", "c1", "c2").join(found.classes.select("c1", "c2", "best"), ["c1", "c2"])
    gone = rows.filter(F.struct("id", "t") != F.col("best")).select("id", "t").distinct()
    at = lambda c: F.col(f"_{docs.columns.index(c)}")
    named = [f"_{i}" for i in range(len(docs.columns))]
    keyed = numbered(docs).withColumns({"id": at(id_col).cast("long"), "t": F.xxhash64(F.coalesce(at(text_col), F.lit("")))})
    kept = keyed.join(gone, ["id", "t"], "left_anti")
    if found.any_repeated:
        again = found.repeated.join(found.signatures.filter("bands is not null").select("id", "t").distinct(), ["id", "t"], "left_semi")
        once = kept.join(again, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.min(F.struct(*named)).alias("row")).select("row.*")
        kept = kept.join(again, ["id", "t"], "left_anti").select(named).unionByName(once)
    return kept.select(named).toDF(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle: right for the oracle's small tables only.
OP9_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE} + 2, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) END AS copy_of,
       least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links
FROM words LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
