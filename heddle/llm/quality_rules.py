"""Quality rules: simple counts, and how well a public vocabulary fits a text.

A text in a language the vocabulary knows takes few tokens, hardly any single bytes, and many different
tokens. Per row three figures are measured: characters per token, the share of byte-fallback tokens, and
the entropy of the tokens in bits, as the mean over blocks of 50 tokens so that it does not depend on a
text's length. Bands per language, or per script where a language has too few labelled rows, say which
figures are ordinary; they come from rows labelled as good. A row outside its band is rejected. How many
standard deviations wide bands are follows from the labelled rows too: half as much again as the deviation
that one in a thousand of them exceeds, and no less than five.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import give_back, numbered, pick, table, text_batches, written

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

BLOCK = 50  # tokens

#: A band needs so many labelled rows.
MIN_LABELLED = 30
#: Widths in standard deviations: ``MARGIN`` times what this share of labelled rows exceeds, or ``MIN_WIDTH`` if that is more.
EXCEEDED, MARGIN, MIN_WIDTH = 0.001, 1.5, 5.0
#: The share of byte-fallback tokens that any band allows beyond its mean.
MIN_FALLBACK_SLACK = 0.05
#: Bands are broadcast up to this many of them.
BROADCAST_BANDS = 10_000


@functools.cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _path(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


class _Words:
    """Token ids of words, each word of a batch encoded once."""

    def __init__(self, path: str):
        self.known = processor(path)
        self.is_byte = np.array([self.known.is_byte(i) for i in range(self.known.get_piece_size())])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has. Encoding takes time in proportion to a word's length."""
        ids = self.known.encode([word.decode() for word in words], num_threads=1) if words else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def _measure(text: str, index: dict[bytes, int], words: list[bytes]) -> tuple:
    """The counts of one text, and the numbers of its words in ``index``, which grows by new ones."""
    n = len(words)
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    word_chars = len(text) - sum(text.count(c) for c in _BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    repeated = 0
    if n >= 3:
        # three numbers of words as one: a text's own numbers are small
        _, own = np.unique(codes, return_inverse=True)
        k = int(own.max()) + 1
        first = own[:-2] * k + own[1:-1]
        if k >= 2_000_000:
            first = np.unique(first, return_inverse=True)[1]
        _, at, count = np.unique(first * k + own[2:], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[at] > 1)
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[starts + shift] = True
        repeated = int(covered.sum())
    return (n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated), codes


def block_entropies(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean entropy over blocks of ``BLOCK`` tokens of each text; ids of all texts in order, sizes per text.

    The last block is a text's last ``BLOCK`` tokens; a shorter text is one block.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    result = np.zeros(len(sizes))
    for k in np.flatnonzero((sizes > 0) & (sizes < BLOCK)):
        share = np.unique(ids[starts[k] : ends[k]], return_counts=True)[1] / sizes[k]
        result[k] = -(share * np.log2(share)).sum()
    full = np.flatnonzero(sizes >= BLOCK)
    if not len(full):
        return result
    blocks = -(-sizes[full] // BLOCK)
    of = np.repeat(full, blocks)
    first = np.cumsum(blocks) - blocks
    at = starts[of] + (np.arange(len(of)) - np.repeat(first, blocks)) * BLOCK
    at = np.minimum(at, ends[of] - BLOCK)
    rows = np.sort(ids[at[:, None] + np.arange(BLOCK)], axis=1)
    begins = np.ones(rows.shape, bool)
    begins[:, 1:] = rows[:, 1:] != rows[:, :-1]
    places = np.flatnonzero(begins)
    runs = np.diff(places, append=rows.size)
    of_row = np.add.reduceat(runs * np.log2(runs), np.flatnonzero(places % BLOCK == 0))
    entropy = np.log2(BLOCK) - of_row / BLOCK
    result[full] = np.add.reduceat(entropy, first) / blocks
    return result


#: First and last code points of the letters that tell scripts apart.
_SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "arabic": [(0x600, 0x6FF)],
    "indic": [(0x900, 0xDFF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)],
}


def script_of(text: str) -> str:
    """The script that most letters belong to; ``other`` if none does."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for name, ranges in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def _figures(batches: Iterator[pa.RecordBatch], vocabulary: str, keep_text: bool, names: list[str], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """The batches' columns, their first one (the text) only if it is to be kept, and all that is measured of the texts."""
    encoder = _Words(_path(vocabulary))
    for batch in (whole.slice(start, rows) for whole in batches for start in range(0, whole.num_rows, rows)):
        index: dict[bytes, int] = {}
        counts, codes, scripts = [], [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            row, code = _measure(text, index, text.encode().split())
            counts.append(row)
            codes.append(code)
            scripts.append(script_of(text))
        word_ids, word_sizes = encoder.encode(list(index))
        word_starts = np.cumsum(word_sizes) - word_sizes
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        many = word_sizes[code]
        # the ids of all texts' words, by their places among the ids of the batch's words
        ids = word_ids[np.repeat(word_starts[code] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        of_word = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        sizes = np.bincount(of_word, many, len(codes)).astype(np.int64)
        in_bytes = np.bincount(np.repeat(of_word, many), encoder.is_byte[ids], len(codes))
        numbers = np.array(counts, np.int64).reshape(-1, len(_COUNTS))
        length = np.minimum(np.log2(np.maximum(-(-sizes // BLOCK), 1)).astype(np.int32), LONGEST)
        chars = numbers[:, _COUNTS.index("word_chars")]
        figures = [chars / np.maximum(sizes, 1), in_bytes / np.maximum(sizes, 1), block_entropies(ids, sizes)]
        measured = [*np.ascontiguousarray(numbers.T), *figures, pa.array(scripts, pa.string()), length]
        given = batch.columns if keep_text else batch.columns[1:]
        yield pa.RecordBatch.from_arrays([*given, *map(pa.array, measured)], names)
    give_back()


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FIGURES = ["chars_per_token", "fallback_share", "token_entropy"]
#: Lengths of texts that have bands of their own: by doublings of the number of blocks, the last one open.
LONGEST = 4
ANY_LENGTH = -1


def _measured(rows: DataFrame, vocabulary: str, keep_text: bool) -> DataFrame:
    """``rows``, whose first column is the text, with the counts and figures."""
    text_batches(rows.sparkSession)
    fields = list(rows.schema.fields if keep_text else rows.schema.fields[1:])
    fields += [T.StructField(c, T.LongType()) for c in _COUNTS]
    fields += [T.StructField(c, T.DoubleType()) for c in _FIGURES]
    fields += [T.StructField("script", T.StringType()), T.StructField("length", T.IntegerType())]
    names = [f.name for f in fields]
    return rows.mapInArrow(lambda batches: _figures(batches, vocabulary, keep_text, names), T.StructType(fields))


def measure(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, lang, the five counts, the three figures, script, length (a class of 0 to 4).

    Defined results: a null text counts as empty, which has zeros and the script ``other``. Words are encoded whole,
    however long. Other columns are ignored.
    """
    rows = pick(docs, text=text_col, id=id_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    return _measured(rows, vocabulary, False).withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def fit_bands(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", min_labelled: int = MIN_LABELLED) -> DataFrame:
    """Bands from all measured rows that are labelled as good (1) and pass the base rules.

    Columns by (``lang`` or ``script``), name, length, min_chars, max_chars, max_fallback and min_entropy. There is
    one band per length, as figures of short texts vary more, and one for any length. Those with fewer than
    ``min_labelled`` such rows are left out. Labels with a null id or quality don't count.
    """
    good = pick(labels, id=id_col, quality=quality_col).filter("quality = 1").select(F.col("id").alias(id_col)).distinct()
    rows = measured.filter(~base_failed()).join(good, id_col, "left_semi")
    names = [F.struct(F.lit(by).alias("by"), F.col(by).alias("name"), length.alias("length")) for by in ("lang", "script") for length in (F.col("length"), F.lit(ANY_LENGTH))]
    named = rows.select(F.explode(F.array(*names)).alias("band"), *_FIGURES).filter("band.name is not null")
    of_figure = [a for c in _FIGURES for a in (F.mean(c).alias(f"mean_{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd_{c}"))]
    stats = named.groupBy("band").agg(F.count("*").alias("n"), *of_figure).filter(F.col("n") >= min_labelled)
    # how far labelled rows lie from the mean of their language and length, of all languages and lengths together
    own = named.filter((F.col("band.by") == "lang") & (F.col("band.length") != ANY_LENGTH)).join(stats, "band")
    away = {c: F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")) for c in _FIGURES}
    beyond = lambda c, share: F.abs(F.percentile_approx(away[c], share, 100_000))
    sides = {"few_chars": beyond("chars_per_token", EXCEEDED), "many_chars": beyond("chars_per_token", 1 - EXCEEDED)}
    sides |= {"fallback": beyond("fallback_share", 1 - EXCEEDED), "entropy": beyond("token_entropy", EXCEEDED)}
    found = own.agg(*[e.alias(k) for k, e in sides.items()]).first()
    width = {k: max(MIN_WIDTH, MARGIN * (found[k] or 0.0)) for k in sides}
    mean, sd = (lambda c: F.col(f"mean_{c}")), (lambda c: F.col(f"sd_{c}"))
    return stats.select(
        "band.*",
        (mean("chars_per_token") - width["few_chars"] * sd("chars_per_token")).alias("min_chars"),
        (mean("chars_per_token") + width["many_chars"] * sd("chars_per_token")).alias("max_chars"),
        (mean("fallback_share") + F.greatest(F.lit(MIN_FALLBACK_SLACK), width["fallback"] * sd("fallback_share"))).alias("max_fallback"),
        (mean("token_entropy") - width["entropy"] * sd("token_entropy")).alias("min_entropy"),
    )


def judge(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept.

    The band of the language and length decides, else that of the language, else those of the script; a row that
    has none is kept unless the base rules fail it.
    """
    if bands.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        bands = F.broadcast(bands)
    limits = F.struct("min_chars", "max_chars", "max_fallback", "min_entropy")
    joined, found = measured, []
    for by in ("lang", "script"):
        own = bands.filter(F.col("by") == by)
        exact = own.filter(F.col("length") != ANY_LENGTH).select(F.col("name").alias(by), "length", limits.alias(f"{by}_band"))
        whole = own.filter(F.col("length") == ANY_LENGTH).select(F.col("name").alias(by), limits.alias(f"{by}_any"))
        joined = joined.join(exact, [by, "length"], "left").join(whole, by, "left")
        found += [f"{by}_band", f"{by}_any"]
    band = F.coalesce(*found)
    inside = (
        F.col("chars_per_token").between(band["min_chars"], band["max_chars"])
        & (F.col("fallback_share") <= band["max_fallback"])
        & (F.col("token_entropy") >= band["min_entropy"])
    )
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop(*found)
    )


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measure, fit the bands and judge. The measures are kept as a table, since bands and verdicts both read them."""
    measured = written(measure(docs), "quality")
    return judge(measured, fit_bands(measured, labels))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Each row carries its own figures, so that nothing is joined back."""
    at = {c: f"_{docs.columns.index(c)}" for c in (text_col, id_col, lang_col)}
    rows = numbered(docs)
    rows = rows.select(at[text_col], *[c for c in rows.columns if c != at[text_col]], F.col(at[id_col]).alias(f"id {id_col}"), F.col(at[lang_col]).cast("string").alias("lang"))
    measured = written(_measured(rows, vocabulary, True), "quality").withColumnRenamed(f"id {id_col}", id_col)
    kept = judge(measured, fit_bands(measured, labels, id_col)).filter("kept")
    return kept.select([f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *_COUNTS, "base_failed", "kept", *_FIGURES)
