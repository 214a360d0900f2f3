"""Spelling variant grouping: words one letter apart, found by anagram hashing, and each word's more frequent form.

A word's anagram value is the sum of the fifth powers of its letters' code points, so that words with the same letters
share it. Two words one letter apart have values that differ by the value of the letter added or removed, or of the two letters
exchanged: the equi-join of values with values less one letter finds additions and removals, that of values less one letter on
both sides finds exchanges. Words with the same letters in another order meet there too. As one letter is changed, either
the first half or the second half of a pair's letters is the same, so that a key holds a hash of that half as well: a
large family of anagrams falls into many keys. What meets is verified by its letters' order.

Words are counted within each task before the shuffle; everything after that runs on distinct words, as Spark expressions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import give_back, let, pick, table, text_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT = 6, 5
RATIO = 5  # a form is at least so many times as frequent
ERRORS = 199  # one in so many runs of a document loses a letter: the spelling errors that the contract plants
HELD_WORDS = 200_000  # different words that a task counts at a time

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MODULUS = (1 << 61) - 1  # values are sums modulo this prime: the longest words cannot exceed a long


def runs_of(text: str | None) -> list[str]:
    """Runs of letters, with A-Z in lower case and all other letters as they are."""
    return RUN.findall((text or "").encode().translate(_LOWER).decode())


def with_errors(doc: str, counts: Counter[str], errors: int = ERRORS) -> Iterator[tuple[str, int]]:
    """A document's runs with how often they occur; where ``errors`` divides a run's checksum, it has lost a letter."""
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if errors and h % errors == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        yield run, n


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, errors: int = ERRORS
) -> DataFrame:
    """Columns word and n: the words of all texts, of ``min_letters`` or more, that occur ``min_count`` times or more."""
    text_batches(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for frame in frames:
            for doc, text in zip(frame["id"], frame["text"]):
                for word, n in with_errors(doc, Counter(runs_of(text)), errors):
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held.clear()
        yield pd.DataFrame(held.items(), columns=["word", "n"])
        give_back()

    rows = pick(docs, id=id_col, text=text_col).filter("text is not null")
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _power(letter: Column) -> Column:
    return let(F.ascii(letter).cast("long"), lambda c: c * c * c * c * c)


def _keyed(words: DataFrame, shorter: Column, tags: str, cut: bool) -> DataFrame:
    """Rows word, n, letter, key, half of all words.

    ``shorter`` is the length that halves are counted in: that of a pair's shorter word. With ``cut``, a row for each letter to
    take away: one of the second half where the first one is to agree, one of the first half where the second one is.
    """
    def half(tag: str, part: Column) -> Column:
        return F.xxhash64(F.lit(tag), part)

    middle = F.floor(shorter / 2).cast("int")
    head, tail = F.substring("word", F.lit(1), middle), F.call_function("right", F.col("word"), shorter - middle)
    if cut:
        first = F.slice("letters", F.lit(1), F.size("letters") - shorter + middle)
        last = F.slice("letters", middle + 1, F.size("letters"))
    else:
        first = last = F.array(F.lit(""))

    def rows_of(tag: str, part: Column, letters: Column) -> Column:
        same = half(tag, part)
        value = (lambda c: F.pmod(F.col("value") - _power(c), F.lit(_MODULUS))) if cut else (lambda c: F.col("value"))
        return F.transform(F.array_distinct(letters), lambda c: F.struct(c.alias("letter"), value(c).alias("key"), same.alias("half")))

    both = F.concat(rows_of(tags[0], head, last), rows_of(tags[1], tail, first))
    return words.select("word", "n", F.explode(both).alias("r")).select("word", "n", "r.letter", "r.key", "r.half")


def near_words(words: DataFrame) -> DataFrame:
    """Columns word, near, near_n: all ordered pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced letter."""
    letters = F.split("word", "")
    value = F.aggregate(F.transform(letters, _power), F.lit(0).cast("long"), lambda a, x: F.pmod(a + x, F.lit(_MODULUS)))
    valued = words.select("word", "n", letters.alias("letters"), value.alias("value"), F.length("word").alias("size"))
    whole = _keyed(valued, F.col("size"), "hs", cut=False)
    less = _keyed(valued.filter("size > 1"), F.col("size") - 1, "hs", cut=True)
    exchanged = _keyed(valued, F.col("size"), "xy", cut=True)
    sides = lambda df, s: df.select(*[F.col(c).alias(c + s) for c in ("word", "n", "letter")], "key", "half")
    added = sides(whole, "_a").join(sides(less, "_b"), ["key", "half"])
    replaced = sides(exchanged, "_a").join(sides(exchanged, "_b"), ["key", "half"]).filter("letter_a < letter_b")
    met = added.unionByName(replaced).filter(F.levenshtein("word_a", "word_b", 1) == 1)
    pairs = met.select("word_a", "n_a", "word_b", "n_b").distinct()
    other = pairs.select(F.col("word_b").alias("word"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n"))
    return pairs.select(F.col("word_a").alias("word"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")).unionByName(other)


def _roots(forms: DataFrame) -> DataFrame:
    """Columns word and root of ``forms`` (word, form, form_n): where following the forms ends.

    A form is ``RATIO`` times as frequent as its word, so that the logarithm of the largest count bounds the steps; each round doubles them.
    """
    largest = forms.agg(F.max("form_n").alias("n")).first().n or 1
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(largest, RATIO))))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, errors: int = ERRORS
) -> DataFrame:
    """Columns word, n, n_near, form, form_n, root: every frequent word with its more frequent neighbour and the end of that chain.

    Words are runs of ``A-Za-z`` and the letters from U+00C0 to U+00FF, with A-Z in lower case. Where ``errors`` divides the CRC-32 of
    ``id:run``, that document's run has lost a letter (0: never). A word's form is the most frequent word one letter apart (ties: the first
    in code-point order), if it is ``RATIO`` times as frequent or more; a root is reached by following forms.

    Defined results: null and empty texts have no words; a null id counts as an empty one. Rows count as often as they come.
    Very long words are words as others are. Other columns are ignored; without words there are no rows.
    """
    words = written(count_words(docs, id_col, text_col, min_letters, min_count, errors), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = written(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.n"))
    is_form = F.col("best_n") >= RATIO * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents with their forms, roots and numbers of near words."""
    return group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_step(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: The checksum goes by four bits at a time, low ones first.
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1)),
    lambda c, x: xor(c >> 4, {[_crc_step(i) for i in range(16)]}[(xor(c, x) & 15) + 1])))"""

OP13_SQL = f"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= {MIN_LETTERS}),
summed AS (SELECT run, n, {_CRC} AS crc FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs)),
erred AS (
  SELECT CASE WHEN crc % {ERRORS} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM erred WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (word)),
chain AS (
  WITH RECURSIVE up AS (
    SELECT word, word AS root FROM words
    UNION ALL SELECT up.word, formed.form FROM up JOIN formed ON up.root = formed.word WHERE formed.form IS NOT NULL)
  SELECT word, root FROM up JOIN (SELECT word AS root FROM formed WHERE form IS NULL) USING (root))
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
