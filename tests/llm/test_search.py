"""Suffix dedup, ranked search and spelling variants against brute force over small documents with every odd case in them."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import ranked_search, spelling, suffix_dedup
from tests.llm.cases import DOCS_SCHEMA, documents, with_clashes


@pytest.fixture(scope="module")
def rows():
    return [r if r[1] is None or len(r[1]) < 20_000 else (*r[:1], r[1][:3000], *r[2:]) for r in documents()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return with_clashes(spark.createDataFrame(rows, DOCS_SCHEMA)).cache()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- suffix dedup


def brute_bytes(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for row, t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = [m.span() for m in re.finditer("1+", "".join("1" if g else "0" for g in gone))]
        out.append((row[0], len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def as_found(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length,reach,bucket", [(400, 120, 1 << 15), (60, 20, 40), (60, 36, 7), (40, 8, 300)])
def test_suffix_dedup(docs, rows, length, reach, bucket):
    got = suffix_dedup.remove_repeated_bytes(docs, length=length, reach=reach, bucket_rows=bucket)
    assert as_found(got) == brute_bytes(rows, length)


@pytest.mark.parametrize("bucket", [1 << 15, 20])
def test_suffix_dedup_of_passages_in_random_surroundings(spark, bucket):
    """Passages around the length in different surroundings, one of them in most documents, so that its groups are many buckets."""
    r = random.Random(bucket)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (58, 59, 60, 61, 75, 100, 180)]
    rows = [(k, text(r.randrange(90)) + (passages[5] if k % 3 else r.choice(passages)) + text(r.randrange(90)) + r.choice(passages)) for k in range(150)]
    rows += [(None, rows[4][1]), (None, rows[4][1]), (7, rows[7][1])]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=60, reach=20, bucket_rows=bucket)
    assert as_found(got) == brute_bytes(rows, 60)


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(4)
    part = bytes(r.choice(b"abc") for _ in range(700))
    texts = [part * 3 + b"x", b"yy" + part, b"z" * 900, b"", b"short"]
    found = {}
    for segment in (1 << 20, 256):
        places = set()
        for held in suffix_dedup.suffixes(texts, 64, 24, segment):
            assert len(held.kinds()) == len(held.tokens()) == len(held.at)
            for k, a, b in zip(held.text.tolist(), (held.low + held.shift).tolist(), (held.high + held.shift).tolist()):
                places |= {(k, p) for p in range(a, b + 1)}
        found[segment] = places
    assert found[1 << 20] == found[256] == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 63)}


def test_multikey_order():
    r = np.random.default_rng(3)
    keys = r.integers(0, 4, (500, 3)).astype(np.uint64)
    order, begins = suffix_dedup.multikey_order(keys)
    rows = [tuple(k) for k in keys[order]]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(500))
    assert begins.tolist() == [i for i in range(500) if i == 0 or rows[i] != rows[i - 1]]


def test_suffix_dedup_empty_and_refused(docs):
    assert suffix_dedup.remove_repeated_bytes(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="reach"):
        suffix_dedup.remove_repeated_bytes(docs, length=100, reach=90)


# ---- ranked search


def brute_ranks(rows, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    terms = [cut(r[1]) for r in rows]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for row, ts in zip(rows, terms):
            tf, m = Counter(ts), 100 - 50 + (50 * len(ts) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(cut(text)) if tf[t])
            if score > 0:
                scores.append((-score, row[0] is None, row[0] or 0))
        out += [(item, rank, None if missing else id_, -score) for rank, (score, missing, id_) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,shard,block", [(50, 1 << 22, 1 << 20), (3, 500, 1 << 20), (1, 1, 1 << 20), (5, 2000, 40)])
def test_ranked_search(spark, docs, rows, k, shard, block):
    items = [(1, "alpha ALPHA beta, x"), (2, "été 漢字 42"), (2, "gamma it's"), (3, "nothing of this"), (4, ""), (5, None), (6, "no id here at all word"), (6, "no id here at all word"), (None, "one two three lines")]
    asked = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = ranked_search.rank_documents(docs.repartition(3), asked, k=k, shard_bytes=shard, block_bytes=block)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_ranks(rows, items, k)


def test_ranked_search_empty(spark, docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_search.rank_documents(docs.limit(0), items).count() == 0
    assert ranked_search.rank_documents(docs, items.limit(0)).count() == 0


def test_wand_skips_what_cannot_be_among_the_best():
    r = random.Random(1)
    texts = [[b"common"] * r.randrange(1, 4) + [b"often"] * r.randrange(2) + ([b"rare"] if i % 50 == 0 else []) for i in range(2000)]
    known = {b"common": 0, b"often": 1, b"rare": 2}
    df = [sum(w in t for t in texts) for w in known]
    held = ranked_search.Shard(texts, known, np.array([ranked_search.weight(2000, n) for n in df]), 2000, sum(map(len, texts)))
    heap = []
    scored = ranked_search.wand([held.postings(t) for t in range(3)], list(range(2000)), 10, heap)
    every = defaultdict(int)
    for t in range(3):
        for d, x in zip(*held.postings(t)[:2]):
            every[d] += x
    assert sorted(heap, reverse=True) == sorted(((s, -d) for d, s in every.items()), reverse=True)[:10]
    assert scored < 500, "after ten documents with the rare term (one in 50 has it) only those that have it are scored"


# ---- spelling variants


def brute_words(rows, least, count, errors):
    n = Counter()
    for id_, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if errors and h % errors == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(n):
    near = {w: [x for x in n if apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def variants(df):
    return plain(df.select("word", "n", "n_near", "form", "form_n", "root"))


@pytest.mark.parametrize("least,count,errors", [(6, 5, 199), (1, 1, 3), (2, 2, 0)])
def test_spelling(docs, rows, least, count, errors):
    got = spelling.group_variants(docs, min_letters=least, min_count=count, errors=errors)
    assert variants(got) == brute_variants(brute_words(rows, least, count, errors))


def test_spelling_chains_and_anagrams(spark):
    """Chains of forms, ties, and words of the same letters, which meet in keys and are no neighbours."""
    r = random.Random(2)
    n = {"station": 400, "statiom": 70, "stetiom": 10, "stetioms": 2, "nation": 90, "nationé": 6, "Ération": 40, "ration": 8, "y" * 3000: 7, "y" * 2999: 1}
    for _ in range(150):
        word = list("abcdefgh")
        r.shuffle(word)
        n["".join(word)] = n["".join(word)[:7] + r.choice("abcxyz")] = r.choice([1, 2, 30])
    texts = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(n.items())]
    got = spelling.group_variants(spark.createDataFrame(texts, "doc_id long, text string"), min_letters=3, min_count=1, errors=0)
    counts = brute_words(texts, 3, 1, 0)
    assert variants(got) == brute_variants(counts)
    assert {r.word: r.root for r in got.collect()}["stetioms"] == "station"


def test_anagrams_are_spread_over_keys(spark):
    """All orders of seven letters, with one of them exchanged: the keys of the join split them by half."""
    from itertools import permutations

    words = spark.createDataFrame([("".join(p), 1) for p in permutations("abcdefg")] + [("".join(p), 1) for p in permutations("abcdefx")], "word string, n long")
    valued = words.select("word", "n", F.split("word", "").alias("letters"), F.lit(0).cast("long").alias("value"), F.length("word").alias("size"))
    keyed = spelling._keyed(valued, F.col("size"), "xy", cut=True)
    assert keyed.groupBy("half").count().agg(F.max("count")).first()[0] < 500
    assert spelling.near_words(words).count() == 2 * 5040  # g exchanged for x at its place


def test_spelling_empty(docs):
    assert spelling.group_variants(docs.limit(0)).count() == 0
