"""Documents that every operator on texts must take: nulls, nothing, very long, ties, repeats, clashing columns."""

import random
import re

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(seed=0, n=60):
    """Small random documents over few words, so that everything repeats; then the odd ones."""
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "x", "été", "漢字", "a,b", "it's", "42"]
    rows = []
    for i in range(n):
        size = r.choice([1, 3, 6, 20, 60, 120])
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(size))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), len(text)))
    copy = rows[3]
    odd = [
        (n, None, None, None, None),
        (n + 1, "", "en", "src0", 0),
        (n + 2, " \n\t ", "en", "src0", 4),
        (n + 3, "word " * 30_000, "en", "src1", 150_000),
        (n + 4, "y" * 100_000, "fr", "src2", 100_000),
        (n + 5, copy[1], copy[2], copy[3], copy[4]),
        (n + 6, "\n".join(["one line", "two lines", "three lines", "", "four"] * 3), "en", "src1", 0),
        copy,
        (None, "no id here at all " * 4, "en", "src0", 72),
        (None, None, None, None, None),
    ]
    return rows + odd


def with_clashes(df):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "Text", "h1", "n_removed", "block", "bands", "node", "spans", "k", "row", "places", "with.dot", "missing", "tokens", "end", "label", "v"]
    return df.select("*", *[F.lit(7).alias(n) for n in names])
