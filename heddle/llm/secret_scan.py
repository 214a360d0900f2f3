"""Secret scan: fixed patterns, and strings that a Markov model of random characters explains better.

Two first-order character models are trained from labelled samples, one of random strings and one of
ordinary identifiers. A token that no fixed pattern claims is reported when its log-likelihood ratio is
high enough, for each character and in total. Everything on the main path is a Spark expression; what
reaches the driver is the model, a table of 69 x 69 numbers at most.

Positions come from pairing the matches of a pattern with the gaps between them, as ``split`` returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import let, pick, running_total, table

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ kept from 18 characters: a shorter match holds no longer one
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ kept from 16 characters: matches are whole runs
MIN_ASSIGNED = 12
TOKEN_CHARS = "A-Za-z0-9+/_=-"
MIN_TOKEN = 20
#: Tokens, as group 1, that are not (part of) what a fixed pattern matches first.
TOKEN = (
    r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)"""
    rf"|{ACCESS}|{HEX}(?![{TOKEN_CHARS}])|([{TOKEN_CHARS}]{{{MIN_TOKEN},}})"
)
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1  # state 0: the start, and any other character
SCALE = 1000  # the model holds thousandths of a nat

#: A token is reported from this log-likelihood ratio per character and in all, in nats.
MIN_MEAN, MIN_TOTAL = 1.0, 20.0
#: Rules and rows of dashes are no secrets: so many different characters a token must have.
MIN_DISTINCT = 8

#: What is taken out of texts before their words count as ordinary: whatever a fixed pattern reports.
CLAIMED = rf"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{{MIN_ASSIGNED},}})|{ACCESS}|{HEX}"
#: A word by itself or between the joints of an identifier; runs of letters inside keys touch digits or signs.
WORD = r"(?<![A-Za-z0-9+/=])[A-Za-z]{3,}(?![A-Za-z0-9+/=])"

#: Bounds of the training sample: documents (about so many, by a hash of ids and texts) whose words serve as
#: identifiers, and random strings.
SAMPLE_DOCUMENTS, SAMPLE_RANDOM, SAMPLE_SEED = 1000, 8000, "heddle"


def random_samples(spark: SparkSession, n: int = SAMPLE_RANDOM, seed: str = SAMPLE_SEED) -> DataFrame:
    """``n`` random strings, from digests of a seed: hexadecimal, base 64, and letters with digits in one or both cases."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base64, "[+/=]", "")
    style = F.pmod("id", F.lit(6))
    return spark.range(n).select(
        F.when(style == 0, F.substring(digest, 1, 40))
        .when(style == 1, base64)
        .when(style == 2, F.translate(base64, "+/", "-_"))
        .when(style == 3, F.upper(plain))
        .when(style == 4, F.lower(plain))
        .otherwise(plain)
        .alias("text"),
        F.lit(1).alias("label"),
    )


def identifier_samples(docs: DataFrame, id_col: str, text_col: str, n_docs: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Ordinary words, alone and joined in pairs as identifiers are, from about ``n_docs`` different documents.

    Documents are chosen by a hash of id and text, so that the share of hashes below a bound makes the number, whatever the ids
    are; rows alike in both are one document, of which every copy is in the sample or none, and which counts once. Secrets that
    the fixed patterns report, and pieces of mixed tokens, are no ordinary words.
    """
    hashed = F.xxhash64("id", "text")
    rows = pick(docs, id=id_col, text=text_col)
    share = min(1.0, n_docs / max(rows.select(F.approx_count_distinct(hashed).alias("n")).first().n, 1))
    chosen = rows.filter(F.pmod(hashed, F.lit(1 << 30)) < math.ceil(share * (1 << 30))).dropDuplicates(["id", "text"])
    ordinary = F.regexp_replace(F.coalesce("text", F.lit("")), CLAIMED, " ")
    words = F.regexp_extract_all(ordinary, F.lit(WORD), F.lit(0))
    pairs = chosen.select(words.alias("words")).select(
        F.explode(F.transform("words", lambda w, i: F.struct(w.alias("a"), F.get("words", i + 1).alias("b")))).alias("p")
    )
    a, b = F.col("p.a"), F.coalesce("p.b", F.lit("id"))
    style = F.pmod(F.xxhash64(a, b), F.lit(8))
    joined = (
        F.when(style == 0, F.concat(F.lower(a), F.lit("_"), F.lower(b)))
        .when(style == 1, F.concat(F.lower(a), F.initcap(b)))
        .when(style == 2, F.concat(F.lower(a), F.lit("-"), F.lower(b)))
        .when(style == 3, F.concat(F.lower(a), F.lit("/"), F.lower(b)))
        .when(style == 4, F.concat(F.upper(a), F.lit("_"), F.upper(b)))
        .when(style == 5, F.concat(a, F.pmod(F.xxhash64(a), F.lit(1000)).cast("string")))
        .when(style == 6, F.concat(a, F.lit("="), b))
        .otherwise(a)
    )
    return pairs.select(joined.alias("text"), F.lit(0).alias("label"))


#: Added to each pair's count: ordinary names hold pairs that a sample of bounded size has few or none of.
SMOOTHING = 5.0


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> list[int]:
    """Log-likelihood ratios of character pairs, random against ordinary, from samples (text, label 1 or 0).

    Row-major over ``STATES`` x ``STATES``, in thousandths of a nat. Without samples of a label its model is uniform.
    """
    states = F.transform(F.split(F.coalesce("text", F.lit("")), ""), _state)
    pairs = let(
        states,
        lambda xs: F.transform(xs, lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(xs, i - 1)) * STATES + s),
    )
    counted = samples.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    counts = {label: [smoothing] * (STATES * STATES) for label in (0, 1)}
    for row in counted.collect():  # at most 2 x 69 x 69 rows
        counts[row.label][row.pair] += row["count"]
    ratio = []
    for state in range(STATES):
        rows = {label: counts[label][state * STATES : (state + 1) * STATES] for label in (0, 1)}
        total = {label: sum(rows[label]) for label in (0, 1)}
        ratio += [
            round(SCALE * (math.log(rows[1][s] / total[1]) - math.log(rows[0][s] / total[0]))) for s in range(STATES)
        ]
    return ratio


def _state(char: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), char)


def score(token: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of a token, in thousandths of a nat."""
    ratios = F.lit(model)
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("total"))
    walked = F.aggregate(
        F.transform(F.split(token, ""), _state),
        start,
        lambda acc, s: F.struct(
            s.alias("state"), (acc["total"] + F.get(ratios, acc["state"] * STATES + s)).cast("long").alias("total")
        ),
    )
    return walked["total"]


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of start, end and the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def place(sizes: Column) -> Column:
        steps = F.zip_with(
            sizes, gaps, lambda size, gap: F.struct(gap.alias("gap"), F.coalesce(size, F.lit(0)).alias("size"))
        )
        return let(
            steps,
            lambda xs: let(
                running_total(F.transform(xs, lambda x: (x["gap"] + x["size"]).cast("long"))),
                lambda starts: F.transform(
                    xs, lambda x, i: F.struct((F.get(starts, i) + x["gap"]).alias("start"), (F.get(starts, i) + x["gap"] + x["size"]).alias("end"))
                ),
            ),
        )

    spans = let(F.transform(found, F.length), place)
    # after the last match one more gap follows, which has no match
    return F.filter(
        F.zip_with(
            spans, parts, lambda s, p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p.alias("part"))
        ),
        lambda x: x["part"].isNotNull(),
    )


def _spans(text: Column, pattern: str, gate: str, kind: int, group: int = 0, keep=None) -> Column:
    matches = _matches(text, pattern, group)
    if keep is not None:
        matches = F.filter(matches, keep)
    as_spans = F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("rank"), m["end"].alias("end"))
    )
    return F.when(F.rlike(text, F.lit(gate)), as_spans).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))


def find_secrets(
    docs: DataFrame,
    model: list[int],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_mean: float = MIN_MEAN,
    min_total: float = MIN_TOTAL,
) -> DataFrame:
    """Columns ``id_col`` and spans: an array, by start and then kind, of kind, start and exclusive end in code points.

    Kinds: ``assign`` (a key word, a sign and a value of 12 or more characters; the span is the whole match),
    ``access``, ``hex`` and ``markov``. Kinds are searched independently, so their spans may overlap; a
    ``markov`` span never is the very token of another kind.

    Defined results: a null text counts as empty and has no spans. Rows with null or repeated ids are
    treated one by one. Other columns are ignored.
    """
    def is_random(m: Column) -> Column:
        return let(
            score(m["part"], model),
            lambda s: (s >= min_total * SCALE) & (s >= min_mean * SCALE * F.length(m["part"])),
        )

    text = F.col("text")
    found = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).select(
        "id",
        F.concat(
            _spans(text, ASSIGN, ASSIGN, 0, group=2, keep=lambda m: F.length(m["part"]) >= MIN_ASSIGNED),
            _spans(text, ACCESS, ACCESS, 1),
            _spans(text, HEX, HEX, 2),
            _spans(
                text, TOKEN, f"[{TOKEN_CHARS}]{{{MIN_TOKEN},}}", 3, group=1,
                keep=lambda m: (F.length(m["part"]) >= MIN_TOKEN)
                & (F.size(F.array_distinct(F.split(m["part"], ""))) >= MIN_DISTINCT)
                & is_random(m),
            ),
        ).alias("found"),
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return found.select(
        F.col("id").alias(id_col),
        F.transform(
            F.array_sort("found"),
            lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("spans"),
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The model from the bounded samples above."""
    return train(random_samples(docs.sparkSession).unionByName(identifier_samples(docs, id_col, text_col)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed kinds, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
