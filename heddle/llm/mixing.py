"""Mixing sources to target weights: a budget of tokens is dealt down a tree of domains, languages and sources.

A node's budget goes to its children by their weights. A child whose capacity (its tokens times the most
epochs) is less gets its capacity, and its shortage goes to its siblings by their weights; only what a whole
family cannot take goes up to the siblings of its parent. As every node's capacity is the sum of its
children's, dealing top-down does just that. A leaf reads its documents in seeded order, epoch after epoch, and
takes the prefix that its budget covers.

Trees have a row per node, and are aggregated in Spark. Words are counted once, into a narrow table of leaf,
id, hash of the text and count. Prefixes need no sort of a whole leaf: counts are summed per leaf, epoch and bucket
of the order, the bucket in which the budget ends is cut into smaller ones until few rows are left, and only these are
ordered. What comes out is one place per leaf at which reading stops; rows with their texts are filtered by it
and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import WORD_PATTERN, numbered, table, written

LEVELS = ["domain", "lang", "source"]
BUCKET_DIGITS = 3  # hexadecimal digits of the order that name a bucket of 4,096
ORDERED_ROWS = 10_000  # of a leaf that may be ordered row by row
WEIGHTS_SCHEMA = "domain string, lang string, source string, weight long"
#: Leaves are broadcast up to this count.
BROADCAST_LEAVES = 50_000
#: A node without a weight of its own.
DEFAULT_WEIGHT = 1

#: Of query op6 and the pipeline: all sources belong to one of two domains; a null level says where a row's weight applies.
OP6_WEIGHTS = [
    ("web", None, None, 3),
    ("books", None, None, 2),
    ("web", "en", None, 4),
    ("web", "de", None, 2),
    ("books", "en", None, 3),
    ("web", "en", "src0", 5),
    ("web", "de", "src0", 3),
]
OP6_SHARE, OP6_EPOCHS, OP6_SEED = 0.8, 2, "heddle"


def domain_of(source: Column) -> Column:
    """The domain that query op6 puts a source in: sources with an even number are web, all others books."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1).try_cast("long")
    return F.when(number % 2 == 0, "web").otherwise("books")


def count_tokens(text: Column) -> Column:
    """The number of words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def allocate(leaves: DataFrame, weights: DataFrame, budget: int, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with a budget each.

    ``weights`` has positive whole numbers for nodes; deeper levels are null in the row of an inner node. Budgets
    are whole tokens: each level rounds down, so that up to one token per node of the budget is not dealt.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.lit(epochs))
    budgets = None
    for depth in range(1, len(LEVELS) + 1):
        path, parents = LEVELS[:depth], LEVELS[: depth - 1]
        family = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        deeper = [F.col(c).isNull() for c in LEVELS[depth:]]
        own = weights.filter(F.col(path[-1]).isNotNull())
        for condition in deeper:
            own = own.filter(condition)
        own = own.groupBy(*path).agg(F.max("weight").cast("long").alias("weight"))
        family = family.join(own, path, "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(DEFAULT_WEIGHT)), F.lit(1)))
        if parents:
            family = family.join(budgets.withColumnRenamed("budget", "dealt"), parents)
        else:
            family = family.withColumn("dealt", F.lit(budget).cast("long"))
        budgets = _deal(family, parents).select(*path, "budget")
    return leaves.join(budgets, LEVELS)


def _deal(family: DataFrame, parents: list[str]) -> DataFrame:
    """Each row's share of ``dealt`` among the rows of the same ``parents``.

    In the order of capacity per weight, a child is filled if its capacity is no more than its share of
    what those before it have left. All later ones share the rest by weight.
    """
    name = [c for c in LEVELS if c in family.columns][-1]
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    left = F.col("dealt") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    placed = family.withColumn("left", left).withColumn("weights", F.sum("weight").over(after))
    filled = placed.withColumn("filled", (F.col("left") >= 0) & (big("capacity") * big("weights") <= big("weight") * big("left")))
    rest = (
        filled.withColumn("taken", F.coalesce(F.sum(F.when(F.col("filled"), F.col("capacity"))).over(whole), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("filled"), F.col("weight"))).over(whole))
    )
    share = F.expr("cast((dealt - taken) as decimal(19,0)) * cast(weight as decimal(18,0)) div cast(open as decimal(19,0))")
    return rest.withColumn("budget", F.when(F.col("filled"), F.col("capacity")).otherwise(share))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    share: float | None = None,
    budget: int | None = None,
    epochs: int = 1,
    seed: str = OP6_SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Callable[[Column], Column] = domain_of,
) -> DataFrame:
    """The chosen rows with all columns of ``docs``, once per epoch that takes them, and a last column ``epoch`` (from 0).

    The budget is given in tokens (words), or as a ``share`` of all tokens. In each epoch a leaf's documents are in
    the order of the MD5 digest of seed, epoch and id; a document is taken while the tokens of all before it and
    its own fit the leaf's budget.

    Defined results: null levels are named ``unknown``, a text without words (or null) costs nothing and is taken
    in every epoch that the leaf reads to that place. A row without an id has a hash of its text in the id's place.
    Ties of the order are broken by a hash of the text; rows that are the same are taken together or not at all.
    Where all capacities are less than the budget, every row is taken in every epoch. A column named epoch is
    replaced. An empty table gives no rows.
    """
    unknown = F.lit("unknown")
    kept = [i for i, c in enumerate(docs.columns) if c != "epoch"]
    at = lambda c: F.col(f"_{docs.columns.index(c)}")
    t = F.xxhash64(at(text_col))
    named = {
        "domain": F.coalesce(domain(at(source_col)), unknown),
        "lang": F.coalesce(at(lang_col).cast("string"), unknown),
        "source": F.coalesce(at(source_col).cast("string"), unknown),
        "id": F.coalesce(at(id_col).cast("string"), t.cast("string")),
        "t": t,
    }
    rows = numbered(docs)
    counted = written(rows.select(*[c.alias(n) for n, c in named.items()], count_tokens(at(text_col)).alias("tokens")), "tokens")
    sizes = written(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    if budget is None:
        part = Fraction(str(1 if share is None else share))
        budget = (sizes.agg(F.sum("tokens").alias("n")).first().n or 0) * part.numerator // part.denominator
    leaves = allocate(sizes, weights, budget, epochs).select(*LEVELS, F.col("budget").alias("left"))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    stops = _stops(counted.select("*", epoch).withColumn("order", _order(seed)), leaves)
    if stops.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        stops = F.broadcast(stops)
    read = rows.withColumns(named).select("*", epoch).join(stops, LEVELS, "left")
    taken = F.col("stop").isNull() | (F.struct("epoch", _order(seed).alias("order"), "t") < F.col("stop"))
    return read.filter(taken).select(*[f"_{i}" for i in kept], "epoch").toDF(*[docs.columns[i] for i in kept], "epoch")


def _order(seed: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col("epoch"), F.col("id")))


def _stops(read: DataFrame, leaves: DataFrame) -> DataFrame:
    """Columns LEVELS and stop (epoch, order, t): the place of the first row that the budget of a leaf does not cover.

    A leaf whose budget covers all has none. ``leaves`` has each one's budget as ``left``.
    """
    digits = lambda n: F.substring("order", 1 + n * BUCKET_DIGITS, BUCKET_DIGITS)
    high = F.shiftright("t", 52)
    places = [F.struct("epoch", digits(0).alias("bucket")), digits(1), F.col("order"), high, F.shiftright("t", 40)]
    rest = read.join(_hint(leaves), LEVELS)
    for n, place in enumerate(places):
        if n and (rest.groupBy(*LEVELS).count().agg(F.max("count").alias("n")).first().n or 0) <= ORDERED_ROWS:
            break
        sums = rest.groupBy(*LEVELS, place.alias("place")).agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
        ends = written(_first_beyond(sums, ["place"], F.struct("place", "before")), "ends")
        inside = rest.join(_hint(ends), LEVELS).filter(place == F.col("end.place"))
        rest = written(inside.withColumn("left", F.col("left") - F.col("end.before")).drop("end"), "rest")
    sums = rest.groupBy(*LEVELS, "epoch", "order", "t").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
    return written(_first_beyond(sums, ["order", "t"], F.struct("epoch", "order", "t")), "stops").withColumnRenamed("end", "stop")


def _first_beyond(sums: DataFrame, order: list[str], end: Column) -> DataFrame:
    """Per leaf the least ``end`` at which the running total of tokens is more than what is left; before: the total up to there."""
    by_leaf = Window.partitionBy(*LEVELS).orderBy(*order)
    running = sums.withColumn("up_to", F.sum("tokens").over(by_leaf)).withColumn("before", F.col("up_to") - F.col("tokens"))
    return running.filter(F.col("up_to") > F.col("left")).groupBy(*LEVELS).agg(F.min(end).alias("end"))


def _hint(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tenths of all words, in up to two epochs: one row per document and epoch taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    weights = spark.createDataFrame(OP6_WEIGHTS, WEIGHTS_SCHEMA)
    return mix(docs, weights, share=OP6_SHARE, epochs=OP6_EPOCHS).select("doc_id", "lang", "source", "epoch")


def _level_sql(depth: int) -> str:
    path, parents = LEVELS[:depth], LEVELS[: depth - 1]
    on = " AND ".join([f"w.{c} = f.{c}" for c in path] + [f"w.{c} IS NULL" for c in LEVELS[depth:]])
    family = f"""
f{depth} AS (
  SELECT {', '.join('f.' + c for c in path)}, f.capacity, coalesce(w.weight, {DEFAULT_WEIGHT}) AS weight, {'b.budget' if parents else 'total.budget'} AS dealt
  FROM (SELECT {', '.join(path)}, sum(tokens) * {OP6_EPOCHS} AS capacity FROM leaves GROUP BY ALL) f
  LEFT JOIN weights w ON {on}
  {f"JOIN b{depth - 1} b ON " + " AND ".join(f"b.{c} = f.{c}" for c in parents) if parents else "CROSS JOIN total"})"""
    partition = f"PARTITION BY {', '.join(parents)}" if parents else ""
    window = f"{partition} ORDER BY CAST(capacity AS DOUBLE) / weight, {path[-1]}"
    return f"""{family},
p{depth} AS (
  SELECT *, dealt - coalesce(sum(capacity) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER ({window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM f{depth}),
q{depth} AS (SELECT *, lft >= 0 AND capacity * weights <= weight * lft AS filled FROM p{depth}),
b{depth} AS (
  SELECT {', '.join(path)}, CASE WHEN filled THEN capacity ELSE
      (dealt - coalesce(sum(capacity) FILTER (filled) OVER ({partition}), 0)) * weight // sum(weight) FILTER (NOT filled) OVER ({partition}) END AS budget
  FROM q{depth})"""


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


OP6_SQL = f"""
WITH weights(domain, lang, source, weight) AS (VALUES {', '.join('(' + ', '.join(map(_value, w)) + ')' for w in OP6_WEIGHTS)}),
rows AS (
  SELECT doc_id, lang AS given_lang, source AS given_source,
         CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 2 = 0 THEN 'web' ELSE 'books' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM rows GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * CAST({OP6_SHARE} AS DOUBLE)) AS BIGINT) AS budget FROM leaves),
{', '.join(_level_sql(d) for d in (1, 2, 3))},
read AS (
  SELECT r.*, CAST(e.epoch AS INTEGER) AS epoch, md5('{OP6_SEED}-' || e.epoch || '-' || doc_id) AS ord
  FROM rows r, range({OP6_EPOCHS}) e(epoch)),
running AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, ord) AS up_to FROM read)
SELECT doc_id, given_lang AS lang, given_source AS source, epoch
FROM running JOIN b3 USING (domain, lang, source) WHERE up_to <= budget
"""
