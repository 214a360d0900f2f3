"""Answers to questions, as plans that can be composed; nothing is collected between their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import scores
from heddle.operators.windows import first_per_key, histogram, top_k


def corpus_filter(
    organism: str | None = None, domains: list[str] | None = None, coverage: str | None = None, modalities: list[str] | None = None,
    cell_types: list[str] | None = None, all_domains: int = 4,
) -> Column:
    """A predicate over screens (organism, domain, coverage, curated_modality, raw_modality, cell_type).

    What is not given does not restrict, and neither do all domains together. Cell types match parts of names.
    """
    keep = F.lit(True)
    if organism:
        keep = keep & (F.col("organism") == organism)
    if domains and len(set(domains)) < all_domains:
        keep = keep & F.col("domain").isin(domains)
    if coverage:
        keep = keep & (F.col("coverage") == coverage)
    if modalities:
        keep = keep & F.coalesce("curated_modality", "raw_modality").isin(modalities)
    if cell_types:
        like = F.lit(False)
        for name in cell_types:
            like = like | F.contains(F.lower("cell_type"), F.lit(name.lower()))
        keep = keep & like
    return keep


def matched_screens(observations: DataFrame, screens: DataFrame, genes: list, min_shared: int = 0, limit: int = 20) -> DataFrame:
    """Screens in which some of ``genes`` are hits: shared_genes, their symbols, and the mean percentile (rho)."""
    found = observations.filter(F.col("gene").isin(genes) & F.col("hit")).join(screens.select("screen_id"), "screen_id", "left_semi")
    grouped = found.groupBy("screen_id").agg(
        F.count_distinct("gene").alias("shared_genes"), F.array_sort(F.collect_set("gene")).alias("shared"), F.avg("percentile").alias("rho")
    )
    return grouped.filter(F.col("shared_genes") >= min_shared).orderBy(F.desc("shared_genes"), F.desc_nulls_first("rho"), "screen_id").limit(limit)


def dark_genes(observations: DataFrame, matched: DataFrame, genes: list, gene_screens: DataFrame, limit: int = 20) -> DataFrame:
    """Other hits of the matched screens, in most screens and least known first; ``gene_screens``: gene, total_screens."""
    hits = observations.filter(F.col("hit") & ~F.col("gene").isin(genes)).join(matched.select("screen_id"), "screen_id", "left_semi")
    counts = hits.groupBy("gene").agg(F.count_distinct("screen_id").alias("screens"), F.avg("percentile").alias("correlation"))
    known = counts.join(gene_screens.select("gene", "total_screens"), "gene", "left").withColumn("pubs", F.coalesce("total_screens", F.lit(1)))
    return known.orderBy(F.desc("screens"), "pubs", "gene").limit(limit).select(
        "gene", "screens", "correlation", "pubs", scores.dark_score(F.col("pubs")).alias("dark_score"), (F.col("pubs") > 100).alias("is_bright")
    )


def query_edges(observations: DataFrame, matched: DataFrame, dark: DataFrame, n_screens: int = 5, n_genes: int = 8, limit: int = 40) -> DataFrame:
    """Hits of the first dark genes in the first matched screens, for a graph."""
    screens = matched.orderBy(F.desc("shared_genes"), F.desc_nulls_first("rho"), "screen_id").limit(n_screens).select("screen_id")
    genes = dark.orderBy(F.desc("screens"), "pubs", "gene").limit(n_genes).select("gene")
    hits = observations.filter("hit").join(screens, "screen_id", "left_semi").join(genes, "gene", "left_semi")
    return hits.select("screen_id", "gene", "score").orderBy("screen_id", "gene").limit(limit)


def query_stats(matched: DataFrame, n_genes: int) -> DataFrame:
    return matched.agg(F.count("*").alias("screens_compared"), F.count_if(F.col("rho") > 0.7).alias("significant_matches"), F.lit(n_genes).alias("query_gene_count"))


def best_organism(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the organism that a gene has most rows of; of equal ones the first by name."""
    counts = rows.groupBy(*by, "organism").agg(F.count("*").alias("_n"))
    best = first_per_key(counts, by, [F.desc("_n"), F.col("organism")]).drop("_n")
    return rows.join(best, [*by, "organism"], "left_semi")


def summary(rows: DataFrame, by: list[str], value: str = "percentile") -> DataFrame:
    """Distribution of a gene's percentiles: counts, hit rate, quartiles, extremes and lean; to four digits."""
    four = lambda c: F.round(c, 4)
    x = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.count_if("hit").alias("n_hits"), four(F.count_if("hit") / F.count("*")).alias("hit_rate"),
        four(F.median(x)).alias("median"), four(F.avg(x)).alias("mean"), four(F.percentile(x, 0.25)).alias("p25"), four(F.percentile(x, 0.75)).alias("p75"),
        four(F.min(x)).alias("min"), four(F.max(x)).alias("max"), scores.lean(F.median(x)).alias("lean"),
    )


def gene_histogram(rows: DataFrame, by: list[str], bins: int = 26) -> DataFrame:
    return histogram(rows.filter("percentile is not null"), "percentile", -1.0, 1.0, bins, by)


def extremes(rows: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The ``n`` lowest and highest screens per group, with side and rank."""
    low = top_k(rows, by, [F.col("percentile").asc_nulls_last(), F.col("screen_id")], n).withColumn("side", F.lit("essential"))
    high = top_k(rows, by, [F.col("percentile").desc_nulls_last(), F.col("screen_id")], n).withColumn("side", F.lit("advantageous"))
    return low.unionByName(high)


def stress_ledger(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hits per condition: papers decide a direction by the majority of their screens (ties: pos), then are tallied.

    ``rows``: hit, condition, class, paper, screen_id, sign (pos or neg).
    """
    hits = rows.filter("hit").withColumns(
        {"condition": F.coalesce(F.nullif(F.trim("condition"), F.lit("")), F.lit("unspecified condition")), "class": F.coalesce("class", F.lit("other"))}
    )
    keys = [*by, "condition", "class"]
    votes = F.count_if(F.col("sign") == "pos")
    papers = hits.groupBy(*keys, "paper").agg(F.count("*").alias("n"), (votes >= F.count("*") - votes).alias("positive"))
    tally = papers.groupBy(*keys).agg(
        F.count("*").alias("n_papers"), F.sum("n").alias("n_screens"), F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    net = F.col("pos") - F.col("neg")
    direction = F.when(net > 0, "resist").when(net < 0, "sensitise").otherwise("mixed")
    return tally.select(*keys, direction.alias("direction"), net.alias("net"), "n_papers", "n_screens", F.greatest("pos", "neg").alias("n_agree"))


def reporter_ledger(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hits per process of reporter screens, each screen once, with its number of papers."""
    hits = rows.filter("hit").filter(~scores.is_control(F.col("gene").cast("string"))).withColumn("process", scores.process_name(F.col("rationale"), F.col("phenotype")))
    return hits.groupBy(*by, "process").agg(F.count_distinct("screen_id").alias("n_screens"), F.count_distinct("paper").alias("n_papers"))


def screen_genes(observations: DataFrame, screen: object, cap: int = 200, over_fetch: int = 3) -> DataFrame:
    """A screen's genes by magnitude, hits first: the first rows are fetched, controls dropped, and the rest capped."""
    rows = observations.filter(F.col("screen_id") == screen)
    first = rows.orderBy(F.desc("hit"), F.abs("percentile").desc_nulls_last(), "gene").limit(cap * over_fetch)
    shown = first.filter(~scores.is_control(F.col("gene").cast("string")))
    return shown.orderBy(F.desc("hit"), F.abs("percentile").desc_nulls_last(), "gene").limit(cap)


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page; the size is between 1 and ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def distribution_of_gene(observations: DataFrame, screen: object, gene: object, bins: int = 40) -> tuple[DataFrame, DataFrame]:
    """A screen's scores as a histogram from its 1st to 99th percentile, with tails clamped, and a gene's place among them."""
    rows = observations.filter((F.col("screen_id") == screen) & F.col("score").isNotNull())
    ends = rows.agg(F.percentile("score", 0.01).alias("low"), F.percentile("score", 0.99).alias("high"))
    clipped = rows.join(F.broadcast(ends)).withColumn("x", F.least(F.greatest("score", "low"), F.col("high")))
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * bins).cast("int") + 1, F.lit(bins))
    counts = clipped.groupBy(F.coalesce(place, F.lit(1)).alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    focal = rows.filter(F.col("gene") == gene).agg(F.max("score").alias("focal"))
    placed = rows.join(F.broadcast(focal)).agg(
        ((F.count_if(F.col("score") < F.col("focal")) + 0.5 * F.count_if(F.col("score") == F.col("focal"))) / F.count("*")).alias("rank"), F.max("focal").alias("score")
    )
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))), placed


def predict_terms(
    neighbours: DataFrame, annotations: DataFrame, by: str = "gene", least_size: int = 5, most_size: int = 300, min_support: int = 2, top: int = 8
) -> DataFrame:
    """Terms that a gene's neighbours have and it lacks, by the neighbours' summed weights.

    ``neighbours``: gene, neighbour, weight, layers (array). ``annotations``: gene, term, positive (false: the gene is
    known not to have it, which is no support but bars the prediction).
    """
    from heddle.functions.rules import prediction_confidence

    own = annotations.select(F.col("gene").alias(by), "term").distinct()
    given = annotations.filter("positive").select(F.col("gene").alias("neighbour"), "term").distinct()
    sizes = given.groupBy("term").agg(F.count("*").alias("size")).filter(F.col("size").between(least_size, most_size))
    votes = neighbours.join(given.join(sizes, "term"), "neighbour").groupBy(by, "term").agg(
        F.sum("weight").alias("score"), F.count_distinct("neighbour").alias("n_support"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("layers")
    )
    candidates = votes.filter(F.col("n_support") >= min_support).join(own, [by, "term"], "left_anti")
    ranked = top_k(candidates, [by], [F.round("score", 9).desc(), F.col("term")], top)
    return ranked.withColumn("confidence", prediction_confidence(F.size("layers"), F.col("n_support")))


def suggest(index: DataFrame, typed: str, limit: int = 10, over_fetch: int = 5) -> DataFrame:
    """Genes whose term starts with what was typed: an exact symbol first, symbols before aliases, then by rank.

    ``index``: symbol, term (upper case), is_alias, rank. More rows than asked for are fetched, then each symbol kept once.
    """
    word = typed.strip().upper()
    order = [((F.col("term") == word) & (F.col("is_alias") == 0)).desc(), F.col("is_alias"), F.desc("rank"), F.length("term"), F.col("term")]
    fetched = index.filter(F.col("term").startswith(word)).orderBy(*order).limit(limit * over_fetch)
    placed = fetched.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    return first_per_key(placed, ["symbol"], [F.col("_place")]).orderBy("_place").limit(limit).drop("_place")


def drawer_rows(genes: DataFrame, needle: str, by: str, ascending: bool, ties: list[str]) -> DataFrame:
    """A screen's genes whose ``symbol`` has ``needle`` in it, in any case, with their ``place`` by a column; null is the lowest value."""
    word = needle.strip().upper()
    found = genes.filter(F.contains(F.upper("symbol"), F.lit(word))) if word else genes
    order = F.col(by).asc_nulls_first() if ascending else F.col(by).desc_nulls_last()
    return found.withColumn("place", F.row_number().over(Window.orderBy(order, *ties)))


def drawer_tokens(genes: DataFrame, needle: str, order: list, show_all: bool = False, most: int = 40) -> DataFrame:
    """Genes shown as tokens: the first ``most``, or all that have ``needle`` in their symbol."""
    word = needle.strip().upper()
    if word:
        return genes.filter(F.contains(F.upper("symbol"), F.lit(word)))
    return genes if show_all else genes.orderBy(*order).limit(most)
