"""What is shown about one gene or screen, and the evidence behind predictions. All of them take any number at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import rules, scores
from heddle.operators import graph, pairwise
from heddle.operators.graph import both_ways, induced
from heddle.operators.windows import first_per_key, positive_mean, top_k


def gene_details(observations: DataFrame, screens: DataFrame, most_citations: int = 5) -> DataFrame:
    """Per gene: screens, screens with a hit, their mean percentile, dark score, and the first papers of its hits.

    ``screens``: screen_id, pmid, author.
    """
    of_hits = F.when(F.col("hit"), F.col("percentile"))
    measured = observations.groupBy("gene", "screen_id").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"), F.sum(of_hits).alias("sum"), F.count(of_hits).alias("n"))
    counts = measured.groupBy("gene").agg(
        F.count("screen_id").alias("screens"), F.count_if(F.col("hit") & F.col("screen_id").isNotNull()).alias("hit_screens"), F.try_divide(F.sum("sum"), F.sum("n")).alias("correlation")
    )
    papers = screens.filter("pmid is not null").hint("merge")  # else hits that look few in their file are broadcast, and one task has all
    cited = observations.filter("hit").select("gene", "screen_id").distinct().join(papers, "screen_id").select("gene", F.col("pmid").cast("string").alias("pmid"), "author").distinct()
    first = top_k(cited, ["gene"], [F.col("pmid"), F.col("author")], most_citations).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("pmid", "author"))).alias("citations"))
    known = counts.join(first, "gene", "left")
    return known.withColumns({"dark_score": scores.dark_score(F.col("hit_screens")), "is_bright": F.col("hit_screens") > 50, "correlation": F.coalesce("correlation", F.lit(0.0))})


def coloured_nodes(nodes: DataFrame, lean: DataFrame, focus: object) -> DataFrame:
    """Nodes of a network with mean fitness percentile and lean; ``lean``: gene, mean_percentile of one organism."""
    joined = nodes.join(lean.select(F.col("gene").alias("node"), "mean_percentile"), "node", "left")
    return joined.select("node", F.round("mean_percentile", 3).alias("mean_percentile"), F.coalesce(scores.lean(F.col("mean_percentile")), F.lit("unknown")).alias("lean"), (F.col("node") == focus).alias("focus"))


def dossiers(edges: DataFrame, cohits: DataFrame, terms: DataFrame, pathways: DataFrame, lean: DataFrame, top: int = 18, most_terms: int = 8, most_pathways: int = 5) -> DataFrame:
    """Each gene's ``top`` strongest partners with their tier, co-hit fold, lean, and some terms and pathways.

    ``cohits``: a, b, fold (a < b). ``terms``: gene, term, positive. ``pathways``: gene, pathway.
    """
    partners = top_k(both_ways(edges), ["a"], [F.desc("strength"), F.col("b")], top).select(F.col("a").alias("gene"), F.col("b").alias("partner"), "strength", "reciprocal", "rank")
    keyed = partners.withColumns({"a": F.least("gene", "partner"), "b": F.greatest("gene", "partner")}).join(cohits.select("a", "b", "fold"), ["a", "b"], "left")

    def some(df: DataFrame, column: str, most: int) -> DataFrame:
        first = top_k(df.select("gene", column).distinct(), ["gene"], [F.col(column)], most)
        return first.groupBy(F.col("gene").alias("partner")).agg(F.array_sort(F.collect_list(column)).alias(f"{column}s"))

    tier = rules.edge_tier(F.col("reciprocal") == 1, F.col("fold").isNotNull())
    return (
        keyed.drop("a", "b")
        .withColumn("tier", tier)
        .join(some(terms.filter("positive"), "term", most_terms), "partner", "left")
        .join(some(pathways, "pathway", most_pathways), "partner", "left")
        .join(lean.select(F.col("gene").alias("partner"), scores.lean(F.col("mean_percentile")).alias("lean")), "partner", "left")
    )


def weigh_predictions(predictions: DataFrame, dossier: DataFrame, own: DataFrame) -> DataFrame:
    """Verdicts on proposed functions from the partners that they cite.

    ``predictions``: gene, id, name, cited (array). ``dossier``: gene, partner, strength, reciprocal, tier, and terms or
    pathways of annotated partners; other citations cannot be verified. ``own``: gene, name of known functions, which
    are not novel. One supporter is enough only in the best tier.
    """
    annotated = dossier.filter(F.coalesce(F.size("terms"), F.lit(0)) + F.coalesce(F.size("pathways"), F.lit(0)) > 0)
    named = predictions.filter(F.trim("name") != "")
    cited = named.select("gene", "id", F.explode(F.array_distinct("cited")).alias("partner")).filter(F.trim("partner") != "")
    known = annotated.select("gene", F.col("partner").cast("string").alias("partner"), "strength", "reciprocal", "tier")
    marked = cited.join(known, ["gene", "partner"], "left")
    evidence = marked.groupBy("gene", "id").agg(
        F.count("tier").alias("n_support"), F.count_if(F.col("tier").isNull()).alias("n_unverifiable"), F.coalesce(F.min("tier"), F.lit(4)).alias("best_tier"),
        F.count_if(F.col("tier") <= 2).alias("n_strong"), F.count_if(F.col("reciprocal") == 1).alias("n_mutual"), F.min("strength").alias("weakest"), F.max("strength").alias("strongest"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_support", "n_unverifiable", "n_strong", "n_mutual")}
    joined = named.join(evidence, ["gene", "id"], "left").withColumns({**zero, "best_tier": F.coalesce("best_tier", F.lit(4))})
    stale = own.select("gene", F.lower(F.trim("name")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    checked = joined.withColumn("_key", F.lower(F.trim("name"))).join(stale, ["gene", "_key"], "left")
    n = F.col("n_support")
    verdict = (
        F.when(F.col("_known"), "rejected:not-novel").when(n == 0, "rejected:no-verifiable-support")
        .when((n == 1) & (F.col("best_tier") > 1), "single-supporter").otherwise("verified")
    )
    high = (F.col("n_strong") >= 2) | ((F.col("best_tier") == 1) & (n >= 2))
    confidence = F.when(high, "high").when(F.col("best_tier") <= 3, "moderate").otherwise("low")
    return checked.withColumns({"verdict": verdict, "confidence": confidence}).drop("_key", "_known", "cited")


def hit_facets(hits: DataFrame, most_conditions: int = 20, most_cells: int = 6) -> DataFrame:
    """A gene's hits by phenotype: their number, and the most frequent conditions and cell types.

    ``hits``: gene, screen_id, phenotype, condition, cell_type; ``-`` and nothing are no value.
    """
    rows = hits.withColumn("phenotype", F.coalesce(F.nullif("phenotype", F.lit("")), F.lit("unspecified")))

    def most_frequent(column: str, most: int) -> DataFrame:
        clean = F.trim(F.col(column))
        counts = rows.filter(clean.isNotNull() & ~clean.isin("", "-")).groupBy("gene", "phenotype", clean.alias("value")).agg(F.count("*").alias("n"))
        first = top_k(counts, ["gene", "phenotype"], [F.desc("n"), F.col("value")], most)
        ranked = F.array_sort(F.collect_list(F.struct("rank", "value", "n")))
        return first.groupBy("gene", "phenotype").agg(F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(column))

    totals = rows.groupBy("gene", "phenotype").agg(F.count("*").alias("n"))
    return totals.join(most_frequent("condition", most_conditions), ["gene", "phenotype"], "left").join(most_frequent("cell_type", most_cells), ["gene", "phenotype"], "left")


def reporter_screens(screens: DataFrame, ids: list, most: int = 6) -> DataFrame:
    """Screens by their ids, of which the first ``most`` count, with the process that they read out."""
    chosen = screens.filter(F.col("screen_id").isin(list(ids)[:most]))
    return chosen.withColumn("process", scores.process_name(F.col("rationale"), F.col("phenotype")))


def suggest_screens(screens: DataFrame, pool: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Screens of the ``pool`` by cell line (hyphens and spaces aside), condition, phenotype, author or start of the id.

    ``number_of_hits`` is text; it is ordered as a number.
    """
    word = typed.strip().lower()
    squashed = "".join(c for c in word if c.isalnum())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
    cell = F.contains(F.lower(scores.squash(F.coalesce("cell_line", F.lit("")))), F.lit(squashed))
    found = cell | has("condition") | has("phenotype") | has("author") | F.col("screen_id").cast("string").startswith(typed.strip())
    rows = screens.withColumn("_id", F.col("screen_id").cast("string")).join(pool.select(F.col("screen_id").cast("string").alias("_id")).distinct(), "_id", "left_semi").drop("_id")
    return rows.filter(found).orderBy(F.col("number_of_hits").try_cast("int").desc_nulls_last(), "screen_id").limit(max(1, min(limit, 25)))


def gene_bundle(genes: DataFrame, aliases: DataFrame, terms: DataFrame, edges: DataFrame, hits: DataFrame, most_aliases: int = 14, most_terms: int = 8, most_partners: int = 12) -> DataFrame:
    """One row per gene (gene_id, symbol): its aliases, terms per namespace, partners, and hits by phenotype, as arrays.

    ``terms``: gene_id, term, namespace, qualifier; annotations that begin with NOT don't count.
    """
    positive = terms.filter(F.col("qualifier").isNull() | (F.substring("qualifier", 1, 3) != "NOT")).select("gene_id", "namespace", "term").distinct()
    alias = top_k(aliases.select("gene_id", "alias").distinct(), ["gene_id"], [F.col("alias")], most_aliases).groupBy("gene_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    by_space = top_k(positive, ["gene_id", "namespace"], [F.col("term")], most_terms).groupBy("gene_id", "namespace").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    spaces = by_space.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("namespace", "terms"))).alias("terms"))
    best = top_k(both_ways(edges), ["a"], [F.desc("combined_score"), F.col("b")], most_partners).select(F.col("a").alias("gene_id"), "rank", F.col("b").alias("partner"), "combined_score")
    symbols = genes.select(F.col("gene_id").alias("partner"), F.col("symbol").alias("partner_symbol"))
    partners = best.join(symbols, "partner").groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("rank", "partner_symbol", "combined_score"))).alias("partners"))
    phenotypes = hits.groupBy("gene_id", F.coalesce("phenotype", F.lit("unspecified")).alias("phenotype")).agg(F.count("*").alias("n"))
    rolled = phenotypes.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "phenotype", "n"))).alias("phenotypes"), F.sum("n").alias("n_hits"))
    whole = genes
    for part in (alias, spaces, partners, rolled):
        whole = whole.join(part, "gene_id", "left")
    return whole.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def partner_network(edges: DataFrame, gene: object, top: int = 12) -> DataFrame:
    """The edges among a gene and its ``top`` partners by score."""
    best = both_ways(edges).filter(F.col("a") == gene).orderBy(F.desc("combined_score"), "b").limit(top).select(F.col("b").alias("node"))
    return induced(edges, best.unionByName(edges.sparkSession.createDataFrame([(gene,)], best.schema)))


def inline_network(edges: DataFrame, gene: object, cohits: DataFrame, top: int = 14) -> DataFrame:
    """The edges (a, b, r, tier, direct) among a gene and its ``top`` partners, mutual-best ones first; direct ones touch the gene.

    Edges between partners stay, as they shape the picture. ``cohits``: a row (a, b), a < b, for each co-hit pair.
    """
    drawn = graph.with_tiers(induced(edges, graph.neighbourhood(edges, gene, top=top)), cohits).filter("a != b")
    return drawn.select("a", "b", F.round("strength", 3).alias("r"), "tier", ((F.col("a") == gene) | (F.col("b") == gene)).alias("direct"))


def direct_tiers(drawn: DataFrame) -> DataFrame:
    """Direct edges of an ``inline_network`` per tier, 1 to 4, with zeros."""
    return graph.tier_histogram(drawn.filter("direct"))


def screen_contexts(screens: DataFrame, observations: DataFrame) -> DataFrame:
    """Per screen: domain, class, mechanism (of drugs), modality with its sign, coverage, and its usable genes.

    A gene is usable if it has a percentile; rows without one don't count.
    """
    usable = observations.groupBy("screen_id").agg(F.count("percentile").alias("n_genes"))
    joined = screens.join(usable, "screen_id", "left").withColumn("_m", rules.modality(F.col("methodology")))
    return joined.withColumns(
        {
            "mechanism": F.when(F.col("class") == "drug", rules.mechanism(F.col("condition"))), "modality": F.col("_m.modality"), "sign": F.col("_m.sign"),
            "n_genes": F.coalesce("n_genes", F.lit(0)),
        }
    ).drop("_m")


def context_power(contexts: DataFrame, by: str, least: int) -> DataFrame:
    """Per context its screens, and whether they are at least ``least``."""
    return contexts.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n_screens")).withColumn("has_power", F.col("n_screens") >= least)


def veto_directions(scores_: DataFrame, screens: DataFrame, directions: DataFrame, panel: DataFrame, least: int = 3) -> DataFrame:
    """Proposed directions with conflict = true where core-essential genes end up positive in a knockout viability screen.

    ``scores_``: screen_id, gene, percentile as the direction makes them. ``panel``: gene. The sign of a mean does not depend on the order of its values.
    """
    means = scores_.join(panel, "gene", "left_semi").groupBy("screen_id").agg(F.count("percentile").alias("n_panel"), F.avg("percentile").alias("panel_mean"), positive_mean("percentile").alias("_positive"))
    viable = screens.withColumn("_viable", rules.is_viability_knockout(F.col("methodology"), F.col("phenotype"), F.col("rationale"))).select("screen_id", "_viable")
    joined = directions.join(means, "screen_id", "left").join(viable, "screen_id", "left")
    conflict = F.coalesce(F.col("_viable") & (F.col("n_panel") >= least) & F.col("_positive"), F.lit(False))
    return joined.withColumn("conflict", conflict).drop("_viable", "_positive")


def anchored_correlations(observations: DataFrame, least: int) -> DataFrame:
    """Pearson's r of genes (a < b, n, r) over the screens that measured both and in which one of them is a hit."""
    return pairwise.anchored_correlations(observations.filter("percentile is not null"), "gene", "screen_id", "percentile", "hit", least)


def connected(edges: DataFrame, nodes: DataFrame, node: object, kind: str) -> DataFrame:
    """The neighbours of a node that are of a kind, by the size of rho; ``edges``: a, b, rho; ``nodes``: node, kind."""
    near = both_ways(edges).filter(F.col("a") == node).select(F.col("b").alias("node"), "rho")
    return near.join(nodes.filter(F.col("kind") == kind), "node").orderBy(F.desc(F.abs("rho")), "node")


def known_casing(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names as the network spells them: as given, else in upper case, else capitalised. ``names``: name; ``symbols``: symbol."""
    tries = F.posexplode(F.array("name", F.upper("name"), F.initcap("name"))).alias("priority", "symbol")
    return first_per_key(names.select("name", tries).join(symbols.distinct(), "symbol"), ["name"], [F.col("priority")]).select("name", "symbol")
