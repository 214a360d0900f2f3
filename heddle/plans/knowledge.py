"""The knowledge base around genes, and facts derived from screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import rules, scores
from heddle.operators.graph import canonical
from heddle.operators.windows import first_per_key


def search_index(genes: DataFrame, aliases: DataFrame, hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Symbols and aliases that can be typed: gene_id, taxid, symbol, term, is_alias, n_hits, n_papers, rank, name.

    ``genes``: gene_id, taxid, symbol, name. ``aliases``: gene_id, alias. ``hits`` and ``papers`` have a row per hit
    or paper of a gene. An alias never shadows a symbol of its species; of equal aliases the smallest gene's stays.
    """
    n_hits = hits.groupBy("gene_id").agg(F.count("*").alias("n_hits"))
    n_papers = papers.groupBy("gene_id").agg(F.count("*").alias("n_papers"))
    known = genes.filter("symbol is not null and symbol != ''").join(n_hits, "gene_id", "left").join(n_papers, "gene_id", "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_hits", "n_papers")}).withColumn("rank", scores.search_rank(F.col("n_papers"), F.col("n_hits")))
    columns = ["gene_id", "taxid", "symbol", "term", "is_alias", "n_hits", "n_papers", "rank", "name"]
    symbols = known.withColumn("term", F.upper("symbol")).withColumn("is_alias", F.lit(0)).select(columns)
    typed = aliases.filter("alias is not null and alias != ''").select("gene_id", F.upper("alias").alias("term")).join(known, "gene_id")
    free = typed.join(symbols.select("taxid", "term").distinct(), ["taxid", "term"], "left_anti")
    return symbols.unionByName(first_per_key(free, ["taxid", "term"], [F.col("gene_id")]).withColumn("is_alias", F.lit(1)).select(columns))


def resolve_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """Typed names to genes: exact symbols, then symbols in any case, then aliases. ``names``: name."""
    joined = names.join(index, F.upper("name") == F.col("term"))
    priority = F.when((F.col("is_alias") == 0) & (F.col("name") == F.col("symbol")), 0).when(F.col("is_alias") == 0, 1).otherwise(2)
    return first_per_key(joined.withColumn("priority", priority), ["name"], [F.col("priority"), F.col("gene_id")]).select("name", "gene_id", "symbol", "priority")


def string_edges(links: DataFrame, proteins: DataFrame, least: int = 400) -> DataFrame:
    """Links between proteins as edges between genes: least score, a < b, the first of each pair.

    ``links``: protein_a, protein_b, combined_score and channel scores. ``proteins``: protein, gene_id.
    """
    one = first_per_key(proteins, ["protein"], [F.col("gene_id")])
    a = one.select(F.col("protein").alias("protein_a"), F.col("gene_id").alias("a"))
    b = one.select(F.col("protein").alias("protein_b"), F.col("gene_id").alias("b"))
    joined = links.filter(F.col("combined_score") >= least).join(a, "protein_a").join(b, "protein_b").drop("protein_a", "protein_b")
    return canonical(joined, "a", "b", [F.desc("combined_score")])


def clean_neighbours(edges: DataFrame, channels: list[str], k: int = 30) -> DataFrame:
    """Each gene's ``k`` best partners by the evidence of some channels alone (gene, neighbour, weight)."""
    from heddle.operators.graph import both_ways
    from heddle.operators.windows import top_k

    weighted = both_ways(edges).withColumn("weight", scores.combined_evidence(*[F.col(c) for c in channels])).filter("weight > 0")
    return top_k(weighted, ["a"], [F.desc("weight"), F.col("b")], k).select(F.col("a").alias("gene"), F.col("b").alias("neighbour"), "weight")


def dependency_summary(values: DataFrame, dependent: float = -0.5, strong: float = -1.0) -> DataFrame:
    """Per gene over models (gene_id, model, value): counts, mean, the most dependent model, and a class."""
    n, weak = F.count("value"), F.count_if(F.col("value") < dependent)
    kind = F.when(weak / n >= 0.9, "common_essential").when(weak >= 1, "selective").otherwise("non_essential")
    return values.filter("value is not null").groupBy("gene_id").agg(
        n.alias("n_models"), F.round(F.avg("value"), 4).alias("mean"), weak.alias("n_dependent"), F.count_if(F.col("value") < strong).alias("n_strong"),
        F.round(F.min("value"), 4).alias("lowest"), F.min_by("model", F.struct("value", "model")).alias("lowest_model"), kind.alias("class"),
    )


def fitness_lean(observations: DataFrame) -> DataFrame:
    """Mean percentile and count by gene and organism over fitness screens (columns domain, organism, gene, percentile)."""
    rows = observations.filter("domain = 'fitness' and percentile is not null")
    return rows.groupBy("gene", "organism").agg(F.avg("percentile").alias("mean_percentile"), F.count("*").alias("n"))


def stress_facts(observations: DataFrame) -> DataFrame:
    """Hits of stress and reporter screens with their direction and a sentence.

    ``observations``: gene, screen_id, hit, domain, class, condition, author, cell_line, harmonized, robust_z.
    """
    rows = observations.filter(F.col("hit") & F.col("domain").isin("stress", "reporter")).filter(~scores.is_control(F.col("gene").cast("string")))
    signed = rows.withColumn("sign", scores.effect_sign(F.col("harmonized"), F.col("robust_z")))
    stress, positive = F.col("domain") == "stress", F.col("sign") == "pos"
    direction = (
        F.when(stress & positive, "knockout confers resistance").when(stress, "knockout sensitises")
        .when(positive, "knockout raises reporter").otherwise("knockout lowers reporter")
    )
    text = lambda c, default: F.trim(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)))
    verb = F.when(stress & positive, "confers resistance to").when(stress, "sensitises cells to").when(positive, "raises the").otherwise("lowers the")
    what = F.when(stress, F.concat(text("condition", "the condition"), F.lit(" ("), F.coalesce("class", F.lit("None")), F.lit(")"))).otherwise(
        F.concat(text("condition", "the condition"), F.lit(" reporter"))
    )
    sentence = F.concat(
        F.col("gene").cast("string"), F.lit(": knockout "), verb, F.lit(" "), what, F.lit(" — "), text("author", "an unpublished"), F.lit(" screen in "),
        text("cell_line", "cells"), F.lit("; author-called hit."),
    )
    return signed.withColumn("direction", direction).withColumn("sentence", sentence)


def stress_consensus(facts: DataFrame) -> DataFrame:
    """Agreement of screens on a gene under the same condition."""
    resist, sensitise = F.count_if(F.col("sign") == "pos"), F.count_if(F.col("sign") == "neg")
    return facts.groupBy("gene", "domain", "class", "condition").agg(
        resist.alias("n_resistance"), sensitise.alias("n_sensitising"), F.count_distinct("screen_id").alias("n_screens"), (resist - sensitise).alias("net"),
        F.array_join(F.array_sort(F.collect_set(F.col("screen_id").cast("string"))), ",").alias("screens"),
    )


def screen_facets(metadata: DataFrame) -> DataFrame:
    """Rule-based facets of screens: type, selection, coverage and domain with confidences, and the condition's facets."""
    c = F.col
    decided = metadata.select(
        "*", rules.screen_type(c("methodology"), c("library_type"), c("enzyme")).alias("type"), rules.selection_method(c("screen_type")).alias("selection"),
        rules.coverage_type(c("full_size_available"), c("full_size")).alias("coverage"), rules.assay_domain(c("phenotype")).alias("domain"),
        rules.condition_class(c("setup"), c("condition"), c("notes")).alias("cc"),
    )
    kind = c("cc.class")
    growth, readout = rules.growth_direction(kind), rules.readout_type(kind, c("domain.value"), c("notes"))
    return decided.select(
        "screen_id", c("type.value").alias("perturbation"), c("type.confidence").alias("perturbation_confidence"), c("selection.value").alias("selection_method"),
        c("coverage.value").alias("coverage_type"), c("coverage.confidence").alias("coverage_confidence"), c("domain.value").alias("assay_domain"), kind.alias("condition_class"),
        c("cc.method").alias("condition_method"), growth.alias("growth_direction"), readout.alias("readout_type"), rules.expected_domain(kind).alias("expected_domain"),
        rules.derived_domain(kind, readout, growth).alias("derived_domain"), F.when(kind == "drug", rules.mechanism(c("condition"))).alias("mechanism"),
    )


def merge_facets(by_rule: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Facets by rule, with those of reviewed screens in their place; what is unresolved needs review.

    ``by_rule``: screen_id, condition_class, growth_direction, readout_type, current_domain. ``reviewed``: screen_id,
    growth_direction, readout_type, sign_convention, status.
    """
    other = reviewed.select("screen_id", F.col("growth_direction").alias("g"), F.col("readout_type").alias("r"), "sign_convention", F.col("status").alias("s"))
    joined = by_rule.join(other, "screen_id", "left")
    auto = F.coalesce(F.col("s") == "auto", F.lit(False))
    growth = F.when(auto, F.coalesce(F.nullif("g", F.lit("")), "growth_direction")).otherwise(F.col("growth_direction"))
    readout = F.when(auto, F.coalesce(F.nullif("r", F.lit("")), "readout_type")).otherwise(F.col("readout_type"))
    merged = joined.withColumns({"growth_direction": growth, "readout_type": readout})
    open_ = (F.col("growth_direction") == "UNRESOLVED") | (F.col("readout_type") == "UNRESOLVED")
    domain = F.coalesce(rules.derived_domain(F.col("condition_class"), F.col("readout_type"), F.col("growth_direction")), F.col("current_domain"))
    return merged.select(
        "screen_id", "condition_class", "growth_direction", "readout_type", F.when(auto, F.coalesce("sign_convention", F.lit(""))).otherwise("").alias("sign_convention"),
        F.when(auto, "reviewed").when(F.col("s").isNotNull(), "in review").otherwise("rule").alias("source"),
        F.when(open_ | (F.col("s").isNotNull() & ~auto), "needs_review").otherwise("auto").alias("status"), "current_domain", domain.alias("new_domain"),
        (F.col("current_domain").isNotNull() & (F.col("current_domain") != "") & (domain != F.col("current_domain"))).alias("domain_changed"),
    )


def enriched_terms(rows: DataFrame, most_p: float = 0.05, top: int = 15) -> DataFrame:
    """Enrichment results (term, adj_p, combined) that are significant, by combined score."""
    return rows.filter(F.col("adj_p") <= most_p).orderBy(F.desc("combined"), "term").limit(top)
