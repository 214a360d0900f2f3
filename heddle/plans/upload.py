"""Uploaded gene lists: many files at a time, each with a format of its own.

A file is one row of text. Its format is the first of a table of formats whose conditions its header meets; all is
evaluated as Spark expressions over the names in the header.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import fixed_values as V

HIGH, MEDIUM, LOW = 0.95, 0.75, 0.5
#: Score columns by preference, where a format has fixed names.
PREFERRED = {
    "MAGECK": ["neg|lfc", "neg|score", "pos|lfc", "pos|score"],
    "STARS": ["LFC", "lfc", "q-value", "p-value", "Rank", "rank"],
    "DESEQ2": ["log2FoldChange", "log2foldchange", "stat", "pvalue", "padj", "baseMean"],
    "RESIDUAL": ["z_score", "mean_lfc", "mean_residual", "fdr", "p_value"],
}
_DESEQ_IDS = ["gene", "", "geneid", "gene_id"]
_SCORE = r"^score\.\d+$"


def _names() -> Column:
    return F.col("columns")


def _low() -> Column:
    return F.transform("columns", F.lower)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquote(text: Column) -> Column:
    return F.regexp_replace(_strip(text), "^[\"']|[\"']$", "")


def _texts(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _all(*names: str) -> Column:
    return F.size(F.array_intersect(_low(), _texts(list(names)))) == len(names)


def _some(names: list[str]) -> Column:
    return F.arrays_overlap(_low(), _texts(names))


def _count(names: list[str]) -> Column:
    return F.size(F.array_intersect(_low(), _texts(names)))


def _called(names: list[str]) -> Column:
    """The first column of one of the names (in lower case), as it is written; null if there is none."""
    return F.get(F.filter(_names(), lambda c: F.lower(c).isin(names)), F.lit(0))


def _holds(place: int, terms: list[str]) -> Column:
    """Whether the name at a place has one of the terms in it."""
    name = F.coalesce(F.get(_low(), F.lit(place)), F.lit(""))
    return F.exists(_texts(terms), lambda t: F.contains(name, t)) & (F.size(_names()) > place)


@dataclass(frozen=True)
class Format:
    """A format: when a header has it, its identifier column, and how sure that is."""

    name: str
    fits: Column
    id_column: Column
    sure: Column


def _formats() -> list[Format]:
    """From the most to the least specific."""
    first = F.get(_names(), F.lit(0))
    numbered, hit = F.exists(_low(), lambda c: F.rlike(c, F.lit(_SCORE))), _some(V.HIT_COLUMNS)
    graded = lambda full, other=MEDIUM: F.when(full, HIGH).otherwise(other)
    stars, deseq = _count(V.STARS_COLUMNS), _count(V.DESEQ_COLUMNS)
    named, scored = _holds(0, V.SIMPLE_ID_TERMS), _holds(1, V.SIMPLE_SCORE_TERMS)
    row = F.split("second", F.col("delimiter"), -1)
    letters = F.rlike(_strip(F.get(row, F.lit(0))), F.lit("^[A-Za-z]"))
    number = F.rlike(F.get(row, F.lit(1)), F.lit(r"^\s*[-+]?(\d|\.\d|Infinity)"))
    small = F.size(_names()) <= 3
    return [
        Format("ORCS", _all("official_symbol") & (numbered | hit), _called(["official_symbol"]), graded(numbered & hit)),
        Format(
            "RESIDUAL", _all("gene", "mean_lfc") & _some(["z_score", "mean_residual", "ascending_rank"]), _called(["gene"]), graded(_all("z_score", "mean_residual"))
        ),
        Format("MAGECK", F.exists(_names(), lambda c: F.contains(c, F.lit("|"))), F.coalesce(_called(["id"]), first), graded(_all("id"))),
        Format("STARS", stars >= 3, F.coalesce(_called(["gene"]), first), graded(stars == len(V.STARS_COLUMNS))),
        Format(
            "DESEQ2", deseq >= 2, F.coalesce(_called(_DESEQ_IDS), first),
            F.when(deseq < len(V.DESEQ_COLUMNS), LOW).otherwise(graded(_some(V.DESEQ_OPTIONAL))),
        ),
        Format("SIMPLE", small & (named | (F.size(_names()) == 1)), first, graded(named & scored)),
        Format("SIMPLE", small & letters & ((F.size(row) == 1) | number), first, F.lit(LOW)),
        Format("UNKNOWN", F.lit(True), first, F.lit(0.0)),
    ]


def _score_column() -> Column:
    """The score column to begin with: the first preferred one of the format that is there, else the second column."""
    any_second = F.coalesce(F.get(_names(), F.lit(1)), F.get(_names(), F.lit(0)), F.lit(""))
    numbered = F.filter(_names(), lambda c: F.rlike(F.lower(c), F.lit(_SCORE)))
    lowest = F.array_min(F.transform(numbered, lambda c: F.struct(F.substring_index(c, ".", -1).cast("int").alias("number"), c.alias("name"))))["name"]
    found = F.when(F.col("format") == "ORCS", lowest)
    for kind, preferred in PREFERRED.items():
        own = F.get(F.array_intersect(_texts(preferred), _names()), F.lit(0))
        if kind == "MAGECK":
            own = F.coalesce(own, F.get(F.filter(_names(), lambda c: F.contains(c, F.lit("|"))), F.lit(0)))
        found = F.when(F.col("format") == kind, own).otherwise(found)
    return F.coalesce(found, any_second)


def detect(files: DataFrame) -> DataFrame:
    """``files`` (file, text) with a struct ``found``: format, delimiter, columns, id_column, hit_column, condition_column,
    score_column and confidence.

    The format is that of the first line that is not blank; of the text no more than the first two such lines are taken.
    """
    line = lambda n: _strip(F.regexp_extract("text", r"^\s*" + r"[^\n]*\n\s*" * n + r"([^\n]*)", 1))
    head = F.regexp_replace(line(0), r"^#+\s*", "")
    read = files.withColumns({"head": F.coalesce(head, F.lit("")), "second": F.coalesce(line(1), F.lit("")), "any": F.coalesce(F.rlike("text", F.lit(r"\S")), F.lit(False))})
    tabs = F.regexp_count("head", F.lit("\t")) >= F.regexp_count("head", F.lit(","))
    read = read.withColumn("delimiter", F.when(tabs, "\t").otherwise(","))
    read = read.withColumn("columns", F.when(F.col("any"), F.transform(F.split("head", F.col("delimiter"), -1), _unquote)).otherwise(F.array().cast("array<string>")))
    formats = _formats()
    fits = [F.when(F.col("any") & f.fits, F.struct(F.lit(f.name).alias("format"), f.id_column.alias("id_column"), f.sure.alias("confidence"))) for f in formats]
    none = F.struct(F.lit("UNKNOWN").alias("format"), F.lit("").alias("id_column"), F.lit(0.0).alias("confidence"))
    judged = read.withColumn("kind", F.coalesce(*fits, none)).select("*", "kind.*")
    found = F.struct(
        "format", "delimiter", "columns", F.coalesce("id_column", F.lit("")).alias("id_column"), F.coalesce(_called(V.HIT_COLUMNS), F.lit("")).alias("hit_column"),
        F.coalesce(_called(["condition"]), F.lit("")).alias("condition_column"), _score_column().alias("score_column"), "confidence",
    )
    return judged.select(*files.columns, found.alias("found"))


def parse_genes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes (file, line, symbol, score, is_hit, extra) and, per file, its counts and warnings.

    Missing scores count as 0; rows without an identifier are skipped; a file with too few genes has none.
    ``extra`` maps the other columns' names to their texts.
    """
    found = detect(files.select("file", F.coalesce("text", F.lit("")).alias("text")))
    lines = F.filter(F.transform(F.split(F.trim("text"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    data = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith("#"))
    rows = found.select("file", "found", F.posexplode_outer(F.when(F.size(lines) > 0, data)).alias("line", "text"))
    unquote = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    cells = rows.withColumn("cells", F.transform(F.split("text", F.when(F.col("found.delimiter") == ",", ",").otherwise("\t"), -1), unquote))
    place = lambda name: F.when(F.col(name) != "", F.array_position("found.columns", F.col(name)).cast("int"))
    placed = cells.withColumns({"id_at": place("found.id_column"), "score_at": place("found.score_column"), "hit_at": place("found.hit_column")})
    at = lambda i: F.get("cells", F.col(i) - 1)
    raw = F.trim(at("score_at"))
    number = F.when(~F.lower(F.coalesce(raw, F.lit(""))).isin(V.UPLOAD_MISSING), F.regexp_extract(raw, r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", 0).try_cast("double"))
    extra = F.map_filter(
        F.map_from_entries(F.arrays_zip(F.col("found.columns").alias("name"), F.transform("found.columns", lambda c, i: F.coalesce(F.get("cells", i), F.lit(""))).alias("value"))),
        lambda k, v: (k != F.col("found.id_column")) & (k != F.col("found.score_column")) & (k != ""),
    )
    parsed = placed.select(
        "file", "line", F.nullif(F.trim(at("id_at")), F.lit("")).alias("symbol"), F.coalesce(number, F.lit(0.0)).alias("score"),
        F.coalesce(raw, F.lit("")).eqNullSafe("").alias("no_score"), F.when(F.col("hit_at").isNotNull(), F.lower(F.trim(at("hit_at"))).isin(V.HIT_WORDS)).alias("is_hit"),
        F.when(F.size("found.columns") == F.size(F.array_distinct("found.columns")), extra).alias("extra"), F.col("text").isNotNull().alias("is_row"),
    )
    counts = parsed.groupBy("file").agg(
        F.count_if(F.col("symbol").isNotNull()).alias("n_genes"), F.count_if(F.col("is_row") & F.col("symbol").isNull()).alias("n_skipped"),
        F.count_if(F.col("symbol").isNotNull() & F.col("no_score")).alias("n_without_score"),
    )
    warning = lambda condition, text: F.when(condition, text)
    warnings = F.array_compact(F.array(
        warning(F.col("n_without_score") > 0, F.concat(F.col("n_without_score").cast("string"), F.lit(" rows had no score"))),
        warning(F.col("n_skipped") > 0, F.concat(F.col("n_skipped").cast("string"), F.lit(" rows had no identifier"))),
        warning(F.col("n_genes") == 0, F.lit("no rows found")),
        warning((F.col("n_genes") > 0) & (F.col("n_genes") < V.MIN_UPLOAD_GENES), F.lit("too few genes")),
    ))
    report = counts.withColumn("accepted", F.col("n_genes") >= V.MIN_UPLOAD_GENES).withColumn("warnings", warnings)
    own = parsed.withColumn("_genes", F.count("symbol").over(Window.partitionBy("file")))  # a join with the report would parse all files once more
    genes = own.filter(F.col("symbol").isNotNull() & (F.col("_genes") >= V.MIN_UPLOAD_GENES))
    return genes.select("file", "line", "symbol", "score", "is_hit", "extra"), report


def resolve_ids(genes: DataFrame, crosswalk: DataFrame, organism: str = "Human") -> DataFrame:
    """Genes with ``resolved`` symbol, ``mapped`` and the ``reason`` where an id has none.

    ``crosswalk``: kind (entrez, ensembl or ortholog), id, target. Digits are Entrez ids; ENSG ids lose their version;
    for mouse, orthologs count, and other symbols pass in upper case.
    """
    kind = F.when(F.rlike("symbol", F.lit(r"^\d+$")), "entrez").when(F.rlike("symbol", F.lit(r"(?i)^ENS[A-Z]*G\d+")), "ensembl")
    if organism == "Mouse":
        kind = F.coalesce(kind, F.lit("ortholog"))
    keyed = genes.withColumn("kind", kind).withColumn("id", F.when(F.col("kind") == "ensembl", F.upper(F.substring_index("symbol", ".", 1))).otherwise(F.col("symbol")))
    one = crosswalk.groupBy("kind", "id").agg(F.min("target").alias("target"))
    joined = keyed.join(one, ["kind", "id"], "left")
    passed = F.when(F.col("kind") == "ortholog", F.upper("symbol")).otherwise(F.col("symbol"))
    reason = F.when(F.col("kind").isNotNull() & F.col("target").isNull(), F.concat(F.col("kind"), F.lit(" id not found")))
    return joined.withColumn("resolved", F.coalesce("target", passed)).withColumn("mapped", F.col("target").isNotNull()).withColumn("reason", reason).drop("kind", "id", "target")


def signals(genes: DataFrame) -> DataFrame:
    """Per file: gene count, hits, whether all scores or hits alone were given, and the direction of its scores."""
    n, negative, positive = F.count("*"), F.count_if(F.col("score") < 0), F.count_if(F.col("score") > 0)
    counts = genes.groupBy("file").agg(n.alias("n_genes"), negative.alias("neg"), positive.alias("pos"), F.count("is_hit").alias("flags"), F.count_if("is_hit").alias("hits"))
    both = (F.least("neg", "pos") > 0) & (F.least("neg", "pos") / F.col("n_genes") > 0.15)
    direction = F.when(both, "bidirectional").when(F.col("neg") > F.col("pos"), "depletion").when(F.col("pos") > F.col("neg"), "enrichment")
    coverage = F.when((F.col("flags") > 0) & (F.col("hits") == F.col("n_genes")), "HITS_ONLY").otherwise("FULL")
    return counts.select(
        "file", "n_genes", F.when(F.col("flags") > 0, F.col("hits")).alias("hit_count"), coverage.alias("coverage"), F.when(F.col("n_genes") >= V.MIN_UPLOAD_GENES, direction).alias("direction")
    )
