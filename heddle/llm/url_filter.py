"""URL filters: rules for hosts with their subdomains and path prefixes, the longest fitting rule deciding.

Every URL is expanded into those (host suffix, path prefix) expressions whose shape (number of host labels,
length of path) occurs among the rules; where rules have very many shapes, its host suffixes meet the rules' hosts first, and only
the path lengths that such a host's rules have are expanded. Expressions meet rules in an equi-join on the first 32 bits of
their SHA-256; a hit counts only if the full digests agree. Of the rules that fit, the longest decides. What a URL expands to is
bounded by the rules, however long it is itself.
All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import pick, table

RULES_SCHEMA = "host string, path string, verdict string"
#: Rules are broadcast up to this count; beyond it they are joined by a shuffle.
BROADCAST_RULES = 100_000
PREFIX_DIGITS = 8  # hexadecimal digits of the digest in the join key
#: URLs are expanded by the rules' shapes up to this count; beyond it by those of the rules for their hosts.
MOST_SHAPES = 500

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The rules of query op8.
OP8_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _suffix(host: Column, labels: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _of_shapes(shapes: list[tuple[int, int]]) -> Column:
    """A URL's expressions with one of the shapes (labels of the host, length of the path)."""
    if not shapes:
        return F.array().cast("array<string>")
    given = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])
    fitting = F.filter(given, lambda s: (s["n"] <= F.col("labels_here")) & (s["m"] <= F.col("length_here")))
    return F.transform(fitting, lambda s: F.concat(_suffix(F.col("host"), s["n"]), F.substring(F.col("path"), F.lit(1), s["m"])))


def _of_own_hosts(parsed: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """Rows key and expression: each URL's suffixes that are rules' hosts, with the prefixes of its path that these hosts' rules are as long as."""
    hosts = rules.groupBy("host").agg(F.collect_set("path_length").alias("lengths"), F.max("labels").alias("labels"))
    hosts = hosts.select(F.length("host").alias("size"), "labels", "lengths", F.sha2("host", 256).alias("host_digest"))
    most = hosts.agg(F.max("size").alias("size"), F.max("labels").alias("labels")).first()
    hosts = hosts.select("lengths", "host_digest", F.substring("host_digest", 1, PREFIX_DIGITS).alias("prefix"))
    # only the end of a host that is as long as the longest rule's can be one
    end = F.call_function("right", F.col("host"), F.lit(most["size"] + 1))
    whole = F.length("host") <= F.lit(most["size"])
    labels = F.size(F.split(end, r"\.")) - F.when(whole, 0).otherwise(1)
    suffixes = F.when(labels > 0, F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(most["labels"]))), lambda n: _suffix(end, n)))
    own = parsed.select("key", "path", F.explode(suffixes).alias("suffix")).withColumn("own_digest", F.sha2("suffix", 256))
    own = own.withColumn("prefix", F.substring("own_digest", 1, PREFIX_DIGITS))
    met = own.join(F.broadcast(hosts) if few else hosts, "prefix").filter("own_digest = host_digest")
    fitting = F.filter("lengths", lambda m: m <= F.length("path"))
    return met.select("key", F.explode(F.transform(fitting, lambda m: F.concat("suffix", F.substring(F.col("path"), F.lit(1), m)))).alias("expression"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge every row of ``pages``; columns ``id_col``, host, path, rule, verdict.

    ``rules`` has the columns host, path and verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains when the URL's path starts with the rule's path. The longest rule (host and path together)
    wins; of equally long ones the one with the longer host, then the later in string order; a rule listed
    with both verdicts blocks. URLs that no rule fits get ``default`` and a null rule.

    Defined results: a null URL, an empty one or one without ``://`` has an empty host and path, so that no
    rule fits. Repeated rows are judged once and returned as often as they came. Rules with a null host or
    path, an empty host or one with a ``/``, or a path that is not empty and does not start with ``/``, never fit. URLs, hosts
    and paths may have any length. An empty ``pages`` or ``rules`` is fine. Other columns of ``pages`` are ignored.
    """
    rules = (
        # with these the first slash parts host and path, in rules as in expressions
        rules.filter("host != '' and instr(host, '/') = 0 and (path = '' or startswith(path, '/'))")
        .select(
            F.concat("host", "path").alias("rule"),
            "host",
            F.col("verdict").alias("rule_verdict"),
            F.length("host").alias("host_length"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_length"),
        )
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    shapes = [(r.labels, r.path_length) for r in rules.select("labels", "path_length").distinct().limit(MOST_SHAPES + 1).collect()]
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    all_rules, rules = rules, rules.drop("host")
    if few:
        rules = F.broadcast(rules)
    parsed = (
        pick(pages, id=id_col, url=url_col)
        .groupBy("id", "url")
        .agg(F.count("*").cast("int").alias("copies"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    confirmed = F.when(
        F.col("own_digest") == F.col("digest"),
        F.struct(F.length("rule").alias("length"), "host_length", "rule", "rule_verdict"),
    )
    if len(shapes) <= MOST_SHAPES:
        # what has no expression joins nothing; its key, unlike a null, is not the same for all
        no_key = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
        expanded = (
            parsed.withColumn("labels_here", F.size(F.split("host", r"\.")))
            .withColumn("length_here", F.length("path"))
            .select("id", "url", "copies", "host", "path", F.explode_outer(_of_shapes(sorted(shapes))).alias("expression"))
            .withColumn("own_digest", F.sha2("expression", 256))
            .withColumn("prefix", F.coalesce(F.substring("own_digest", 1, PREFIX_DIGITS), no_key))
        )
        judged = expanded.join(rules, "prefix", "left").groupBy("id", "url", "copies", "host", "path").agg(F.max(confirmed).alias("best"))
    else:
        # rows of expressions carry a digest of the URL's row instead of the URL
        part = lambda c: F.coalesce(F.base64(F.col(c).cast("string").cast("binary")), F.lit("-"))
        parsed = parsed.withColumn("key", F.sha2(F.concat(part("id"), F.lit(" "), part("url")), 256))
        expanded = _of_own_hosts(parsed, all_rules, few).withColumn("own_digest", F.sha2("expression", 256))
        expanded = expanded.withColumn("prefix", F.substring("own_digest", 1, PREFIX_DIGITS))
        best = expanded.join(rules, "prefix").groupBy("key").agg(F.max(confirmed).alias("best"))
        judged = parsed.join(best, "key", "left")
    return (
        judged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by the five given rules."""
    rules = spark.createDataFrame(OP8_RULES, RULES_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages"), rules)


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in OP8_RULES)

OP8_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_VALUES}),
cut AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parsed AS (
  SELECT k, page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
fits AS (
  SELECT k, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS r
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (k)
"""
