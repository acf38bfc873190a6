"""URL filtering by host and path rules (operator 6); DataFrame functions only.

A URL is expanded into host-suffix plus path-prefix expressions, one for each shape (number of host labels,
path length) that occurs among the rules. Expressions meet rules in an equi-join on the first four bytes of
their SHA-256; the full digests confirm a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.exact_dedup import LOWER, UPPER
from procurelake.llm.shared import quoted, stash

#: Rules up to this number are broadcast (under 30 MB); more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Shapes of rules up to this number are looked up one by one; beyond it every host suffix and path prefix is.
SHAPES = 500
RULES = T.StructType([T.StructField(n, T.StringType()) for n in ("action", "host", "path")])
#: The rules of the query.
PRODUCTION_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_parts(url):
    """(host, path): host lower-cased in A-Z; both empty for null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def short_hash(digest):
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with shape and digest. Rows without host or action are no rules; of rules for one host and path the block wins."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    clean = rules.where("host is not null and host != '' and action in ('allow', 'block')").select(
        F.concat(host, path).alias("rule"), host.alias("rule_host"), path.alias("rule_path"), "action"
    )
    one = clean.groupBy("rule", "rule_host", "rule_path").agg(F.max("action").alias("action"))
    return one.select(
        "rule", "action",
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length("rule_host").alias("host_length"),
        F.length("rule_path").alias("path_length"),
        F.sha2("rule", 256).alias("rule_digest"),
    ).withColumn("short", short_hash(F.col("rule_digest")))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict appended (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host and
    path together, then the longer host) wins; without a rule the verdict is ``default``. Null urls and urls
    without ``://`` have an empty host and path and match no rule. Rows keep their number, repeated or not;
    long urls make one expression per shape, so their length does not matter. Each distinct host and path
    is judged once, so a host with a third of all rows is combined before the shuffle. Without rules every
    row gets the default; an empty table stays empty; other columns pass through whatever their names.
    """
    ready = stash(prepared(rules), "rules")
    n_rules = ready.count()
    shapes = [(r.labels, r.path_length) for r in ready.select("labels", "path_length").distinct().limit(SHAPES + 1).collect()]
    host, path = url_parts(F.col(quoted(url)))
    outs = ("host", "path", "rule", "verdict")
    kept = [c for c in df.columns if c.lower() not in outs]
    # the columns that pass through travel as one and by place, so that none meets a name of this function's own
    passed = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(None).cast("int").alias("none"))
    rows = df.select(passed.alias("row"), host.alias("host"), path.alias("path"))
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)]
    if not shapes:
        return rows.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = rows.select("host", "path").distinct()
    n_labels = F.size(F.split("host", r"\."))
    if len(shapes) <= SHAPES:
        shape = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_length")) for a, b in sorted(shapes)])
        possible = F.filter(shape, lambda s: (s["labels"] <= n_labels) & (s["path_length"] <= F.length("path")))
    else:
        lengths = F.sequence(F.lit(0), F.length("path"))
        possible = F.flatten(F.transform(F.sequence(F.lit(1), n_labels), lambda a: F.transform(lengths, lambda b: F.struct(a.alias("labels"), b.alias("path_length")))))
    exploded = parts.where("host != ''").select("host", "path", F.explode(possible).alias("s"))
    suffix = F.expr("substring_index(host, '.', -s.labels)")
    expressions = exploded.select("host", "path", F.sha2(F.concat(suffix, F.expr("left(path, s.path_length)")), 256).alias("digest"))
    known = ready.select("rule", "action", "host_length", "path_length", "rule_digest", "short")
    if n_rules <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = expressions.withColumn("short", short_hash(F.col("digest"))).join(known, "short").where(F.col("digest") == F.col("rule_digest"))
    order = F.struct((F.col("host_length") + F.col("path_length")).alias("length"), "host_length", "action", "rule")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    # dealt out anew, so that the join can split the rows of a host and path that very many share
    judged = rows.join(best.repartition(F.xxhash64("path", "host")), ["host", "path"], "left")
    return judged.select(
        *back, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url against the five rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame([Row(*r) for r in PRODUCTION_RULES], RULES)
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH rules(action, rhost, rpath) AS (VALUES {", ".join(map(str, PRODUCTION_RULES))}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parts AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
met AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
        FROM parts p LEFT JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM met WHERE k = 1
"""
