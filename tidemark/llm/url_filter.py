"""Block and allow rules for URLs, found by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression that a rule could have. The expressions meet the
rules in an equi-join on the first 32 bits of their SHA-256 digests; the full digest is compared before a rule counts,
and the longest rule wins. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8

#: The rules of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, action)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of pages.

    rules has host, path and action (allow or block). A rule fits its host and all subdomains where the path starts
    with the rule's. The rule with the most characters wins; among equals the one with the longer host, then block.
    Without a rule, rule is null and verdict is `default`. Null URLs and URLs without `://` have an empty host and path.
    Rules with a null or empty host fit nothing. Repeated rows stay, columns of pages named host, path, rule or verdict
    are replaced, an empty table gives an empty table.
    """
    rules = rules.filter(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.translate(F.col("host"), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action")
    )
    shape = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.sort_array(F.collect_set(F.length("r_path")))).first()
    labels, lengths = shape[0] or 0, shape[1] or []
    host, path = url_parts(F.col("u_url"))
    seen = pages.select(F.col(url_col).alias("u_url")).filter(F.col("u_url").isNotNull()).distinct().select("u_url", host.alias("u_host"), path.alias("u_path"))
    parts = F.split("u_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    )
    usable = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("u_path"))
    expanded = (
        seen.withColumn("e_host", F.explode(suffixes))
        .withColumn("e_length", F.explode(usable))
        .withColumn("e_digest", digest(F.col("e_host"), F.expr("substring(u_path, 1, e_length)")))
        .select("u_url", "e_digest", F.substring("e_digest", 1, PREFIX_HEX).alias("prefix"))
    )
    table = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("r_action") == "block").cast("int").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_action").alias("action"),
    )
    best = expanded.join(table, "prefix").filter(F.col("e_digest") == F.col("r_digest")).groupBy(F.col("u_url").alias("_tm_url")).agg(F.max(rank).alias("_tm_best"))
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # a null URL finds no rule; a key of its own for each keeps them from meeting in one task
    key = F.coalesce(F.col(url_col), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    return (
        pages.select(*kept, key.alias("_tm_key")).join(best, F.col("_tm_key") == F.col("_tm_url"), "left")
        .select(*kept, host.alias("host"), path.alias("path"), F.col("_tm_best.rule").alias("rule"), F.coalesce(F.col("_tm_best.action"), F.lit(default)).alias("verdict"))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
ORACLE = f"""
WITH rules(r_host, r_path, action) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
ranked AS (SELECT n, r_host || r_path AS rule, action,
                  row_number() OVER (PARTITION BY n ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, action DESC) AS k
           FROM numbered JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN ranked ON numbered.n = ranked.n AND k = 1
"""
