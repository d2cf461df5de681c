"""Operator 10, URL filters.

Every URL is expanded into host-suffix and path-prefix expressions. Expressions and rules meet in an
equi-join on a short prefix of their SHA-256 digests; a match counts only when the full digests agree, and
the longest rule of a URL wins. Only expressions of shapes that some rule has (labels in the host, code
points in the path) are made, so a URL with very many labels or path segments gives no more rows than the
rules have shapes, and no match is lost.

Defined results: a null URL, or one without "://", has an empty host and path and gets no rule; empty input
gives no rows; repeated rows are kept, each with its verdict; other columns pass through, and an input column
named like an output is replaced. Two rules with the same host and path: "block" wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses.
SHORT = 8

#: The rules of the query: host, path, action.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://", lower-cased A-Z) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(url)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null) and verdict."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    labels = lambda host: F.size(F.split(host, "\\."))
    made = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        labels(F.col("host")).alias("labels"), F.length("path").alias("chars"),
        F.concat("host", "path").alias("rule"), "action",
    )
    # at most one shape for each label count and path length that rules have: bounded by URL syntax, not by data
    shapes = [(r.labels, r.chars) for r in made.select("labels", "chars").distinct().collect()]
    known = made.select(
        F.substring(digest(F.col("rule")), 1, SHORT).alias("short"), digest(F.col("rule")).alias("full"), "rule", "action"
    )

    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    urls = parts.where(F.col("host") != "").select("host", "path").distinct()
    forms = [
        F.when(
            (labels(F.col("host")) >= k) & (F.length("path") >= n),
            F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)),
        )
        for k, n in shapes
    ]
    if not forms:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    forms = F.filter(F.array(*forms), lambda x: x.isNotNull())
    asked = urls.select("host", "path", F.explode(forms).alias("form"))
    asked = asked.select("host", "path", digest(F.col("form")).alias("asked_full"))
    asked = asked.withColumn("short", F.substring("asked_full", 1, SHORT))
    hits = asked.join(known, "short").where(F.col("asked_full") == F.col("full"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("action").alias("action"), F.col("rule").alias("rule"))).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("__rule"), F.col("best.action").alias("__action"))
    parts = parts.drop("rule", "verdict")
    out = parts.where(F.col("host") != "").join(best, ["host", "path"], "left")
    # rows without a host, be they most of the table, meet no rule and aren't shuffled
    bare = parts.where(F.col("host") == "").withColumns({"__rule": F.lit(None).cast("string"), "__action": F.lit(None).cast("string")})
    out = out.unionByName(bare)
    return out.withColumns({"rule": F.col("__rule"), "verdict": F.coalesce("__action", F.lit(default))}).drop("__rule", "__action")


ORACLE = """
WITH rules(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
d AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
    FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM c LEFT JOIN d USING (rid)
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
