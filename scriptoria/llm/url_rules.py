"""URL filter rules by host-suffix and path-prefix expressions.

Each url is expanded into host suffix + path prefix expressions (path prefixes only of the lengths that rules
have), joined to the rules on the first bytes of the expressions' digests; then full digests are compared and
the longest rule wins (of equally long ones block before allow, then the text's order).

Edge cases: a null url, or one without "://", has empty host and path; a rule host fits the host and all its
subdomains; an empty rule table gives the default verdict everywhere; repeated urls are judged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Hexadecimal digits of the digest that are joined on, and rules up to which their table is broadcast.
SHORT, BROADCAST_RULES = 8, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """Columns host and path of a url column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages with url gets host, path, rule, verdict; rules has rule_host, rule_path, rule_verdict."""
    rules = rules.where("rule_host is not null and rule_path is not null").dropDuplicates().withColumn("rule", F.concat("rule_host", "rule_path"))
    rules = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, SHORT))
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]  # bounded by the longest path
    host, path = parts(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))
    shown = urls.select("url", F.explode(F.array_distinct(expressions)).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    hits = shown.join(rules, "short").where("digest = rule_digest and expression = rule")
    order = F.struct(F.length("rule"), (F.col("rule_verdict") == "block").alias("blocks"), F.col("rule"), F.col("rule_verdict"))
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("__best"))
    return (
        pages.withColumn("host", host).withColumn("path", path).join(best, "url", "left")
        .withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.coalesce(F.col("__best.rule_verdict"), F.lit(default))).drop("__best")
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS n
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.rule_verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.n = m.n AND m.k = 1
"""
