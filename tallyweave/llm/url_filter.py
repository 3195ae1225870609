"""URL rules by hashed expressions, with built-in functions only.

A rule is a host and a path prefix; it fits the host and all its subdomains where the path starts with its own, and
the longest fitting rule wins. Each URL is expanded into its host suffixes (by labels) and path prefixes of the sizes
that rules have. Expressions meet rules by the first 32 bits of their SHA-256; the whole digest confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of a digest that are joined on
DEFAULT = "allow"
#: The rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*(F.lit(value).alias(name) for name, value in zip(("verdict", "host", "path"), rule, strict=True)))
            for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule and verdict.

    ``rules`` has verdict, host and path. Of two rules with the same host and path, block wins. Without a fitting rule
    the verdict is allow and the rule null. A null URL, or one without ``://``, has an empty host and path and can be
    met only by a rule without both. Repeated rows give as many results. Other columns are ignored.
    """
    listed = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
              .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    shapes = listed.select(F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("labels"),
                           F.length("path").alias("chars")).distinct().collect()  # a few sizes, not the rules
    shapes = sorted((r.labels, r.chars) for r in shapes)

    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host_labels = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    expressions = [F.when((host_labels >= labels) & (F.length("path") >= chars),
                          F.concat(F.substring_index("host", ".", -labels) if labels else F.lit(""),
                                   F.substring("path", 1, chars))) for labels, chars in shapes]
    # every copy of a row brings as many expressions, so their count gives back the copies
    expanded = (urls.withColumn("expressions", F.array_compact(F.array(*expressions)).cast("array<string>"))
                .withColumn("each", F.greatest(F.size("expressions"), F.lit(1)))
                .select("page_id", "url", "host", "path", "each", F.explode_outer("expressions").alias("expression"))
                .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.left("digest", F.lit(SHORT))))
    named = listed.select(F.concat("host", "path").alias("rule"), "verdict").withColumn("digest", F.sha2("rule", 256))
    keyed = (named.groupBy(F.left("digest", F.lit(SHORT)).alias("short"))
             .agg(F.collect_list(F.struct("digest", "rule", "verdict")).alias("rules")))  # those that share 32 bits
    same = F.get(F.filter("rules", lambda r: r["digest"] == F.col("digest")), F.lit(0))
    best = F.max(F.when(same.isNotNull(), F.struct(F.length(same["rule"]).alias("chars"), same["rule"].alias("rule"),
                                                   same["verdict"].alias("verdict"))))
    return (expanded.join(keyed, "short", "left")
            .groupBy("page_id", "url", "host", "path", "each").agg(best.alias("best"), F.count("*").alias("rows"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"),
                    F.explode(F.sequence(F.lit(1), F.expr("rows div each"))).alias("copy"))
            .drop("copy"))


SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
         ('allow', 'org', '/fr/')
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
