"""URL filtering by host-suffix and path-prefix rules, in DataFrame functions only.

A URL is expanded into expressions (a host suffix followed by a path prefix).  Expressions and rules
meet in an equi-join on a short prefix of their SHA-256; the full digest confirms; the longest rule
decides.  Only suffix depths and prefix lengths that some rule has are expanded, which loses no
match, and each distinct (host, start of the path) is expanded once, so a host that holds a third
of all pages is expanded a few times.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"


#: The rules of the query: fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", digest_prefix: int = 8) -> DataFrame:
    """One row a page: id, host, path, rule (null if none fits) and verdict.

    `rules` is a tuple or a table (action, rule_host, rule_path) of any size.  A rule fits its host
    and all subdomains if the path starts with the rule's; the longest fitting rule wins, among equal
    lengths the one with the longer host, then block.  Defined cases: a null url or one without
    `://` has an empty host and path and takes the default; an empty path starts with no rule's
    path but the empty one; a null or repeated id keeps its own row; other columns are ignored.
    """
    listed = rules if isinstance(rules, DataFrame) else rule_table(pages, rules)
    listed = listed.select("action", F.translate("rule_host", string.ascii_uppercase, string.ascii_lowercase).alias("rule_host"), "rule_path").dropna().distinct()
    # One row; the set has at most one entry for each length that a path can have.
    shape = listed.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("depth")).first()
    lengths, depth = shape["lengths"] or [], shape["depth"] or 0
    judged = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not lengths:
        return judged.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = judged.withColumn("head", F.substring("path", 1, max(lengths)))

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda k: F.array_join(F.slice(labels, -k, k), ".")
    )
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n))
    expanded = (
        judged.select("host", "head").distinct()
        .select("host", "head", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "head", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "head", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, digest_prefix))
    )
    hashed = listed.withColumn("rule", F.concat("rule_host", "rule_path")).select(
        "rule", F.length("rule_host").alias("host_length"), (F.col("action") == "block").alias("blocks"), F.sha2("rule", 256).alias("rule_digest")
    ).withColumn("rule_short", F.substring("rule_digest", 1, digest_prefix))
    best = (
        expanded.join(hashed, F.col("short") == F.col("rule_short"))
        .where("digest = rule_digest")
        .groupBy("host", "head")
        .agg(F.max(F.struct(F.length("rule").alias("length"), "host_length", "blocks", "rule")).alias("best"))
    )
    return judged.join(best, ["host", "head"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").otherwise(default).alias("verdict"),
    )


ORACLE_SQL = """
WITH rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, row_number() OVER () AS k,
  CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, k, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT c.k, r.action, r.h || r.p AS rule, row_number() OVER (PARTITION BY c.k ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.action DESC) AS n
  FROM cut c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM cut c LEFT JOIN fit f ON f.k = c.k AND f.n = 1
"""
