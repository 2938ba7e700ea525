"""URL filters by host suffix and path prefix.

Each URL is expanded into its host suffixes, as many as a rule's host has labels at most. They meet the rules'
hosts in an equi-join on a short hash prefix; where full digests agree, the path is expanded into prefixes
of the lengths that rules of that host have. These meet the rules in the same way, full digests confirm, and
the longest rule decides (ties: the longer host, then block). URLs that no rule fits get the default verdict.

Null URLs and URLs without :// have an empty host and path and take the default verdict. Repeated pages
are judged one by one; equal (host, path) pairs are expanded once. Rules without host are left out, without
path they have the empty one. Very long URLs: expansions are as many as the rules ask for. Columns of pages
with a result's name are replaced, all others stay. No rules, or no pages: no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules' table is broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_RULES = 100_000
PREFIX_BYTES = 4

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The digest of the columns, a line feed between, and its first bytes as the join's key."""
    digest = F.unhex(F.sha2(F.concat_ws("\n", *columns), 256))
    return df.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, PREFIX_BYTES))


def _confirmed(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """Rows of both sides with equal keys, confirmed by full digests."""
    right = right.withColumnRenamed("_digest", "_full")
    right = F.broadcast(right) if small else right
    return left.join(right, "_short").where("_digest = _full").drop("_short", "_digest", "_full")


def match_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites: distinct (host, path); rules: (host, path, verdict). The deciding rule of each site that has one."""
    rules = rules.where("host is not null").select(F.col("host").alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), "verdict")
    stats = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("_h", r"\."))).alias("labels")).first()
    small = stats["n"] <= BROADCAST_RULES
    suffixes = F.expr(f"transform(sequence(greatest(1, size(_labels) - {stats['labels'] or 1} + 1), size(_labels)), i -> concat_ws('.', slice(_labels, i, size(_labels))))")
    wide = sites.withColumn("_labels", F.split("host", r"\.")).select("host", "path", F.explode(suffixes).alias("_h"))
    hosts = rules.select("_h", F.length("_p").alias("_n")).distinct()
    wide = _confirmed(_keyed(wide, "_h"), _keyed(hosts, "_h").drop("_h"), small).where("_n <= length(path)")
    wide = wide.withColumn("_p", F.expr("substring(path, 1, _n)"))
    hits = _confirmed(_keyed(wide, "_h", "_p"), _keyed(rules, "_h", "_p").drop("_h", "_p"), small)
    rank = F.struct(F.length("_h") + F.length("_p"), F.length("_h"), F.col("verdict"))
    return hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), "verdict"), rank).alias("_best"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict to every row."""
    own = pages.select(*(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")))
    split = own.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    best = match_rules(split.select("host", "path").distinct(), rules)
    out = split.join(best, ["host", "path"], "left")
    return out.select(*own.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).drop("url")


OP10_SQL = r"""
with p as (select row_number() over () as r, page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
rules(h, q, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit as (select r, arg_max(h || q, length(h || q)) as rule, arg_max(v, length(h || q)) as verdict
        from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by r)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join hit using (r)
"""
