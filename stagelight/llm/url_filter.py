"""URL filter: a blocked Bloom filter of listed canonical URLs lets possible hits through to an exact hash join.

A listed entry is a canonical prefix, `host` + `path`: it fits its host and all subdomains where the path starts with the
entry's. A URL is looked up under each shape (number of host labels, length of path) that some entry has, so neither long
hosts nor long paths make more keys than there are shapes. Most keys end at the Bloom filter, before any shuffle; the hash
join with the list then removes its false positives.

Null URLs and those without `://` have an empty host and path, which no entry with a host fits. Repeated rows are judged
each on its own. Input columns other than the id and the URL aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, bloom, durable, probe, rows

#: Production list: rules with their verdicts, and hosts that are blocked where no rule fits.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LISTED = ["spam-farm.example.org/", "cheap-pills.example.com/"]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def entries(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """The list as a table: key, verdict, is_rule."""
    values = [{"key": k, "verdict": v, "is_rule": True} for v, k in rules] + [{"key": k, "verdict": "block", "is_rule": False} for k in listed]
    return rows(spark, values, {"key": "string", "verdict": "string", "is_rule": "boolean"})


def url_verdicts(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    listed has key, verdict and is_rule. The longest rule wins; without one, a listed entry blocks; else the URL is allowed.
    """
    host = F.substring_index("key", "/", 1)
    listed = listed.where("key is not null").groupBy("key", "is_rule").agg(F.min("verdict").alias("verdict"))
    listed = durable(listed.withColumn("labels", F.size(F.split(host, r"\."))).withColumn("path_chars", F.length("key") - F.length(host)), "listed")
    # Bounded by the shapes of the list, not by its length: at most labels x path lengths.
    shapes = [(r.labels, r.path_chars) for r in listed.select("labels", "path_chars").distinct().collect()]
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = durable(base.withColumn("_row", F.monotonically_increasing_id()), "urls")
    labels = F.size(F.split("host", r"\."))
    keys = [F.when((labels >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in shapes]
    looked_up = base.where("host <> ''").select("_row", F.explode(F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")).alias("key"))
    possible = probe(looked_up, F.col("key"), bloom(listed, F.col("key"), listed.count()), "possible").where("possible").drop("possible")
    hits = possible.join(listed, "key")
    found = hits.groupBy("_row").agg(
        F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("chars"), "key", "verdict"))).alias("rule"),
        F.max(F.when(~F.col("is_rule"), F.col("verdict") == "block")).alias("listed"),
    )
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("listed"), "block"), F.lit("allow"))
    return base.join(found, "_row", "left").select("page_id", "host", "path", F.col("rule.key").alias("rule"), verdict.alias("verdict"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), entries(spark))


OP10_SQL = r"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as r from pages),
list(verdict, h, p, is_rule) as (values ('allow', 'org', '/', true), ('block', 'example.org', '/es/', true), ('block', 'example.org', '/en/1', true),
  ('allow', 'com', '/fr/', true), ('block', 'com', '/de/', true), ('block', 'spam-farm.example.org', '/', false), ('block', 'cheap-pills.example.com', '/', false)),
hit as (select r, max_by(h || p, length(h || p)) filter (is_rule) as rule, max_by(verdict, length(h || p)) filter (is_rule) as said, bool_or(not is_rule) as listed
  from u, list where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, rule, coalesce(said, case when listed then 'block' else 'allow' end) as verdict from u left join hit using (r)
"""
