"""Quality rules judged by host: rule failures are summed by domain, rates shrunk with an empirical beta prior, verdicts joined back.

A document's host is its source. Per rule each host meets a beta prior that is fitted to the other hosts by the method of
moments, so no host widens the prior that it is judged by, however few hosts there are. The prior counts as one to MOST_STRENGTH
documents, by how alike the others are: a host with few documents is judged mostly by what hosts are like and isn't rejected for one
bad page. A host is rejected when, by its posterior, its rate is above what TIMES the odds of the prior's mean give with a
probability of SURE; the mean counts as LEAST_MEAN at least, so rates that do no harm are no ground. Its documents go with it.
Where hosts are alike none goes. A host without others has no prior and stays. Documents that fail the base rule go in any case.

Everything is built-in column functions. A text's repeated windows are found inside its row: windows are hashed and sorted with
their places, so equal windows become neighbours, in n log n steps and without exploding words.

Null and empty texts have no words and fail the base rule. Very long texts take room in proportion to their words within one row.
Documents without a source have no host: only the base rule judges them. Repeated rows count each. Columns other than doc_id,
source and text aren't read, whatever their names. An empty table has no hosts and gives no rows.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, durable, fenced, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RULES = ("base_failed", "many_symbols", "many_dup_lines")
#: How sure it must be that a host fails at so many times the odds of others, whose rate counts as so much at least and so many documents at most.
SURE, TIMES, LEAST_MEAN, MOST_STRENGTH = 0.99, 3.0, 0.05, 19.0


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each text."""
    df = docs.select("doc_id", "source", text_of().alias("text"))
    df = fenced(df, words=F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE))
    df = fenced(df, lines=F.when(F.contains("text", F.lit("\n")), lines))
    df = df.select(
        "doc_id", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    df = fenced(df, hashes=F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    n = F.size("hashes")
    pairs = F.zip_with("hashes", F.slice("hashes", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = fenced(df, windows=F.zip_with(F.slice(pairs, 1, F.greatest(n - 2, F.lit(0))), F.slice("hashes", 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    df = fenced(df.drop("hashes"), sorted=F.expr("array_sort(transform(windows, (x, i) -> struct(x, i as i)))"))
    # Equal windows are neighbours now; the places of those that have one, in order.
    alike = "zip_with(sorted, slice(sorted, 2, size(sorted)), (a, b) -> if(a.x = b.x, array(a.i, b.i), null))"
    df = fenced(df, at=F.expr(f"sort_array(array_distinct(flatten(filter({alike}, p -> p is not null))))"))
    covered = F.expr("aggregate(zip_with(at, slice(at, 2, size(at)), (p, q) -> coalesce(cast(least(3, q - p) as long), 3L)), 0L, (s, x) -> s + x)")
    return df.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def judged(docs: DataFrame, times: float = TIMES) -> DataFrame:
    """The measures with base_failed, host_failed and kept."""
    df = measures(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumn("many_symbols", F.col("n_symbols") * 4 > F.col("word_chars")).withColumn("many_dup_lines", F.col("n_dup_lines") * 20 > F.col("n_words"))
    df = durable(df, "measures")
    hosts = durable(host_verdicts(df, times).select("source", "host_failed"), "hosts")  # written, so that its size is known to the join
    failed = F.coalesce("host_failed", F.lit(False))
    return df.join(hosts, "source", "left").withColumn("host_failed", failed).withColumn("kept", ~(F.col("base_failed") | failed))


def below(x: Column, a: Column, b: Column) -> Column:
    """The normal deviate of a beta variable's chance to be x at most: cube roots of its gamma parts are nearly normal (Paulson)."""
    u, v = F.cbrt(b * x), F.cbrt(a * (1 - x))
    return 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / F.sqrt(u * u / b + v * v / a)


def host_verdicts(df: DataFrame, times: float = TIMES) -> DataFrame:
    """A row per host: docs, each rule's failures, shrunk rate and limit, and host_failed."""
    hosts = df.where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    sums = [(F.count("*") - 1).alias("others"), F.sum(1 / F.col("docs")).alias("each")]
    for r in RULES:
        rate = F.col(r) / F.col("docs")
        sums += [F.sum(rate).alias(f"{r}_sum"), F.sum(rate * rate).alias(f"{r}_squares")]
    out, failed = hosts.crossJoin(F.broadcast(hosts.agg(*sums))), F.lit(False)  # one row of sums
    n = F.nullif(F.col("others"), F.lit(0))
    for r in RULES:
        rate = F.col(r) / F.col("docs")
        found = (F.col(f"{r}_sum") - rate) / n
        spread_found = F.when(n > 1, (F.col(f"{r}_squares") - rate * rate - n * found * found) / (n - 1)).otherwise(0.0)
        mean = F.least(F.greatest(found, F.lit(LEAST_MEAN)), F.lit(1 - LEAST_MEAN))
        spread = mean * (1 - mean)
        between = F.greatest(spread_found - spread * (F.col("each") - 1 / F.col("docs")) / n, spread / (MOST_STRENGTH + 1))  # what counting noise does not explain
        strength = F.greatest(spread / between - 1, F.lit(1.0))
        a, b = F.col(r) + strength * mean, F.col("docs") - F.col(r) + strength * (1 - mean)
        limit = times * mean / (1 - mean + times * mean)
        out = out.withColumn(f"{r}_rate", a / (a + b)).withColumn(f"{r}_limit", limit)
        failed = failed | (below(limit, a, b) <= -NormalDist().inv_cdf(SURE))
    failed = (F.col("others") > 0) & failed
    return out.withColumn("host_failed", failed).select("source", "docs", *RULES, *(f"{r}_{x}" for r in RULES for x in ("rate", "limit")), "host_failed")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


OP4_SQL = r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
  list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as windows from w),
numbered as (select *, row_number() over () as r from l),
x as (select r, unnest(windows) as win, unnest(range(1, len(windows) + 1)) as pos from numbered),
twice as (select r, pos from (select r, pos, count(*) over (partition by r, win) as n from x) where n > 1),
cover as (select r, count(distinct p) as n from (select r, unnest([pos, pos + 1, pos + 2]) as p from twice) group by r),
m as (select doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words from numbered left join cover using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols * 4 > word_chars as many_symbols, n_dup_lines * 20 > n_words as many_dup_lines from m),
h as (select source, rule, count(*) as docs, sum(failed::int)::double as failed from b cross join lateral (values ('base', base_failed), ('symbols', many_symbols), ('lines', many_dup_lines)) as v(rule, failed)
  where source is not null group by 1, 2),
p as (select rule, count(*) - 1 as others, sum(failed / docs) as total, sum(failed / docs * (failed / docs)) as squares, sum(1 / docs) as each from h group by rule),
o as (select source, docs, failed, others, (total - failed / docs) / others as found, squares - failed / docs * (failed / docs) as rest, (each - 1 / docs) / others as each from h join p using (rule) where others > 0),
q as (select *, least(greatest(found, 0.05), 0.95) as mean, case when others > 1 then (rest - others * found * found) / (others - 1) else 0 end as var from o),
s as (select *, greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * each, mean * (1 - mean) / 20) - 1, 1) as strength, 3 * mean / (1 - mean + 3 * mean) as x from q),
ab as (select source, x, failed + strength * mean as a, docs - failed + strength * (1 - mean) as b from s),
uv as (select *, cbrt(b * x) as u, cbrt(a * (1 - x)) as v from ab),
v as (select source, bool_or(3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / sqrt(u * u / b + v * v / a) <= -2.3263478740408408) as bad from uv group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or coalesce(bad, false)) as kept, coalesce(bad, false) as host_failed
from b left join v using (source)
"""
