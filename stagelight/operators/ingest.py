"""Ingestion: validation, matching tiers, keyed upserts, diff gates and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validated(rows: DataFrame, now: Column, horizon_days: int = 90) -> DataFrame:
    """rows with errors and warnings, arrays of names; valid rows have no error."""
    title = F.length(F.trim("title"))
    hour = F.hour("shows_at")
    days = F.timestamp_diff("DAY", now, F.col("shows_at"))
    error = lambda c, name: F.when(c, name)
    return rows.withColumn(
        "errors",
        F.array_compact(F.array(
            error(F.col("title").isNull() | (title < 2), "title_short"), error(title > 200, "title_long"), error(F.col("shows_at").isNull(), "no_time"), error(F.col("shows_at") < now, "past"),
            error((hour < 10) & ~F.col("iso"), "early"), error(days > F.when(F.col("iso"), 2 * horizon_days).otherwise(horizon_days), "far"), error(F.coalesce("url", F.lit("")) == "", "no_url"),
            error((F.col("url") != "") & ~F.col("url").rlike("^https?://"), "bad_url"),
        )),
    ).withColumn("warnings", F.array_compact(F.array(error((hour < 10) & F.col("iso"), "early"), error(F.col("source_id").isNull(), "no_source"))))


def first_by_source(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each source id; rows without one all stay."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where((F.col("_n") == 1) | F.col(keys[-1]).isNull()).drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], keep_old_if_null: list[str] = ()) -> DataFrame:
    """stored with incoming rows put in by key. Null keys match nothing. Of incoming rows alike in key the first in order counts.

    Columns in keep_old_if_null take a new value only if it is not null. Rewrites the table: plain files have no MERGE.
    """
    columns = stored.columns
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    new = incoming.where(whole).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    renamed = new.withColumnsRenamed({c: f"_new_{c}" for c in columns if c not in keys}).withColumn("_hit", F.lit(True))
    joined = stored.where(whole).join(renamed, keys, "full")
    value = lambda c: F.coalesce(f"_new_{c}", c) if c in keep_old_if_null else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    merged = joined.select(*(F.col(c) if c in keys else value(c).alias(c) for c in columns))
    return merged.unionByName(stored.where(~whole)).unionByName(incoming.where(~whole).select(columns))


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the incoming rows whose key it has not."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (added, removed, unchanged), by one full join."""
    a, b = old.select(*keys).distinct().withColumn("_a", F.lit(1)), new.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged").alias("change"))


def diff_gate(changes: DataFrame) -> DataFrame:
    """One row: counts and a verdict: block if all would go, warn if over half of five or more would."""
    n = lambda c: F.count_if(F.col("change") == c)
    g = changes.agg(n("added").alias("added"), n("removed").alias("removed"), n("unchanged").alias("unchanged"))
    had = F.col("removed") + F.col("unchanged")
    return g.withColumn("verdict", F.when((had > 0) & (F.col("unchanged") == 0) & (F.col("added") == 0), "block").when((had >= 5) & (2 * F.col("removed") > had), "warn").otherwise("pass"))


def phantoms(rows: DataFrame, run_start: Column, now: Column, most_percent: int = 40) -> DataFrame:
    """Future rows that a run should have seen again and did not, per venue up to the latest time it saw; none where they are over a share of the venue's future rows."""
    future = rows.where(F.col("shows_at") > now)
    by = Window.partitionBy("venue_id")
    seen = F.col("scraped_at") >= run_start
    marked = future.withColumn("_until", F.max(F.when(seen, F.col("shows_at"))).over(by)).withColumn("_gone", ~seen & (F.col("shows_at") <= F.col("_until")))
    marked = marked.withColumn("_share", 100 * F.sum(F.col("_gone").cast("int")).over(by) / F.count("*").over(by))
    return marked.where(F.col("_gone") & (F.col("_share") <= most_percent)).drop("_until", "_gone", "_share")


def tiered_matches(left: DataFrame, right: DataFrame, key: str, tiers: list[Column], order: list[Column], on: Column) -> DataFrame:
    """The best partner of each left row by the first tier that holds, then by order; left rows without one are left out."""
    tier = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(tiers)))
    met = left.join(right, on).withColumn("tier", tier).where("tier is not null")
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("tier", *order))).where("_n = 1").drop("_n")


def latest_wins(items: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest item of each key; of items alike in time the later one."""
    return items.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in items.columns if c not in keys]), F.struct(at, tie)).alias("_i")).select(*keys, "_i.*")


def synced(server: DataFrame, client: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Both sides' items by key: the client's only if strictly newer."""
    columns = [c for c in server.columns if c not in keys]
    c = client.withColumnsRenamed({x: f"_c_{x}" for x in columns})
    joined = server.join(c, keys, "full")
    newer = F.col(at).isNull() | (F.col(f"_c_{at}") > F.col(at))
    newer = F.coalesce(newer & F.col(f"_c_{at}").isNotNull(), F.lit(False))
    return joined.select(*keys, *(F.when(newer, F.col(f"_c_{x}")).otherwise(F.col(x)).alias(x) for x in columns), F.when(newer, "client").otherwise("server").alias("winner"))


@dataclass(frozen=True)
class Venue:
    venue_id: int
    aliases: tuple[str, ...]


def calendar_events(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, uid, starts, summary of the events in calendar files: folded lines are joined, escapes undone, and events without one of these left out."""
    unfolded = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n[ \t]", "")
    event = lines.select(key, F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("event"))
    part = lambda name: F.regexp_extract("event", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
    undone = F.replace(F.replace(F.replace(part("SUMMARY"), F.lit("\\,"), F.lit(",")), F.lit(r"\;"), F.lit(";")), F.lit("\\n"), F.lit("\n"))
    out = event.select(key, part("UID").alias("uid"), F.try_to_timestamp(F.regexp_replace(part("DTSTART"), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz").alias("starts"), undone.alias("summary"))
    return out.where("uid <> '' and summary <> '' and starts is not null")


def attempts(runs: DataFrame, keys: list[str], at: str, good: Column, most: int) -> DataFrame:
    """keys, attempts (those after the last good one, or all), last_at, given_up: whether these are `most` or more. Two sums: no key's runs are collected."""
    last = runs.groupBy(*keys).agg(F.max(F.when(good, F.col(at))).alias("_good"), F.max(at).alias("last_at"))
    later = runs.select(*keys, at).join(last.select(*keys, "_good"), keys).where(F.col("_good").isNull() | (F.col(at) > F.col("_good"))).groupBy(*keys).agg(F.count("*").alias("attempts"))
    n = F.coalesce("attempts", F.lit(0)).cast("long")
    return last.join(later, keys, "left").select(*keys, n.alias("attempts"), "last_at", (n >= most).alias("given_up"))
