"""Finding and settling duplicates: close pairs, superseded rows, keepers, clusters and key migrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close_pairs(rows: DataFrame, keys: list[str], at: str, row_id: str, seconds: int, zero: bool = False) -> DataFrame:
    """Pairs a < b of rows with equal keys whose times differ by less than so many seconds.

    Times fall into buckets as wide as the limit, and each row meets its own bucket and the next: two equi joins in place of
    one over all rows of a key, so that a key with many rows spreads over its times.
    """
    timed = rows.select(*keys, F.col(at).alias("_t"), F.col(row_id).alias("_id"), F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).alias("_b"))
    left = timed.select(*keys, F.col("_t").alias("t1"), F.col("_id").alias("a"), "_b", F.explode(F.array(F.lit(0), F.lit(1))).alias("_d")).withColumn("_b", F.col("_b") + F.col("_d"))
    right = timed.withColumnsRenamed({"_t": "t2", "_id": "b"})
    gap = F.abs(F.timestamp_diff("SECOND", F.col("t1"), F.col("t2")))
    met = left.join(right, [*keys, "_b"]).withColumn("gap", gap).where((F.col("gap") < seconds) & ((F.col("gap") > 0) | F.lit(zero)))
    # In one bucket each pair is met from both sides, in neighbouring ones only from the earlier.
    met = met.where((F.col("_d") == 1) | (F.col("a") < F.col("b"))).where(F.col("a") != F.col("b"))
    return met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "gap").distinct()


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def ranked(rows: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """rows with place in their key's order and copies, the key's size."""
    by = Window.partitionBy(*keys)
    return rows.withColumn("place", F.row_number().over(by.orderBy(*order))).withColumn("copies", F.count("*").over(by))


def superseded(rows: DataFrame, run_start: Column, now: Column, hours: int = 3) -> DataFrame:
    """Future rows scraped before this run for which the run has a row of the same work and venue on the same day within some hours."""
    day = lambda: F.col("shows_at").cast("date")
    fresh = rows.where(F.col("scraped_at") >= run_start).select(F.col("work_id").alias("_w"), F.col("venue_id").alias("_v"), F.col("shows_at").alias("_t"), day().alias("_day"))
    old = rows.where((F.col("scraped_at") < run_start) & (F.col("shows_at") > now)).withColumn("_d", day())
    near = F.abs(F.timestamp_diff("SECOND", F.col("shows_at"), F.col("_t"))) <= hours * 3600
    return old.join(fresh, (F.col("work_id") == F.col("_w")) & (F.col("venue_id") == F.col("_v")) & (F.col("_d") == F.col("_day")) & near, "left_semi").drop("_d")


def moved_keys(rows: DataFrame, moves: DataFrame, key: str, unique: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows under new keys (moves: old, new), and those that a row of the new key already stands for.

    Where several rows would share a unique key, one stays: a row that already had the key, then the first in order.
    """
    mapped = rows.join(moves, F.col(key) == F.col("old"), "left").withColumn("_own", F.col("new").isNull()).withColumn(key, F.coalesce("new", key)).drop("old", "new")
    place = F.row_number().over(Window.partitionBy(*unique).orderBy(F.desc("_own"), *order))
    mapped = mapped.withColumn("_place", place)
    return mapped.where("_place = 1").drop("_place", "_own"), mapped.where("_place > 1").drop("_place", "_own")


def min_labels(links: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root: connected components of links (a, b) by contraction; save cuts the lineage of a round's small tables."""
    both = links.where("a is not null and b is not null")
    labels = save(both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    edges = save(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        up = save(edges.groupBy(F.col("b").alias("_n")).agg(F.min("a").alias("_t")))
        labels = save(labels.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_t", "root").alias("root")))
        low = edges.join(up, F.col("a") == F.col("_n"), "left").select(F.coalesce("_t", "a").alias("a"), "b")
        high = low.join(up, F.col("b") == F.col("_n")).select("a", F.col("_t").alias("b")).where("a <> b")
        edges = save(high.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
