"""Health of sources from their run log: streaks, yields, baselines and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_runs(runs: DataFrame, last: int) -> DataFrame:
    """The newest runs per venue with their rank rn; Spark cuts each task's groups before the shuffle."""
    newest = Window.partitionBy("venue_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)


def leading_empty_runs(runs: DataFrame, last: int = 10) -> DataFrame:
    """venue_id, streak: how many of the newest runs in a row succeeded and found nothing. A run that failed or found something ends it."""
    flagged = recent_runs(runs, last).withColumn("empty", ((F.col("status") == "success") & (F.coalesce("found", F.lit(0)) == 0)).cast("int"))
    upto = Window.partitionBy("venue_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("all_empty", F.min("empty").over(upto)).groupBy("venue_id").agg(F.sum("all_empty").alias("streak"), F.max(F.when((F.col("status") == "success") & (F.col("found") > 0), F.col("started_at"))).alias("last_good"))


def flakiness(runs: DataFrame, last: int = 10, least: int = 4, small: float = 5.0) -> DataFrame:
    """Shares of failed and empty runs among the newest; venues with few finds on average are exempt from the empty rule."""
    r = recent_runs(runs, last)
    out = r.groupBy("venue_id").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "success") & (F.col("found") == 0)).alias("empty"), F.avg("found").alias("mean_found")
    ).where(F.col("runs") >= least)
    flaky = F.when(2 * F.col("failed") >= F.col("runs"), "failing").when((2 * F.col("empty") >= F.col("runs")) & (F.col("mean_found") >= small), "empty").otherwise("ok")
    return out.withColumn("verdict", flaky)


def yield_drop(runs: DataFrame, new: int = 5, old: int = 20) -> DataFrame:
    """Mean finds of the newest successful runs over that of the ones before; venues with too few runs have no row."""
    r = recent_runs(runs.where("status = 'success'"), new + old)
    means = r.groupBy("venue_id").agg(F.avg(F.when(F.col("rn") <= new, F.col("found"))).alias("recent"), F.avg(F.when(F.col("rn") > new, F.col("found"))).alias("before"), F.count("*").alias("n"))
    return means.where(F.col("n") == new + old).withColumn("ratio", F.when(F.col("before") > 0, F.col("recent") / F.col("before"))).drop("n")


def freshness_score(hours: Column) -> Column:
    """100 up to a day, falling to 50 at three days and to 0 at ten; 0 if never."""
    return F.when(hours.isNull(), 0.0).when(hours <= 24, 100.0).when(hours <= 72, 100 - (hours - 24) * 50 / 48).when(hours <= 240, 50 - (hours - 72) * 50 / 168).otherwise(0.0)


def volume_score(count: Column, median: Column) -> Column:
    """Percent of the chain's median, 100 at most; 50 without a median, 0 without rows."""
    return F.when(count == 0, 0.0).when(median.isNull() | (median == 0), 50.0).otherwise(F.least(F.lit(100.0), 100 * count / median))


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def health(fresh: Column, volume: Column) -> Column:
    return half_up(0.6 * fresh + 0.4 * volume)


def leave_one_out_medians(values: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Per key the median of the value over the other keys of its group, from each value's rank: no pairs are formed.

    Without the element at rank r of n, the k-th of the rest is the k-th of all if k < r, else the (k + 1)-th.
    """
    by = Window.partitionBy(group)
    ranked = values.withColumn("_r", F.row_number().over(by.orderBy(value, key))).withColumn("_n", F.count("*").over(by))
    lo, hi = F.floor(F.col("_n") / 2).cast("int"), F.floor((F.col("_n") + 1) / 2).cast("int")  # of the n - 1 others
    # Only the three middle values of a group are needed.
    middle = ranked.where((F.col("_r") >= lo) & (F.col("_r") <= hi + 1)).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_middle"))
    pick = lambda k: F.element_at("_middle", F.when(k < F.col("_r"), k).otherwise(k + 1))
    return ranked.join(middle, group).select(group, key, value, F.when(F.col("_n") > 1, (pick(lo) + pick(hi)) / 2).alias("others_median"))
