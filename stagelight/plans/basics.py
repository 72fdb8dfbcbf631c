"""Scans, null-tolerant filters, conditional counts and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.plans.registry import plan
from stagelight.sources.saved import shared_dir
from stagelight.sources.star import Star


@plan("table_scan", "select showing_id, work_id, venue_id, price from showings where source_id = 'src7' or source_id is null and price > 99000")
def table_scan(s: Star) -> DataFrame:
    """A projected scan with a null-tolerant filter; both reach the reader."""
    return s.showings.where((F.col("source_id") == "src7") | (F.col("source_id").isNull() & (F.col("price") > 99_000))).select("showing_id", "work_id", "venue_id", "price")


@plan("conditional_counts", "select format, count(case when sold_out then 1 end) as sold, count(case when url = '' then 1 end) as blank, count(*) - count(source_id) as loose from showings group by 1")
def conditional_counts(s: Star) -> DataFrame:
    """A4."""
    return s.showings.groupBy("format").agg(F.count(F.when(F.col("sold_out"), 1)).alias("sold"), F.count(F.when(F.col("url") == "", 1)).alias("blank"), (F.count("*") - F.count("source_id")).alias("loose"))


@plan("with_parameters", """
with p as (select 1990 as low, 920.0 as least) select genre, count(*) as n, round(sum(ln(1 + popularity)), 4) as weight, round(avg(exp(-abs(year - low) / 10.0)), 6) as near, max(greatest(0, least(100, floor(popularity / 10) - ceil(runtime / 3.0)))) as top from works, p where year >= low and popularity >= least group by 1
""")  # fmt: skip
def with_parameters(s: Star) -> DataFrame:
    """Parameters are literals in the plan, not a joined row."""
    low, least = 1990, 920.0
    w = s.works.where((F.col("year") >= low) & (F.col("popularity") >= least))
    top = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("popularity") / 10) - F.ceil(F.col("runtime") / 3.0)))
    return w.groupBy("genre").agg(F.count("*").alias("n"), F.round(F.sum(F.log1p("popularity")), 4).alias("weight"), F.round(F.avg(F.exp(-F.abs(F.col("year") - low) / 10.0)), 6).alias("near"), F.max(top).cast("double").alias("top"))


@plan("array_functions", """
select maker, array_to_string(list_sort(list_distinct(list(title))), ' / ') as titles, list_contains(list(title), 'red ring') as has_red_ring, len(list_intersect(list_distinct(list(genre)), ['promo', 'large'])) > 0 as overlaps from works group by 1
""")  # fmt: skip
def array_functions(s: Star) -> DataFrame:
    """X31, P7, P9, P10."""
    g = s.works.groupBy("maker").agg(F.sort_array(F.collect_set("title")).alias("t"), F.collect_set("genre").alias("g"))
    return g.select("maker", F.array_join("t", " / ").alias("titles"), F.array_contains("t", "red ring").alias("has_red_ring"), F.arrays_overlap("g", F.array(F.lit("promo"), F.lit("large"))).alias("overlaps"))


@plan("health_snapshots", """
with c as (select venue_id, count(*) as n from showings group by 1) select venue_id, n, 1 as snapshot from c union all select venue_id, n, 2 from c
""")  # fmt: skip
def health_snapshots(s: Star) -> DataFrame:
    """An append-only log of snapshots, a folder each, so that a snapshot that is taken again replaces itself."""
    path = f"{shared_dir(s.spark)}/snapshots-{uuid.uuid4().hex}"
    counts = s.showings.groupBy("venue_id").agg(F.count("*").alias("n"))
    for snapshot in (1, 2):
        counts.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")
    return s.spark.read.parquet(path).select("venue_id", "n", "snapshot")
