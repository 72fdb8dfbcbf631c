"""Grouped counts, spreads and rollups of the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.plans.listing import ts
from stagelight.plans.registry import plan
from stagelight.sources.star import Star


@plan("venue_counts", "select venue_id, count(*) as showings, count(distinct work_id) as works, count(distinct shows_at::date) as days from showings group by 1")
def venue_counts(s: Star) -> DataFrame:
    """A1, A2."""
    return s.showings.groupBy("venue_id").agg(F.count("*").alias("showings"), F.countDistinct("work_id").alias("works"), F.countDistinct(F.col("shows_at").cast("date")).alias("days"))


@plan("ordered_lists", """
select work_id, array_to_string(list_sort(list_distinct(list(format))), ',') as formats, string_agg(strftime(shows_at, '%d/%m %H:%M'), '; ' order by shows_at, venue_id, showing_id) as times from showings where shows_at < timestamp '1995-03-01' group by 1
""")  # fmt: skip
def ordered_lists(s: Star) -> DataFrame:
    """Distinct and ordered lists of a group."""
    rows = s.showings.where(F.col("shows_at") < ts("1995-03-01"))
    times = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shows_at", "venue_id", "showing_id"))), lambda x: F.date_format(x["shows_at"], "dd/MM HH:mm")), "; ")
    return rows.groupBy("work_id").agg(F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"), times.alias("times"))


@plan("newest_per_venue", "select venue_id, arg_max(showing_id, (shows_at, showing_id, work_id)) as newest, max(scraped_at) as fresh from showings group by 1")
def newest_per_venue(s: Star) -> DataFrame:
    """A8, A9."""
    return s.showings.groupBy("venue_id").agg(F.max_by("showing_id", F.struct("shows_at", "showing_id", "work_id")).alias("newest"), F.max("scraped_at").alias("fresh"))


@plan("repeated_urls", "select url, count(*) as rows, count(distinct work_id) as works from showings where url <> '' group by 1 having count(*) > 3 and count(distinct work_id) >= 3")
def repeated_urls(s: Star) -> DataFrame:
    """A10, A11."""
    g = s.showings.where("url <> ''").groupBy("url").agg(F.count("*").alias("rows"), F.countDistinct("work_id").alias("works"))
    return g.where("rows > 3 and works >= 3")


@plan("rows_with_shared_urls", "select showing_id, work_id, venue_id, price from showings where url in (select url from showings where url <> '' group by 1 having count(distinct venue_id) >= 8)")
def rows_with_shared_urls(s: Star) -> DataFrame:
    """IN over a grouped subquery, as a semi join."""
    shared = s.showings.where("url <> ''").groupBy("url").agg(F.countDistinct("venue_id").alias("n")).where("n >= 8")
    return s.showings.join(shared, "url", "left_semi").select("showing_id", "work_id", "venue_id", "price")


@plan("hour_spreads", """
select work_id, venue_id, shows_at::date as day, count(*) as n, max(shows_at) - min(shows_at) = interval 3 minute as three_minutes from showings group by 1, 2, 3 having count(*) > 1 and date_diff('second', min(shows_at), max(shows_at)) <= 36000
""")  # fmt: skip
def hour_spreads(s: Star) -> DataFrame:
    """Groups by the spread between their first and last time."""
    spread = F.timestamp_diff("SECOND", F.min("shows_at"), F.max("shows_at"))
    g = s.showings.groupBy("work_id", "venue_id", F.col("shows_at").cast("date").alias("day")).agg(F.count("*").alias("n"), spread.alias("s"))
    return g.where("n > 1 and s <= 36000").select("work_id", "venue_id", "day", "n", (F.col("s") == 180).alias("three_minutes"))


@plan("duplicate_totals", """
with g as (select work_id, venue_id, shows_at, count(*) as n from showings group by 1, 2, 3), h as (select source_id, venue_id, count(*) as n from showings where source_id is not null group by 1, 2)
select (select sum(n - 1)::bigint from g where n > 1) as extra_rows, (select count(*) from g where n > 1) as groups_of_rows, (select sum(case when n > 1 then n - 1 else 0 end)::bigint from h) as extra_sources
""")  # fmt: skip
def duplicate_totals(s: Star) -> DataFrame:
    """A17."""
    g = s.showings.groupBy("work_id", "venue_id", "shows_at").agg(F.count("*").alias("n"))
    h = s.showings.where("source_id is not null").groupBy("source_id", "venue_id").agg(F.count("*").alias("n"))
    a = g.agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("extra_rows"), F.count_if(F.col("n") > 1).alias("groups_of_rows"))
    return a.crossJoin(h.agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("extra_sources")))  # one row each


@plan("chain_medians", "select chain, count(*) as venues, median(rating) as rating, min(rating) as low, max(rating) as high from venues group by 1")
def chain_medians(s: Star) -> DataFrame:
    """The mean of the middle two for even groups."""
    return s.venues.groupBy("chain").agg(F.count("*").alias("venues"), F.median("rating").alias("rating"), F.min("rating").alias("low"), F.max("rating").alias("high"))


@plan("issue_counts", """
with i as (select unnest(list_filter([case when length(title) > 9 then 'error:long_title' end, case when year > 2020 then 'warning:year' end, case when runtime > 200 then 'warning:runtime' end], lambda x: x is not null)) as issue from works)
select split_part(issue, ':', 1) as level, split_part(issue, ':', 2) as kind, count(*) as n from i group by 1, 2
""")  # fmt: skip
def issue_counts(s: Star) -> DataFrame:
    """Errors and warnings by type."""
    found = F.array_compact(F.array(F.when(F.length("title") > 9, "error:long_title"), F.when(F.col("year") > 2020, "warning:year"), F.when(F.col("runtime") > 200, "warning:runtime")))
    i = s.works.select(F.explode(found).alias("issue"))
    return i.groupBy(F.split_part("issue", F.lit(":"), F.lit(1)).alias("level"), F.split_part("issue", F.lit(":"), F.lit(2)).alias("kind")).agg(F.count("*").alias("n"))


@plan("work_table", """
select work_id, min(shows_at)::date as first_day, max(shows_at)::date as last_day, count(distinct shows_at::date) as days, count(distinct venue_id) as venues, arg_min(venue_id, (scraped_at, showing_id, venue_id)) as primary_venue from showings group by 1
""")  # fmt: skip
def work_table(s: Star) -> DataFrame:
    """The primary venue is the one seen first."""
    return s.showings.groupBy("work_id").agg(
        F.min("shows_at").cast("date").alias("first_day"), F.max("shows_at").cast("date").alias("last_day"), F.countDistinct(F.col("shows_at").cast("date")).alias("days"),
        F.countDistinct("venue_id").alias("venues"), F.min_by("venue_id", F.struct("scraped_at", "showing_id", "venue_id")).alias("primary_venue"),
    )


@plan("status_tiers", """
with g as (select user_id, count(*) as n, count(*) filter (where status = 'seen') as seen, count(*) filter (where status = 'want') as want, count(*) filter (where status = 'skip') as skip from marks group by 1)
select c_custkey as user_id, coalesce(seen, 0) as seen, coalesce(want, 0) as want, coalesce(skip, 0) as skip, case when coalesce(n, 0) = 0 then 'none' when n < 5 then 'few' when n < 20 then 'some' else 'many' end as tier from customer left join g on c_custkey = user_id
""")  # fmt: skip
def status_tiers(s: Star) -> DataFrame:
    """Status counts and a tier per user, users without any kept."""
    g = s.marks.groupBy("user_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == k).alias(k) for k in ("seen", "want", "skip")))
    df = s.table("customer").select(F.col("c_custkey").alias("user_id")).join(g, "user_id", "left").fillna(0)
    return df.withColumn("tier", F.when(F.col("n") == 0, "none").when(F.col("n") < 5, "few").when(F.col("n") < 20, "some").otherwise("many")).drop("n")


@plan("source_coverage", """
select chain, count(*) as n, round(avg((source_id is not null)::int), 6) as with_source, round(avg((url <> '')::int), 6) as with_url from showings join venues using (venue_id) group by 1
""")  # fmt: skip
def source_coverage(s: Star) -> DataFrame:
    """A21."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.showings.join(s.venues, "venue_id").groupBy("chain").agg(F.count("*").alias("n"), share(F.col("source_id").isNotNull()).alias("with_source"), share(F.col("url") != "").alias("with_url"))


@plan("browse_catalogue", "select distinct title, genre from works order by title, genre limit 200")
def browse_catalogue(s: Star) -> DataFrame:
    """F10, T13."""
    return s.works.select("title", "genre").distinct().orderBy("title", "genre").limit(200)


@plan("night_clusters", """
select shows_at::date as day, work_id, count(*) as n, count(*) filter (where hour(shows_at) between 2 and 4) as night from showings group by 1, 2 having count(*) >= 3
""")  # fmt: skip
def night_clusters(s: Star) -> DataFrame:
    """Y11."""
    g = s.showings.groupBy(F.col("shows_at").cast("date").alias("day"), "work_id").agg(F.count("*").alias("n"), F.count_if(F.hour("shows_at").between(2, 4)).alias("night"))
    return g.where("n >= 3")


@plan("by_group_counts_rank", """
with g as (select chain, work_id, count(*) as n from showings join venues using (venue_id) group by 1, 2), r as (select *, row_number() over (partition by chain order by n desc, work_id) as place from g) select * from r where place <= 3
""")  # fmt: skip
def by_group_counts_rank(s: Star) -> DataFrame:
    """The most shown works of each chain."""
    g = s.showings.join(s.venues, "venue_id").groupBy("chain", "work_id").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("n"), "work_id"))).where("place <= 3")
