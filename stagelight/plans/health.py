"""Source health and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.operators import health as H
from stagelight.plans.listing import ts
from stagelight.plans.registry import plan
from stagelight.sources.star import Star

AS_OF = "2024-01-30 12:00:00"
_RANKED = "r as (select *, row_number() over (partition by venue_id order by started_at desc, run_id desc) as rn from runs)"


@plan("latest_runs", f"with {_RANKED} select venue_id, run_id, status, found, rn from r where rn <= 3")
def latest_runs(s: Star) -> DataFrame:
    """W2."""
    return H.recent_runs(s.runs, 3).select("venue_id", "run_id", "status", "found", "rn")


@plan("silent_sources", f"""
with {_RANKED}, f as (select *, (status = 'success' and coalesce(found, 0) = 0)::int as empty from r where rn <= 10),
c as (select *, min(empty) over (partition by venue_id order by rn rows unbounded preceding) as all_empty from f)
select venue_id, sum(all_empty)::bigint as streak, max(case when status = 'success' and found > 0 then started_at end) as last_good from c group by 1
""")  # fmt: skip
def silent_sources(s: Star) -> DataFrame:
    """Leading runs that succeeded and found nothing."""
    return H.leading_empty_runs(s.runs)


@plan("circuit_breaker", f"""
with {_RANKED}, c as (select *, min((status = 'failed')::int) over (partition by venue_id order by rn rows unbounded preceding) as failing from r where rn <= 12)
select venue_id, sum(failing)::bigint as failures, case when sum(failing) >= 6 then 'warn' when sum(failing) >= 3 then 'tripped' else 'closed' end as state from c group by 1
""")  # fmt: skip
def circuit_breaker(s: Star) -> DataFrame:
    """Consecutive failures trip at 3 and warn at 6."""
    upto = Window.partitionBy("venue_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    c = H.recent_runs(s.runs, 12).withColumn("failing", F.min((F.col("status") == "failed").cast("int")).over(upto))
    n = F.sum("failing")
    return c.groupBy("venue_id").agg(n.alias("failures"), F.when(n >= 6, "warn").when(n >= 3, "tripped").otherwise("closed").alias("state"))


@plan("flaky_sources", f"""
with {_RANKED}, g as (select venue_id, count(*) as runs, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'success' and found = 0) as empty, avg(found) as mean_found from r where rn <= 10 group by 1)
select *, case when 2 * failed >= runs then 'failing' when 2 * empty >= runs and mean_found >= 5 then 'empty' else 'ok' end as verdict from g where runs >= 4
""")  # fmt: skip
def flaky_sources(s: Star) -> DataFrame:
    """W8, A3."""
    return H.flakiness(s.runs)


@plan("yield_drops", """
with r as (select *, row_number() over (partition by venue_id order by started_at desc, run_id desc) as rn from runs where status = 'success'),
g as (select venue_id, avg(found) filter (where rn <= 5) as recent, avg(found) filter (where rn > 5) as before, count(*) as n from r where rn <= 25 group by 1)
select venue_id, recent, before, case when before > 0 then recent / before end as ratio from g where n = 25
""")  # fmt: skip
def yield_drops(s: Star) -> DataFrame:
    """W9, A9."""
    return H.yield_drop(s.runs)


@plan("daily_vs_trailing", """
with d as (select started_at::date as day, count(*) as n from runs group by 1)
select a.day, a.n, avg(b.n) as trailing, round(100 * (a.n - avg(b.n)) / avg(b.n), 4) as change from d a left join d b on b.day between a.day - 7 and a.day - 1 group by 1, 2
""")  # fmt: skip
def daily_vs_trailing(s: Star) -> DataFrame:
    """A day against the mean of the seven before it, itself excluded; one row a day, so the window is small."""
    days = s.runs.groupBy(F.col("started_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    back = Window.orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    out = days.withColumn("trailing", F.avg("n").over(back))
    return out.withColumn("change", F.round(100 * (F.col("n") - F.col("trailing")) / F.col("trailing"), 4))


@plan("baseline_drop", """
with d as (select venue_id, started_at::date as day, count(*) as n from runs group by 1, 2),
b as (select venue_id, avg(n) as mean, count(*) as days from d where day < date '2024-01-24' group by 1 having count(*) >= 3), c as (select venue_id, avg(n) as now from d where day >= date '2024-01-24' group by 1)
select venue_id, mean, days, now, round(100 * (1 - coalesce(now, 0) / mean), 4) as drop_percent from b left join c using (venue_id)
""")  # fmt: skip
def baseline_drop(s: Star) -> DataFrame:
    """Daily counts, their mean, and the drop against it."""
    days = s.runs.groupBy("venue_id", F.col("started_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    old = F.col("day") < "2024-01-24"
    base = days.where(old).groupBy("venue_id").agg(F.avg("n").alias("mean"), F.count("*").alias("days")).where("days >= 3")
    now = days.where(~old).groupBy("venue_id").agg(F.avg("n").alias("now"))
    return base.join(now, "venue_id", "left").withColumn("drop_percent", F.round(100 * (1 - F.coalesce("now", F.lit(0.0)) / F.col("mean")), 4))


@plan("weekday_baselines", """
with d as (select venue_id, started_at::date as day, sum(found) as n from runs group by 1, 2 having sum(found) > 0)
select venue_id, case when count(*) filter (where dayofweek(day) not in (0, 6)) >= 3 then median(n) filter (where dayofweek(day) not in (0, 6)) end as weekday,
 case when count(*) filter (where dayofweek(day) in (0, 6)) >= 3 then median(n) filter (where dayofweek(day) in (0, 6)) end as weekend from d group by 1
""")  # fmt: skip
def weekday_baselines(s: Star) -> DataFrame:
    """Medians of weekdays and weekends, each from three days at least."""
    days = s.runs.groupBy("venue_id", F.col("started_at").cast("date").alias("day")).agg(F.sum("found").alias("n")).where("n > 0")
    weekend = F.dayofweek("day").isin(1, 7)
    guarded = lambda c: F.when(F.count_if(c) >= 3, F.median(F.when(c, F.col("n"))))
    return days.groupBy("venue_id").agg(guarded(~weekend).alias("weekday"), guarded(weekend).alias("weekend"))


@plan("deviation_from_baseline", """
with d as (select venue_id, started_at::date as day, sum(found) as n from runs group by 1, 2), b as (select venue_id, median(n) as base from d where day < date '2024-01-28' group by 1)
select venue_id, day, n::bigint as n, base, case when base = 0 then 'none' when abs(n - base) * 100 <= 40 * base then 'ok' when n < base then 'low' else 'high' end as verdict from d join b using (venue_id) where day >= date '2024-01-28'
""")  # fmt: skip
def deviation_from_baseline(s: Star) -> DataFrame:
    """Deviation with a tolerance in percent."""
    days = s.runs.groupBy("venue_id", F.col("started_at").cast("date").alias("day")).agg(F.sum("found").alias("n"))
    base = days.where(F.col("day") < "2024-01-28").groupBy("venue_id").agg(F.median("n").alias("base"))
    verdict = F.when(F.col("base") == 0, "none").when(F.abs(F.col("n") - F.col("base")) * 100 <= 40 * F.col("base"), "ok").when(F.col("n") < F.col("base"), "low").otherwise("high")
    return days.where(F.col("day") >= "2024-01-28").join(base, "venue_id").withColumn("verdict", verdict)


_HEALTH = f"""
with c as (select v.venue_id, v.chain, count(s.showing_id) as n from venues v left join (select * from showings where shows_at >= timestamp '2001-06-01') s using (venue_id) group by 1, 2),
m as (select a.venue_id, median(b.n) as others from c a left join c b on a.chain = b.chain and a.venue_id <> b.venue_id group by 1),
l as (select venue_id, date_diff('second', max(started_at), timestamp '{AS_OF}') / 3600.0 as hours from runs where status = 'success' group by 1),
f as (select c.venue_id, n, others, case when hours is null then 0 when hours <= 24 then 100 when hours <= 72 then 100 - (hours - 24) * 50 / 48 when hours <= 240 then 50 - (hours - 72) * 50 / 168 else 0 end as fresh,
 case when n = 0 then 0 when others is null or others = 0 then 50 else least(100, 100.0 * n / others) end as volume from c left join m using (venue_id) left join l using (venue_id))
select venue_id, n, others, floor(0.6 * fresh + 0.4 * volume + 0.5)::bigint as score, case when n = 0 then 'empty' when fresh = 0 then 'stale' when 0.6 * fresh + 0.4 * volume < 50 then 'poor' end as alert from f
"""


@plan("venue_health", _HEALTH)
def venue_health(s: Star) -> DataFrame:
    """Freshness and volume against the chain's other venues."""
    soon = s.showings.where(F.col("shows_at") >= ts("2001-06-01")).groupBy("venue_id").agg(F.count("*").alias("n"))
    counts = s.venues.select("venue_id", "chain").join(soon, "venue_id", "left").select("venue_id", "chain", F.coalesce("n", F.lit(0)).alias("n"))
    medians = H.leave_one_out_medians(counts, "chain", "venue_id", "n")
    last = s.runs.where("status = 'success'").groupBy("venue_id").agg(F.max("started_at").alias("last"))
    hours = F.timestamp_diff("SECOND", F.col("last"), ts(AS_OF)) / 3600.0
    df = medians.join(last, "venue_id", "left").withColumn("fresh", H.freshness_score(hours)).withColumn("volume", H.volume_score(F.col("n"), F.col("others_median")))
    alert = F.when(F.col("n") == 0, "empty").when(F.col("fresh") == 0, "stale").when(0.6 * F.col("fresh") + 0.4 * F.col("volume") < 50, "poor")
    return df.select("venue_id", "n", F.col("others_median").alias("others"), H.health(F.col("fresh"), F.col("volume")).alias("score"), alert.alias("alert"))


@plan("recent_vs_baseline_medians", """
with d as (select venue_id, started_at::date as day, count(*) as n from runs group by 1, 2), m as (select venue_id, median(n) filter (where day >= date '2024-01-24') as recent, median(n) filter (where day < date '2024-01-24') as base from d group by 1)
select venue_id, recent, base, case when base is null then 'no_baseline' when recent is null then 'no_recent' when recent < 0.5 * base then 'regressed' when recent < 0.8 * base then 'warn' else 'ok' end as status from m
""")  # fmt: skip
def recent_vs_baseline_medians(s: Star) -> DataFrame:
    """Y9."""
    days = s.runs.groupBy("venue_id", F.col("started_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    new = F.col("day") >= "2024-01-24"
    m = days.groupBy("venue_id").agg(F.median(F.when(new, F.col("n"))).alias("recent"), F.median(F.when(~new, F.col("n"))).alias("base"))
    status = F.when(F.col("base").isNull(), "no_baseline").when(F.col("recent").isNull(), "no_recent").when(F.col("recent") < 0.5 * F.col("base"), "regressed").when(F.col("recent") < 0.8 * F.col("base"), "warn").otherwise("ok")
    return m.withColumn("status", status)


@plan("completeness", """
select count(*) as n, count(*) filter (where source_id is null) as no_source, count(*) filter (where url = '') as no_url, count(*) filter (where url = '' and source_id is null) as neither,
 round(100.0 * count(*) filter (where source_id is null) / count(*), 4) as no_source_percent, round(100 - (30.0 * count(*) filter (where source_id is null) / count(*) + 15.0 * count(*) filter (where url = '') / count(*) + 10.0 * count(*) filter (where sold_out) / count(*)), 4) as composite from showings
""")  # fmt: skip
def completeness(s: Star) -> DataFrame:
    """All measures in one scan."""
    n, none, blank, sold = F.count("*"), F.count_if(F.col("source_id").isNull()), F.count_if(F.col("url") == ""), F.count_if("sold_out")
    return s.showings.agg(
        n.alias("n"), none.alias("no_source"), blank.alias("no_url"), F.count_if((F.col("url") == "") & F.col("source_id").isNull()).alias("neither"),
        F.round(100.0 * none / n, 4).alias("no_source_percent"), F.round(100 - (30.0 * none / n + 15.0 * blank / n + 10.0 * sold / n), 4).alias("composite"),
    )


@plan("attention_list", """
with g as (select venue_id, count(*) as showings, count(*) filter (where source_id is null) as no_source, count(*) filter (where url = '') as no_url, count(*) filter (where sold_out) as sold from showings group by 1)
select venue_id, showings, array_to_string(list_filter([case when no_source * 100 > 15 * showings then 'source' end, case when no_url * 100 > 8 * showings then 'url' end, case when sold * 100 > 55 * showings then 'sold' end], lambda x: x is not null), ',') as gaps from g
order by len(list_filter([case when no_source * 100 > 15 * showings then 1 end, case when no_url * 100 > 8 * showings then 1 end, case when sold * 100 > 55 * showings then 1 end], lambda x: x is not null)) desc, showings desc, venue_id limit 25
""")  # fmt: skip
def attention_list(s: Star) -> DataFrame:
    """Gaps per venue, most first."""
    over = lambda c, p, name: F.when(F.col(c) * 100 > p * F.col("showings"), name)
    g = s.showings.groupBy("venue_id").agg(F.count("*").alias("showings"), F.count_if(F.col("source_id").isNull()).alias("no_source"), F.count_if(F.col("url") == "").alias("no_url"), F.count_if("sold_out").alias("sold"))
    g = g.withColumn("g", F.array_compact(F.array(over("no_source", 15, "source"), over("no_url", 8, "url"), over("sold", 55, "sold"))))
    return g.orderBy(F.size("g").desc(), F.desc("showings"), "venue_id").limit(25).select("venue_id", "showings", F.array_join("g", ",").alias("gaps"))


@plan("stale_venues", f"""
select v.venue_id, max(started_at) as last_success from venues v left join (select * from runs where event_type = 'purchase') r using (venue_id) group by 1
having max(started_at) is null or max(started_at) < timestamp '{AS_OF}' - interval 3 day order by last_success asc nulls first, v.venue_id
""")  # fmt: skip
def stale_venues(s: Star) -> DataFrame:
    """The stalest first, never seen ones before all."""
    last = s.runs.where("event_type = 'purchase'").groupBy("venue_id").agg(F.max("started_at").alias("last_success"))
    df = s.venues.select("venue_id").join(last, "venue_id", "left").where(F.col("last_success").isNull() | (F.col("last_success") < F.timestamp_add("DAY", F.lit(-3), ts(AS_OF))))
    return df.orderBy(F.col("last_success").asc_nulls_first(), "venue_id")


@plan("week_over_week", """
with c as (select venue_id, count(*) filter (where started_at::date = date '2024-01-29') as today, count(*) filter (where started_at::date = date '2024-01-22') as last_week from runs where started_at::date in (date '2024-01-29', date '2024-01-22') group by 1)
select venue_id, coalesce(today, 0) as today, coalesce(last_week, 0) as last_week, case when last_week > 0 then round(100.0 * (today - last_week) / last_week, 4) end as change from (select venue_id from venues) left join c using (venue_id)
""")  # fmt: skip
def week_over_week(s: Star) -> DataFrame:
    """Two days in one conditional aggregation, all venues kept."""
    day = F.col("started_at").cast("date")
    c = s.runs.where(day.isin("2024-01-29", "2024-01-22")).groupBy("venue_id").agg(F.count_if(day == "2024-01-29").alias("today"), F.count_if(day == "2024-01-22").alias("last_week"))
    df = s.venues.select("venue_id").join(c, "venue_id", "left").fillna(0, ["today", "last_week"])
    return df.withColumn("change", F.when(F.col("last_week") > 0, F.round(100.0 * (F.col("today") - F.col("last_week")) / F.col("last_week"), 4)))


@plan("event_trend", """
select date_trunc('day', ts) as day, event_type, json_extract(props, '$.k')::int % 4 as kind, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3
""")  # fmt: skip
def event_trend(s: Star) -> DataFrame:
    """Counts by day and property."""
    kind = F.get_json_object("props", "$.k").cast("int") % 4
    return s.table("events").groupBy(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"), "event_type", kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan("event_funnel", """
with a as (select user_id, min(ts) as t from events where event_type = 'signup' group by 1), b as (select a.user_id, a.t as t0, min(e.ts) as t from a join events e on e.user_id = a.user_id and event_type = 'view' and e.ts > a.t and e.ts <= a.t + interval 14 day group by 1, 2),
c as (select b.user_id, min(e.ts) as t from b join events e on e.user_id = b.user_id and event_type = 'purchase' and e.ts > b.t and e.ts <= b.t0 + interval 14 day group by 1)
select 1 as step, (select count(*) from a) as users, 100.0::double as rate union all select 2, (select count(*) from b), round(100.0 * (select count(*) from b) / (select count(*) from a), 4) union all select 3, (select count(*) from c), round(100.0 * (select count(*) from c) / (select count(*) from a), 4)
""")  # fmt: skip
def event_funnel(s: Star) -> DataFrame:
    """Ordered steps within 14 days of the first, a join a step on the user."""
    e = s.table("events").select("user_id", "ts", "event_type")
    a = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0")).withColumn("t", F.col("t0"))
    steps = [a]
    for kind in ("view", "purchase"):
        step = e.where(F.col("event_type") == kind).select(F.col("user_id").alias("u"), F.col("ts").alias("next"))
        end = F.timestamp_add("DAY", F.lit(14), F.col("t0"))
        joined = steps[-1].join(step, (F.col("user_id") == F.col("u")) & (F.col("next") > F.col("t")) & (F.col("next") <= end))
        steps.append(joined.groupBy("user_id", "t0").agg(F.min("next").alias("t")))
    reached = steps[0].select(F.lit(1).alias("step"))
    for i, d in enumerate(steps[1:], 2):
        reached = reached.unionAll(d.select(F.lit(i).alias("step")))
    counts = reached.groupBy("step").agg(F.count("*").alias("users"))
    first = F.max(F.when(F.col("step") == 1, F.col("users"))).over(Window.partitionBy())
    return counts.withColumn("rate", F.round(100.0 * F.col("users") / first, 4))


@plan("venues_without_clicks", "select venue_id, name from venues v where not exists (select 1 from events e where e.user_id = v.venue_id and event_type = 'click' and ts >= timestamp '2024-01-29')")
def venues_without_clicks(s: Star) -> DataFrame:
    """An anti join."""
    clicks = s.runs.where((F.col("event_type") == "click") & (F.col("started_at") >= ts("2024-01-29")))
    return s.venues.join(clicks, "venue_id", "left_anti").select("venue_id", "name")


@plan("table_counts", "select (select count(*) from works) as works, (select count(*) from showings) as showings, (select count(*) from venues) as venues, (select count(*) from runs) as runs")
def table_counts(s: Star) -> DataFrame:
    """Scalar counts of several tables; one row each is joined."""
    counts = [getattr(s, t).agg(F.count("*").alias(t)) for t in ("works", "showings", "venues", "runs")]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out
