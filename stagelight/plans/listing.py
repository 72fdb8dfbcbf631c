"""Listing pages, calendars and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions import calendar
from stagelight.operators import listing as L
from stagelight.plans.registry import plan
from stagelight.sources.star import Star

AS_OF = "1998-06-01 12:00:00"
def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def london_sql(c: str = "shows_at") -> str:
    """SQL for local time."""
    return f"timezone('Europe/London', timezone('UTC', {c}))"


@plan("listing_page", f"""
select showing_id, shows_at, title, year, name, chain, price from showings join works using (work_id) join venues using (venue_id)
where shows_at >= timestamp '{AS_OF}' and shows_at <= timestamp '1998-06-15 23:59:59' and maker in ('Brand#1', 'Brand#2', 'Brand#3')
order by shows_at, showing_id, work_id, venue_id, price limit 51
""")  # fmt: skip
def listing_page(s: Star) -> DataFrame:
    """The flagship: a star join, a clamped window, a list filter and the first keyset page."""
    start, end = calendar.clamp_window(ts(AS_OF), None)
    rows = s.showings.where(F.col("shows_at").between(start, end)).join(s.works.where(F.col("maker").isin("Brand#1", "Brand#2", "Brand#3")), "work_id").join(s.venues, "venue_id")
    page = L.keyset_page(rows, ["shows_at", "showing_id", "work_id", "venue_id", "price"], None, 50)
    return page.select("showing_id", "shows_at", "title", "year", "name", "chain", "price")


@plan("listing_next_page", """
select showing_id, shows_at, work_id, venue_id, price from showings where (shows_at, showing_id, work_id) > (timestamp '1999-01-01 00:00:00', 100, 0)
order by shows_at, showing_id, work_id, venue_id, price limit 26
""")  # fmt: skip
def listing_next_page(s: Star) -> DataFrame:
    """The page after a cursor."""
    rows = s.showings.select("showing_id", "shows_at", "work_id", "venue_id", "price")
    cursor = L.decode_cursor(L.encode_cursor("1999-01-01 00:00:00", "100"))
    rows = rows.where(F.struct("shows_at", "showing_id", "work_id") > F.struct(F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(int(cursor[1])).cast("long"), F.lit(0).cast("long")))
    return L.keyset_page(rows, ["shows_at", "showing_id", "work_id", "venue_id", "price"], None, 25)


@plan("listing_nested", f"""
select showing_id, shows_at, work_id as w_id, title as w_title, venue_id as v_id, chain as v_chain from showings join works using (work_id) join venues using (venue_id)
where shows_at >= timestamp '{AS_OF}' and shows_at < timestamp '1998-06-03 00:00:00'
""")  # fmt: skip
def listing_nested(s: Star) -> DataFrame:
    """Nested projection and struct access."""
    rows = L.nested(s.listing().where((F.col("shows_at") >= ts(AS_OF)) & (F.col("shows_at") < "1998-06-03")))
    return rows.select("showing_id", "shows_at", F.col("work.work_id").alias("w_id"), F.col("work.title").alias("w_title"), F.col("venue.venue_id").alias("v_id"), F.col("venue.chain").alias("v_chain"))


_STRICT = L.Filters(search="ring", date_from="1999-03-01", date_to="1999-04-30", hour_from=17, hour_to=22, formats=["35mm", "imax"], decades=["80s", "90s", "2000s"])
_OPEN = L.Filters(search="gear", date_from="1999-03-01", date_to="1999-04-30", hour_from=12, genres=["Promo", "LARGE"], times_of_day=["afternoon", "evening"], single_only=True)


@plan("calendar_strict", f"""
with l as (select *, {london_sql()} as local from showings join works using (work_id) join venues using (venue_id) where shows_at > timestamp '{AS_OF}')
select showing_id, work_id, venue_id, shows_at, price from l where (title ilike '%ring%' or name ilike '%ring%' or maker ilike '%ring%') and local::date between '1999-03-01' and '1999-04-30'
and hour(local) between 17 and 22 and format in ('35mm', 'imax') and case when year < 1970 then 'Pre-1970' when year >= 2000 then (year // 10 * 10) || 's' else (year // 10 * 10 % 100) || 's' end in ('80s', '90s', '2000s')
""")  # fmt: skip
def calendar_strict(s: Star) -> DataFrame:
    """P6, P12, P15, X21."""
    return L.calendar_strict(s.listing(), _STRICT, ts(AS_OF)).select("showing_id", "work_id", "venue_id", "shows_at", "price")


@plan("calendar_open", f"""
with l as (select *, {london_sql()} as local from showings join works using (work_id) join venues using (venue_id) where shows_at >= timestamp '{AS_OF}'),
f as (select * from l where (title ilike '%gear%' or maker ilike '%gear%') and local::date between '1999-03-01' and '1999-04-30' and hour(local) >= 12 and genre in ('promo', 'large')
  and case when hour(local) < 12 then 'morning' when hour(local) < 17 then 'afternoon' when hour(local) < 21 then 'evening' else 'late' end in ('afternoon', 'evening'))
select showing_id, work_id, venue_id, shows_at, price from f qualify count(*) over (partition by local::date, work_id) = 1
""")  # fmt: skip
def calendar_open(s: Star) -> DataFrame:
    """P13, P16, P17, P18, P19."""
    return L.calendar_open(s.listing(), _OPEN, ts(AS_OF)).select("showing_id", "work_id", "venue_id", "shows_at", "price")


@plan("calendar_groups", f"""
with l as (select *, ({london_sql()})::date as day from showings join works using (work_id) where shows_at between timestamp '{AS_OF}' and timestamp '1998-07-01 00:00:00')
select day, work_id, title, count(*) as showings, count(distinct venue_id) as venues, array_to_string(list_sort(list_distinct(list(format))), ',') as formats, min(shows_at) as earliest from l group by 1, 2, 3
""")  # fmt: skip
def calendar_groups(s: Star) -> DataFrame:
    """A26, A6, P5."""
    rows = s.showings.where(F.col("shows_at").between(ts(AS_OF), ts("1998-07-01"))).join(s.works, "work_id")
    return L.by_work_and_day(rows)


@plan("calendar_top", f"""
with l as (select *, ({london_sql()})::date as day from showings join works using (work_id) join venues using (venue_id) where shows_at between timestamp '{AS_OF}' and timestamp '1998-06-08 00:00:00'),
g as (select day, work_id, max(case when popularity > 950 then year end) as rating, max(popularity) as popularity, min(shows_at) as earliest from l group by 1, 2),
r as (select *, row_number() over (partition by day order by rating is null, rating desc, popularity desc, earliest, work_id) as place from g)
select day, work_id, place from r where place <= 5
""")  # fmt: skip
def calendar_top(s: Star) -> DataFrame:
    """The first five works of each day by priority."""
    rows = s.showings.where(F.col("shows_at").between(ts(AS_OF), ts("1998-06-08"))).join(s.works, "work_id")
    groups = rows.groupBy(calendar.london(F.col("shows_at")).cast("date").alias("day"), "work_id").agg(
        F.max(F.when(F.col("popularity") > 950, F.col("year"))).alias("rating"), F.max("popularity").alias("popularity"), F.min("shows_at").alias("earliest")
    )
    place = F.row_number().over(Window.partitionBy("day").orderBy(*L.priority(groups), "work_id"))
    return groups.withColumn("place", place).where("place <= 5").select("day", "work_id", "place")


@plan("programme_kinds", """
select kind, count(*) as n, count(distinct work_id) as works from (select work_id, unnest(list_filter([case when year < 1996 then 'repertory' end,
 case when not (year < 1996) and format <> 'imax' and year >= 1997 then 'new_release' end, case when format = 'imax' then 'special_event' end, case when year > 1998 then 'preview' end], lambda x: x is not null)) as kind
 from showings join works using (work_id)) group by 1
""")  # fmt: skip
def programme_kinds(s: Star) -> DataFrame:
    """P14, P9, J8."""
    rows = L.programme_kinds(s.showings.join(s.works, "work_id"), 1998)
    return rows.select("work_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("work_id").alias("works"))


@plan("upcoming_by_work", f"""
select work_id, title, count(shows_at) as upcoming, min(shows_at) as first_at from works left join (select * from showings where shows_at >= timestamp '2001-10-01') using (work_id) group by 1, 2
""")  # fmt: skip
def upcoming_by_work(s: Star) -> DataFrame:
    """Zero counts kept; the right side is filtered before the left join."""
    soon = s.showings.where(F.col("shows_at") >= ts("2001-10-01")).groupBy("work_id").agg(F.count("*").alias("n"), F.min("shows_at").alias("first_at"))
    return s.works.join(soon, "work_id", "left").select("work_id", "title", F.coalesce("n", F.lit(0)).alias("upcoming"), "first_at")


@plan("next_showing", f"""
select work_id, next_at, next_venue from works join lateral (select shows_at as next_at, venue_id as next_venue from showings s where s.work_id = works.work_id and shows_at > timestamp '{AS_OF}' order by shows_at, venue_id limit 1) on true
""")  # fmt: skip
def next_showing(s: Star) -> DataFrame:
    """The next showing per work, by one pre-aggregation."""
    first = s.showings.where(F.col("shows_at") > ts(AS_OF)).groupBy("work_id").agg(F.min(F.struct("shows_at", "venue_id")).alias("f"))
    return s.works.join(first, "work_id").select("work_id", F.col("f.shows_at").alias("next_at"), F.col("f.venue_id").alias("next_venue"))


@plan("works_with_marks", """
select w.work_id, title, count(*) as users, count(*) filter (where status = 'seen') as seen, count(*) filter (where status = 'want') as wanted from works w join marks m on w.work_id = m.work_id group by 1, 2
""")  # fmt: skip
def works_with_marks(s: Star) -> DataFrame:
    """A3, A28, J1."""
    return s.marks.join(s.works, "work_id").groupBy("work_id", "title").agg(
        F.count("*").alias("users"), F.count_if(F.col("status") == "seen").alias("seen"), F.count_if(F.col("status") == "want").alias("wanted")
    )


@plan("user_status_of_showings", """
select s.showing_id, s.work_id, s.venue_id, s.price, m.status from showings s left join
 (select work_id, arg_max(status, (updated_at, mark_id)) as status from marks where user_id = 7 group by 1) m on s.work_id = m.work_id where s.shows_at < timestamp '1995-03-01'
""")  # fmt: skip
def user_status_of_showings(s: Star) -> DataFrame:
    """Left join on (key, user), the user's latest mark."""
    mine = s.marks.where("user_id = 7").groupBy("work_id").agg(F.max_by("status", F.struct("updated_at", "mark_id")).alias("status"))
    rows = s.showings.where(F.col("shows_at") < ts("1995-03-01"))
    return rows.join(mine, "work_id", "left").select("showing_id", "work_id", "venue_id", "price", "status")


@plan("season_works", """
select distinct w.work_id, w.title from works w where w.work_id in (select work_id from marks where status = 'want' and updated_at >= timestamp '2001-06-01')
""")  # fmt: skip
def season_works(s: Star) -> DataFrame:
    """A semi join in place of two round trips."""
    wanted = s.marks.where("status = 'want'").where(F.col("updated_at") >= ts("2001-06-01"))
    return s.works.join(wanted, "work_id", "left_semi").select("work_id", "title")


@plan("festival_listing", """
with f(festival, chain, starts, ends) as (values ('spring', 'NATION_3', date '1998-03-20', date '1998-04-05'), ('summer', 'NATION_7', date '1998-07-01', date '1998-07-14'), ('winter', 'NATION_3', date '1998-12-01', date '1998-12-20'))
select festival, count(*) as showings, count(distinct work_id) as works, min(shows_at) as first_at, max(shows_at) as last_at from showings join venues using (venue_id) join f on f.chain = venues.chain and shows_at::date between starts and ends group by 1
""")  # fmt: skip
def festival_listing(s: Star) -> DataFrame:
    """Showings inside a festival's window at its venues: an equi join with a range residual."""
    windows = s.spark.createDataFrame([("spring", "NATION_3", "1998-03-20", "1998-04-05"), ("summer", "NATION_7", "1998-07-01", "1998-07-14"), ("winter", "NATION_3", "1998-12-01", "1998-12-20")], "festival string, chain string, starts string, ends string")
    at = s.venues.select("venue_id", "chain").join(windows, "chain")
    day = F.col("shows_at").cast("date")
    inside = s.showings.join(at, "venue_id").where(day.between(F.col("starts").cast("date"), F.col("ends").cast("date")))
    return inside.groupBy("festival").agg(F.count("*").alias("showings"), F.countDistinct("work_id").alias("works"), F.min("shows_at").alias("first_at"), F.max("shows_at").alias("last_at"))


@plan("single_showings", f"""
select showing_id, work_id, venue_id, shows_at, price from (select *, count(*) over (partition by ({london_sql()})::date, work_id) as n from showings where shows_at >= timestamp '2001-09-01') where n = 1
""")  # fmt: skip
def single_showings(s: Star) -> DataFrame:
    """P18, W5."""
    rows = s.showings.where(F.col("shows_at") >= ts("2001-09-01")).select("showing_id", "work_id", "venue_id", "shows_at", "price")
    return L.calendar_open(rows.withColumns({"format": F.lit(None), "genre": F.lit(None), "year": F.lit(None)}), L.Filters(single_only=True), ts("1990-01-01")).select("showing_id", "work_id", "venue_id", "shows_at", "price")


@plan("area_clusters", """
with c(label, places) as (values ('near', ['AFRICA', 'ASIA']), ('far', ['AMERICA']))
select label, venue_id from venues join c on len(list_filter(places, lambda p: contains(area, p))) > 0
""")  # fmt: skip
def area_clusters(s: Star) -> DataFrame:
    """Venues by label, an explode of the few places and a containment test."""
    labels = {"near": ["AFRICA", "ASIA"], "far": ["AMERICA"]}
    found = F.array_compact(F.array(*(F.when(L.any_of(*(F.contains("area", F.lit(p)) for p in places)), F.lit(label)) for label, places in labels.items())))
    return s.venues.select("venue_id", F.explode(found).alias("label"))


@plan("boolean_sort", """
select title, n, row_number() over (order by title = 'red ring' desc, starts_with(title, 'red') desc, n desc, title) as place from (select title, count(*) as n from works group by 1)
qualify place <= 20
""")  # fmt: skip
def boolean_sort(s: Star) -> DataFrame:
    """Exact hits first, then prefixes, then by count; the window sees the top rows only."""
    counted = s.works.groupBy("title").agg(F.count("*").alias("n"))
    order = [(F.col("title") == "red ring").desc(), F.startswith("title", F.lit("red")).desc(), F.col("n").desc(), F.col("title").asc()]
    return counted.orderBy(*order).limit(20).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@plan("limit_before_filter", """
select showing_id, work_id, venue_id, shows_at from (select * from showings where shows_at >= timestamp '1998-01-01' order by shows_at, showing_id, work_id, venue_id, price limit 1000) where shows_at < timestamp '1998-01-10'
""")  # fmt: skip
def limit_before_filter(s: Star) -> DataFrame:
    """The earliest thousand rows first, then the end date."""
    first = s.showings.where(F.col("shows_at") >= ts("1998-01-01")).orderBy("shows_at", "showing_id", "work_id", "venue_id", "price").limit(1000)
    return first.where(F.col("shows_at") < ts("1998-01-10")).select("showing_id", "work_id", "venue_id", "shows_at")


@plan("priority_union", """
with up as (select distinct work_id from showings where shows_at >= timestamp '2001-11-01'), t as (select work_id, title, 0 as tier from works semi join up using (work_id) union all select work_id, title, 1 from works anti join up using (work_id))
select work_id, title, tier from t order by tier, work_id limit 150
""")  # fmt: skip
def priority_union(s: Star) -> DataFrame:
    """Works with upcoming showings first, then the rest."""
    soon = s.showings.where(F.col("shows_at") >= ts("2001-11-01")).select("work_id")
    w = s.works.select("work_id", "title")
    both = w.join(soon, "work_id", "left_semi").withColumn("tier", F.lit(0)).unionAll(w.join(soon, "work_id", "left_anti").withColumn("tier", F.lit(1)))
    return both.orderBy("tier", "work_id").limit(150)


@plan("weekend_listing", f"""
with l as (select *, {london_sql()} as local from showings), w as (select (date '1998-06-01' + (6 - dayofweek(date '1998-06-01'))::int) as sat)
select showing_id, work_id, venue_id, local::date as day, case when hour(local) < 12 then 'morning' when hour(local) < 17 then 'afternoon' when hour(local) < 21 then 'evening' else 'late' end as part from l, w where local::date between sat and sat + 1
""")  # fmt: skip
def weekend_listing(s: Star) -> DataFrame:
    """The coming weekend, in local time."""
    saturday, sunday = calendar.weekend_of(F.lit("1998-06-01").cast("date"))
    local = calendar.london(F.col("shows_at"))
    rows = s.showings.withColumn("local", local).where(F.col("local").cast("date").between(saturday, sunday))
    return rows.select("showing_id", "work_id", "venue_id", F.col("local").cast("date").alias("day"), calendar.time_of_day(F.hour("local")).alias("part"))


@plan("duration_end_times", """
select showing_id, work_id, venue_id, shows_at + to_minutes(coalesce(case when runtime > 200 then null else runtime end, 120)::int) as ends_at, strftime(shows_at, '%H:%M') as label from showings join works using (work_id)
""")  # fmt: skip
def duration_end_times(s: Star) -> DataFrame:
    """End times with the default duration, and time labels."""
    rows = s.showings.join(s.works, "work_id")
    runtime = F.coalesce(F.when(F.col("runtime") <= 200, F.col("runtime")), F.lit(120))
    return rows.select("showing_id", "work_id", "venue_id", F.timestamp_add("MINUTE", runtime, "shows_at").alias("ends_at"), F.date_format("shows_at", "HH:mm").alias("label"))


@plan("calendar_file", r"""
select 'BEGIN:VEVENT' || chr(10) || 'UID:' || showing_id || '-' || venue_id || chr(10) || 'DTSTART:' || strftime(shows_at, '%Y%m%dT%H%M%SZ') || chr(10) || 'DTEND:' || strftime(shows_at + to_minutes(runtime::int), '%Y%m%dT%H%M%SZ')
 || chr(10) || 'SUMMARY:' || replace(replace(title, ',', '\,'), ';', '\;') || chr(10) || 'END:VEVENT' as event from showings join works using (work_id)
""")  # fmt: skip
def calendar_file(s: Star) -> DataFrame:
    """Events of a calendar file, a text per showing."""
    rows = s.showings.join(s.works, "work_id")
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    end = F.timestamp_add("MINUTE", F.col("runtime"), "shows_at")
    summary = F.replace(F.replace("title", F.lit(","), F.lit("\\,")), F.lit(";"), F.lit(r"\;"))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "showing_id", F.lit("-"), "venue_id"), F.concat(F.lit("DTSTART:"), stamp(F.col("shows_at"))), F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), summary), F.lit("END:VEVENT")]
    return rows.select(F.concat_ws("\n", *lines).alias("event"))
