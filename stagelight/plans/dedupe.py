"""Duplicate reports and repairs over the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.operators import dedupe as D
from stagelight.plans.listing import ts
from stagelight.plans.registry import plan
from stagelight.sources.saved import saved
from stagelight.sources.star import Star

#: Works of a key that meet those of another block at once, and the pairs of a task, about.
BLOCK, PAIRS_A_TASK = 1000, 2_000_000

_ORDER_SQL = "shows_at, work_id, venue_id, price"


def _numbered(s: Star) -> DataFrame:
    """Showings with a number of their own: the key columns repeat."""
    return s.showings.withColumn("row_id", F.struct("showing_id", "work_id", "venue_id", "price"))


_PAIR_SQL = """
with p as (select work_id, venue_id, shows_at, title, name, row(showing_id, price) as id, showing_id, price from showings join works using (work_id) join venues using (venue_id))
select a.work_id, a.venue_id, a.title, a.name, a.showing_id as a_id, a.price as a_price, b.showing_id as b_id, b.price as b_price, abs(date_diff('second', a.shows_at, b.shows_at)) as gap
from p a join p b on a.work_id = b.work_id and a.venue_id = b.venue_id and a.id < b.id and """


def _pairs(s: Star, seconds: int, zero: bool) -> DataFrame:
    """Pairs of showings of one work at one venue, with the names that a report shows; rows are told apart by all that identifies them."""
    rows = s.showings.withColumn("row_id", F.struct("showing_id", "price"))
    found = D.close_pairs(rows, ["work_id", "venue_id"], "shows_at", "row_id", seconds, zero)
    named = found.join(s.works.select("work_id", "title"), "work_id").join(s.venues.select("venue_id", "name"), "venue_id")
    return named.select("work_id", "venue_id", "title", "name", F.col("a.showing_id").alias("a_id"), F.col("a.price").alias("a_price"), F.col("b.showing_id").alias("b_id"), F.col("b.price").alias("b_price"), "gap")


@plan("close_pairs", _PAIR_SQL + "abs(date_diff('second', a.shows_at, b.shows_at)) between 1 and 119")
def close_pairs(s: Star) -> DataFrame:
    """Showings of a work at a venue within two minutes, but not at once: an interval self-join, on buckets of time."""
    return _pairs(s, 120, zero=False)


@plan("same_work_pairs", _PAIR_SQL + "abs(date_diff('second', a.shows_at, b.shows_at)) < 864000")
def same_work_pairs(s: Star) -> DataFrame:
    """As above with zero gaps; within ten days, since the tables are sparser than a listing."""
    return _pairs(s, 864_000, zero=True)


@plan("superseded_rows", """
select showing_id, work_id, venue_id, price from showings o where scraped_at < timestamp '1999-06-01' and shows_at > timestamp '1995-06-01' and exists (select 1 from showings n where n.work_id = o.work_id and n.venue_id = o.venue_id
 and n.scraped_at >= timestamp '1999-06-01' and n.shows_at::date = o.shows_at::date and abs(date_diff('second', n.shows_at, o.shows_at)) <= 10800)
""")  # fmt: skip
def superseded_rows(s: Star) -> DataFrame:
    """EXISTS with a residual, as a semi join."""
    return D.superseded(s.showings, ts("1999-06-01"), ts("1995-06-01")).select("showing_id", "work_id", "venue_id", "price")


@plan("newest_keepers", """
with k as (select distinct on (o.showing_id, o.work_id, o.venue_id, o.price) o.showing_id, o.work_id, o.venue_id, o.price, n.price as keeper from showings o join showings n on n.work_id = o.work_id and n.venue_id = o.venue_id and n.scraped_at >= o.scraped_at + interval 5 minute
 and n.source_id is not null where o.source_id is null order by o.showing_id, o.work_id, o.venue_id, o.price, n.scraped_at desc, n.showing_id desc, n.price)
select * from k
""")  # fmt: skip
def newest_keepers(s: Star) -> DataFrame:
    """For each orphan the newest later row of its work and venue."""
    orphans = s.showings.where("source_id is null").select("showing_id", "work_id", "venue_id", "price", F.col("scraped_at").alias("seen"))
    keepers = s.showings.where("source_id is not null").select("work_id", "venue_id", F.col("scraped_at").alias("later"), F.col("price").alias("keeper"), F.col("showing_id").alias("k_id"))
    met = orphans.join(keepers, ["work_id", "venue_id"]).where(F.col("later") >= F.timestamp_add("MINUTE", F.lit(5), F.col("seen")))
    best = F.max_by("keeper", F.struct("later", "k_id", -F.col("keeper")))
    return met.groupBy("showing_id", "work_id", "venue_id", "price").agg(best.alias("keeper"))


@plan("unlisted_works", "select work_id, title from works w where not exists (select 1 from showings s where s.work_id = w.work_id and shows_at >= timestamp '2001-06-01')")
def unlisted_works(s: Star) -> DataFrame:
    """NOT EXISTS."""
    return s.works.join(s.showings.where(F.col("shows_at") >= ts("2001-06-01")), "work_id", "left_anti").select("work_id", "title")


@plan("duplicate_rows", """
select showing_id, work_id, venue_id, price, copies from (select *, count(*) over (partition by venue_id, source_id) as copies from showings where source_id is not null) where copies > 1
""")  # fmt: skip
def duplicate_rows(s: Star) -> DataFrame:
    """Rows of repeated keys, by a window count."""
    rows = D.ranked(s.showings.where("source_id is not null"), ["venue_id", "source_id"], [F.col("showing_id")])
    return rows.where("copies > 1").select("showing_id", "work_id", "venue_id", "price", "copies")


@plan("dedup_ranks", """
select showing_id, work_id, venue_id, price, row_number() over (partition by venue_id, coalesce(source_id, ''), shows_at::date order by url = '', scraped_at desc nulls last, showing_id desc, work_id, price) as place,
 count(*) over (partition by venue_id, coalesce(source_id, ''), shows_at::date) as copies from showings
""")  # fmt: skip
def dedup_ranks(s: Star) -> DataFrame:
    """Rows with a URL first, then the newest."""
    keys = ["venue_id", F.coalesce("source_id", F.lit("")), F.col("shows_at").cast("date")]
    order = [(F.col("url") == "").asc(), F.col("scraped_at").desc_nulls_last(), F.desc("showing_id"), F.asc("work_id"), F.asc("price")]
    return D.ranked(s.showings, keys, order).select("showing_id", "work_id", "venue_id", "price", "place", "copies")


@plan("normalised_title_pairs", """
select a.work_id as a, b.work_id as b, a.year as year from works a join works b on regexp_replace(lower(a.title), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.title), '[^a-z0-9]', '', 'g') and a.year = b.year and a.work_id < b.work_id
""")  # fmt: skip
def normalised_title_pairs(s: Star) -> DataFrame:
    """An equi self-join on a derived key and the year.

    The pairs grow with the square of the works that share a key. So a key's works are cut into blocks, and each two blocks meet on their own: as many tasks
    as the pairs need have about as many each.
    """
    w = s.works.select("work_id", "year", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("key"))
    n = F.col("count").cast("double")
    pairs = w.groupBy("key", "year").count().agg(F.coalesce(F.sum(n * (n + 1) / 2), F.lit(0.0))).first()[0]
    tasks = int(pairs // PAIRS_A_TASK) + 1
    by = Window.partitionBy("key", "year")
    w = w.withColumn("at", F.floor((F.row_number().over(by.orderBy("work_id")) - 1) / BLOCK)).withColumn("last", F.floor((F.count("*").over(by) - 1) / BLOCK))
    a = w.select("key", "year", F.col("work_id").alias("a"), F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"))
    b = w.select("key", "year", F.col("work_id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"))
    met = ["key", "year", "i", "j"]
    return a.repartition(tasks, *met).hint("merge").join(b.repartition(tasks, *met), met).where("a < b").select("a", "b", "year")


@plan("cross_venue_pairs", """
with alias(x, y) as (values (1, 2), (3, 4), (5, 9), (7, 8)) select a.venue_id as x, b.venue_id as y, a.work_id, a.price as x_price, b.price as y_price from showings a join showings b on a.work_id = b.work_id and a.shows_at::date = b.shows_at::date join alias on a.venue_id = x and b.venue_id = y
""")  # fmt: skip
def cross_venue_pairs(s: Star) -> DataFrame:
    """The same work and day at two aliases of a venue; rows are cut to the aliases before they meet."""
    alias = s.spark.createDataFrame([(1, 2), (3, 4), (5, 9), (7, 8)], "x long, y long")
    rows = s.showings.select("work_id", "venue_id", "price", F.col("shows_at").cast("date").alias("day"))
    left = rows.withColumnsRenamed({"venue_id": "x", "price": "x_price"}).join(alias, "x")
    right = rows.withColumnsRenamed({"venue_id": "y", "price": "y_price"})
    return left.join(right, ["work_id", "day", "y"]).select("x", "y", "work_id", "x_price", "y_price")


@plan("cluster_primaries", """
with k as (select *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || year as key from works), c as (select work_id, count(*) as n from showings group by 1),
r as (select k.work_id, key, row_number() over (partition by key order by coalesce(n, 0) desc, popularity desc, k.work_id) as place from k left join c using (work_id))
select r.work_id, p.work_id as primary_id from r join (select key, work_id from r where place = 1) p using (key) where r.place > 1
""")  # fmt: skip
def cluster_primaries(s: Star) -> DataFrame:
    """The best row of each cluster by a score, and what merges into it."""
    return _moves(s)


def _moves(s: Star) -> DataFrame:
    c = s.showings.groupBy("work_id").agg(F.count("*").alias("n"))
    k = s.works.select("work_id", "popularity", F.concat(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), F.col("year")).alias("key")).join(c, "work_id", "left")
    best = F.max_by("work_id", F.struct(F.coalesce("n", F.lit(0)), "popularity", -F.col("work_id")))
    primary = k.groupBy("key").agg(best.alias("primary_id"))
    return k.join(primary, "key").where("work_id <> primary_id").select("work_id", "primary_id")


@plan("merged_children", """
with k as (select *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || year as key from works), c as (select work_id, count(*) as n from showings group by 1),
r as (select k.work_id, key, row_number() over (partition by key order by coalesce(n, 0) desc, popularity desc, k.work_id) as place from k left join c using (work_id)),
m as (select r.work_id as old, p.work_id as new from r join (select key, work_id from r where place = 1) p using (key) where r.place > 1),
x as (select user_id, coalesce(new, work_id) as work_id, status, new is null as own, updated_at, mark_id from marks left join m on work_id = old),
y as (select *, row_number() over (partition by user_id, work_id order by own desc, updated_at desc, mark_id) as place from x)
select user_id, work_id, status, mark_id from y where place = 1
""")  # fmt: skip
def merged_children(s: Star) -> DataFrame:
    """Children move to the primaries without colliding on (user, work)."""
    moves = _moves(s).withColumnsRenamed({"work_id": "old", "primary_id": "new"})
    stay, _ = D.moved_keys(s.marks, moves, "work_id", ["user_id", "work_id"], [F.desc("updated_at"), F.asc("mark_id")])
    return stay.select("user_id", "work_id", "status", "mark_id")


@plan("shared_audience_components", """
with recursive e as (select distinct a.work_id as a, b.work_id as b from marks a join marks b on a.user_id = b.user_id and a.status = 'seen' and b.status = 'seen' and a.work_id <> b.work_id and a.updated_at::date = b.updated_at::date),
t(node, root) as (select distinct a, a from e union select e.b, t.root from t join e on e.a = t.node) select node, min(root) as root from t group by 1
""")  # fmt: skip
def shared_audience_components(s: Star) -> DataFrame:
    """Connected components of works that a user saw on one day."""
    seen = s.marks.where("status = 'seen'").select("user_id", "work_id", F.col("updated_at").cast("date").alias("day"))
    # A user's day links each work with its first: the same components as all pairs.
    first = seen.groupBy("user_id", "day").agg(F.min("work_id").alias("a"))
    links = seen.join(first, ["user_id", "day"]).where("work_id <> a").select("a", F.col("work_id").alias("b"))
    return D.min_labels(links, saved)


@plan("venue_name_duplicates", """
with k as (select venue_id, coalesce(try_cast(regexp_replace(lower(name), '(^supplier#0+|[^0-9])', '', 'g') as int), 0) % 40 as key from venues), c as (select venue_id, count(*) as n from showings group by 1),
r as (select k.*, row_number() over (partition by key order by coalesce(n, 0) desc, length(venue_id::varchar), venue_id) as place, count(*) over (partition by key) as copies from k left join c using (venue_id))
select venue_id, key, place = 1 as keep from r where copies > 1
""")  # fmt: skip
def venue_name_duplicates(s: Star) -> DataFrame:
    """Of venues alike in name the one with most showings stays, then that with the shortest id."""
    key = F.regexp_replace(F.lower("name"), "(^supplier#0+|[^0-9])", "").try_cast("int") % 40
    c = s.showings.groupBy("venue_id").agg(F.count("*").alias("n"))
    k = s.venues.select("venue_id", F.coalesce(key, F.lit(0)).alias("key")).join(c, "venue_id", "left")
    r = D.ranked(k, ["key"], [F.coalesce("n", F.lit(0)).desc(), F.length(F.col("venue_id").cast("string")), F.asc("venue_id")])
    return r.where("copies > 1").select("venue_id", "key", (F.col("place") == 1).alias("keep"))


@plan("renames_without_collision", """
select work_id, title || '!' as new_title from works w where year > 2020 and not exists (select 1 from works o where o.work_id <> w.work_id and lower(o.title) = lower(w.title) and o.year = w.year)
""")  # fmt: skip
def renames_without_collision(s: Star) -> DataFrame:
    """Rows that may take a name, as no other row has it: a count of rows a name, not a self-join."""
    n = s.works.groupBy(F.lower("title").alias("low"), "year").agg(F.count("*").alias("n"))
    w = s.works.where("year > 2020").withColumn("low", F.lower("title"))
    return w.join(n.where("n = 1"), ["low", "year"], "left_semi").select("work_id", F.concat("title", F.lit("!")).alias("new_title"))
