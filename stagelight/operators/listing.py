"""Listing queries: filters, keyset pages, calendars and their counts."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions import calendar


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given; true without any."""
    return functools.reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column | None) -> Column:
    """Disjunction of the conditions that are given; true without any."""
    given = [c for c in conditions if c is not None]
    return functools.reduce(operator.or_, given) if given else F.lit(True)


@dataclass
class Filters:
    """What a calendar asks for; unset fields do not restrict it."""

    search: str | None = None
    venues: list[int] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    hour_from: int | None = None
    hour_to: int | None = None
    formats: list[str] = field(default_factory=list)
    genres: list[str] = field(default_factory=list)
    decades: list[str] = field(default_factory=list)
    times_of_day: list[str] = field(default_factory=list)
    single_only: bool = False


def calendar_strict(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """Showings after now. Hours only restrict if both bounds are given; search reads title, venue and maker."""
    local = calendar.london(F.col("shows_at"))
    hours = F.hour(local).between(f.hour_from, f.hour_to) if f.hour_from is not None and f.hour_to is not None else None
    return rows.where(
        all_of(
            F.col("shows_at") > as_of,
            any_of(*(F.col(c).ilike(f"%{f.search}%") for c in ("title", "name", "maker"))) if f.search else None,
            *_shared(f, local),
            hours,
            F.col("genre").isin([g.lower() for g in f.genres]) if f.genres else None,
            calendar.decade_short(F.col("year")).isin(f.decades) if f.decades else None,
        )
    )


def calendar_open(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """Showings from now on. One hour bound will do; search reads title and maker; times of day and single showings may restrict it."""
    local = calendar.london(F.col("shows_at"))
    hour = F.hour(local)
    out = rows.where(
        all_of(
            F.col("shows_at") >= as_of,
            any_of(*(F.col(c).ilike(f"%{f.search}%") for c in ("title", "maker"))) if f.search else None,
            *_shared(f, local),
            hour >= f.hour_from if f.hour_from is not None else None,
            hour <= f.hour_to if f.hour_to is not None else None,
            F.col("genre").isin([g.lower() for g in f.genres]) if f.genres else None,
            calendar.decade_long(F.col("year")).isin(f.decades) if f.decades else None,
            calendar.time_of_day(hour).isin(f.times_of_day) if f.times_of_day else None,
        )
    )
    if f.single_only:
        alone = F.count("*").over(Window.partitionBy(calendar.london(F.col("shows_at")).cast("date"), "work_id"))
        out = out.withColumn("_n", alone).where("_n = 1").drop("_n")
    return out


def _shared(f: Filters, local: Column) -> list[Column | None]:
    day = local.cast("date")
    return [
        F.col("venue_id").isin(f.venues) if f.venues else None,
        day >= F.lit(f.date_from).cast("date") if f.date_from else None,
        day <= F.lit(f.date_to).cast("date") if f.date_to else None,
        F.col("format").isin(f.formats) if f.formats else None,
    ]


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next page in the order of these columns, one row more than its size: that row tells of a further page.

    Nothing before the cursor is sorted or kept: each task holds a page at most.
    """
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(v) for v in after)))
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(size + 1)


def encode_cursor(at: str, row_id: str) -> str:
    return f"{at}_{row_id}"


def decode_cursor(cursor: str) -> tuple[str, str] | None:
    """The last underscore parts time and id; None if there is none."""
    at, mark, row_id = cursor.rpartition("_")
    return (at, row_id) if mark and at and row_id else None


def programme_kinds(rows: DataFrame, this_year: int) -> DataFrame:
    """kinds: repertory, new_release, special_event or preview, none, one or more."""
    repertory = F.col("year") < this_year - 2
    special = F.col("format") == "imax"
    return rows.withColumn(
        "kinds",
        F.array_compact(F.array(
            F.when(repertory, "repertory"), F.when(~repertory & ~special & (F.col("year").isNull() | (F.col("year") >= this_year - 1)), "new_release"),
            F.when(special, "special_event"), F.when(F.col("year") > this_year, "preview"),
        )),
    )


def nested(rows: DataFrame) -> DataFrame:
    """A listing row as an API returns it: id, time, work{} and venue{}."""
    return rows.select("showing_id", "shows_at", F.struct("work_id", "title", "year").alias("work"), F.struct("venue_id", "name", "chain").alias("venue"))


def by_work_and_day(rows: DataFrame) -> DataFrame:
    """Calendar groups: per local day and work the number of showings and venues, its formats and first time."""
    day = calendar.london(F.col("shows_at")).cast("date")
    return rows.groupBy(day.alias("day"), "work_id", "title").agg(
        F.count("*").alias("showings"), F.countDistinct("venue_id").alias("venues"),
        F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"), F.min("shows_at").alias("earliest"),
    )


def priority(rows: DataFrame) -> list[Column]:
    """Order of a day's works: rated ones first, by rating, popularity and first time."""
    return [F.col("rating").isNull().asc(), F.col("rating").desc_nulls_last(), F.col("popularity").desc_nulls_last(), F.col("earliest").asc_nulls_last()]
