"""Time and date functions of a London calendar, over UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def london(utc: Column) -> Column:
    """Local time of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), utc)


def from_london(local: Column) -> Column:
    """The UTC instant of a local time. The hour that spring skips counts as summer time; the one that autumn repeats as its first pass."""
    summer = F.timestamp_add("HOUR", F.lit(-1), local)
    return F.when((london(summer) == local) | (london(local) != local), summer).otherwise(local)


def weekend_of(day: Column) -> tuple[Column, Column]:
    """Saturday and Sunday of the current weekend on a Sunday, else of the coming one."""
    weekday = F.dayofweek(day)  # 1 is Sunday
    saturday = F.date_add(day.cast("date"), F.when(weekday == 1, -1).otherwise(7 - weekday).cast("int"))
    return saturday, F.date_add(saturday, 1)


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 21, "evening").otherwise("late")


def decade_short(year: Column) -> Column:
    """Two digits for 1970 to 1999, four from 2000 on."""
    decade = F.floor(year / 10) * 10
    return F.when(year < 1970, "Pre-1970").when(year >= 2000, F.concat(decade.cast("string"), F.lit("s"))).otherwise(F.concat((decade % 100).cast("string"), F.lit("s")))


def decade_long(year: Column) -> Column:
    return F.when(year < 1950, "Pre-1950").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def clamp_window(start: Column, end: Column | None, days: int = 14, most: int = 60) -> tuple[Column, Column]:
    """A listing's window: by default to the end of the day `days` on, and never over `most` days."""
    default = F.timestamp_add("SECOND", F.lit(86_399), F.date_trunc("DAY", F.timestamp_add("DAY", F.lit(days), start)))
    return start, F.least(default if end is None else F.coalesce(end, default), F.timestamp_add("DAY", F.lit(most), start))
