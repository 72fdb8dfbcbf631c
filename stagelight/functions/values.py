"""Scalar functions over dates, times, runtimes, places and URLs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lng2 - lng1) * rad / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lat: Column, lng: Column, south: float = 51.3, north: float = 51.7, west: float = -0.5, east: float = 0.2) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the closed ring an odd number of times; never for under three corners."""
    if len(corners) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            crossings += (((y < y1) != (y < y2)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return crossings % 2 == 1


def postcode(text: Column) -> Column:
    """A British postcode in capitals with one blank before its last three characters; null if it is none."""
    bare = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(bare.rlike(r"^[A-Z]{1,2}[0-9][A-Z0-9]?[0-9][A-Z]{2}$"), F.concat(F.substr(bare, F.lit(1), F.length(bare) - 3), F.lit(" "), F.right(bare, F.lit(3))))


def whole_number(text: Column) -> Column:
    """The leading digits of a text."""
    return F.regexp_extract(text, r"^\s*(-?\d{1,9})", 1).try_cast("int")


def runtime(text: Column) -> Column:
    n = whole_number(text)
    return F.when(n.between(1, 600), n)


def guarded_year(year: Column, this_year: int) -> Column:
    return F.when(year.between(1900, this_year + 5), year)


def minutes(seconds: Column) -> Column:
    return F.ceil(seconds / 60)


def clock(text: Column) -> Column:
    """Minutes after midnight of a time in a text; bare times from 1:00 to 9:59 are afternoon."""
    hour, minute, half = (F.regexp_extract(F.lower(text), r"(\d{1,2})[:.](\d{2})\s*(am|pm)?|(\d{1,2})\s*(am|pm)", i) for i in (1, 2, 3))
    hour2, half2 = (F.regexp_extract(F.lower(text), r"(\d{1,2})[:.](\d{2})\s*(am|pm)?|(\d{1,2})\s*(am|pm)", i) for i in (4, 5))
    h = F.coalesce(hour.try_cast("int"), hour2.try_cast("int"))
    ampm = F.when(half != "", half).when(half2 != "", half2)
    bare = F.regexp_extract(text, r"(\d{1,2})[:.]", 1)
    h24 = F.when(ampm == "pm", h % 12 + 12).when(ampm == "am", h % 12).when(h.between(1, 9) & (F.length(bare) == 1), h + 12).otherwise(h)
    value = h24 * 60 + F.coalesce(minute.try_cast("int"), F.lit(0))
    return F.when((h24 < 24) & (F.coalesce(minute.try_cast("int"), F.lit(0)) < 60), value)


def listing_date(text: Column, today: Column) -> Column:
    """A date as listings write it: ISO, day/month/year, or day and month, which rolls to the next year if past."""
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    d, m, y = (F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", i) for i in (1, 2, 3))
    day, month = (F.regexp_extract(F.lower(text), rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({'|'.join(MONTHS)})[a-z]*", i) for i in (1, 2))
    named_year = F.regexp_extract(F.lower(text), rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{'|'.join(MONTHS)})[a-z]*\.?,?\s+(\d{{4}})", 1)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    made = lambda yy: F.try_to_date(F.concat_ws("-", yy, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    this = made(F.year(today).cast("string"))
    rolled = F.when(this < today, made((F.year(today) + 1).cast("string"))).otherwise(this)
    return F.coalesce(
        F.when(iso != "", F.try_to_date(iso)), F.when(d != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))),
        F.when((day != "") & (named_year != ""), made(named_year)), F.when(day != "", rolled),
    )


def http_only(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://[^\s/]+"), url)


def plain_url(url: Column) -> Column:
    """Small scheme and host, without www., fragment, tracking parameters and a trailing slash."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    head, tail = F.lower(F.regexp_extract(text, r"^(https?://[^/?]+)", 1)), F.regexp_replace(text, r"(?i)^https?://[^/?]+", "")
    tail = F.regexp_replace(F.regexp_replace(tail, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1"), r"&+", "&")
    return F.concat(F.regexp_replace(head, r"://www\.", "://"), F.regexp_replace(F.regexp_replace(tail, r"\?&*$", ""), "/$", ""))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def ticket_status(now: Column, starts: Column, ends: Column, on_sale: Column) -> Column:
    return F.when(now > ends, "past").when(now >= starts, "ongoing").when(now >= on_sale, "on_sale").otherwise("upcoming")


def urgency(minutes_left: Column) -> Column:
    return F.when(minutes_left < 0, "missed").when(minutes_left <= 30, "now").when(minutes_left <= 60, "soon").otherwise("later")


def rating_and_year(text: Column) -> tuple[Column, Column]:
    """A rating out of ten, 0 to 10, and the year in brackets behind it; null where the text has none."""
    pattern = r"(\d{1,2}(?:\.\d+)?)\s*/\s*10\s*\(((?:18|19|20)\d\d)\)"
    rating = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(rating <= 10, rating), F.regexp_extract(text, pattern, 2).try_cast("int")
