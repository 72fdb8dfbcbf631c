"""Scalar functions applied to whole tables."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.functions import calendar, titles, values
from stagelight.functions import extraction as X
from stagelight.plans.listing import london_sql, ts
from stagelight.plans.registry import plan
from stagelight.sources.star import Star

#: A noisy title made from a work's columns, in Spark and in SQL.
_NOISE_SQL = "case work_id % 6 when 0 then 'Preview: ' || title when 1 then title || ' (' || year || ')' when 2 then upper(title) || ' MOVIE' when 3 then 'The ' || title || ' (35mm)' when 4 then title || ': Part ' || (work_id % 9) else 'Quiz &amp; ' || title end"


def _noisy(s: Star) -> DataFrame:
    k = F.col("work_id") % 6
    noisy = (
        F.when(k == 0, F.concat(F.lit("Preview: "), "title")).when(k == 1, F.concat("title", F.lit(" ("), "year", F.lit(")"))).when(k == 2, F.concat(F.upper("title"), F.lit(" MOVIE")))
        .when(k == 3, F.concat(F.lit("The "), "title", F.lit(" (35mm)"))).when(k == 4, F.concat("title", F.lit(": Part "), F.col("work_id") % 9)).otherwise(F.concat(F.lit("Quiz &amp; "), "title"))
    )
    return s.works.withColumn("noisy", noisy)


@plan("clean_titles", f"""
with n as (select work_id, title, year, {_NOISE_SQL} as noisy from works)
select work_id, noisy, case work_id % 6 when 0 then title when 1 then title when 2 then noisy when 3 then 'The ' || title when 4 then noisy else 'Quiz & ' || title end as cleaned,
 case work_id % 6 when 0 then title when 1 then title when 2 then lower(noisy) when 3 then title when 4 then replace(noisy, ':', '') else 'quiz ' || title end as normalised_raw, case when work_id % 6 = 1 then year end as year_in, case when work_id % 6 = 0 then 'preview' end as prefix from n
""".replace("replace(noisy, ':', '') else", "lower(replace(noisy, ':', '')) else"))  # fmt: skip
def clean_titles(s: Star) -> DataFrame:
    """Cleaning and normalising of noisy titles."""
    t = F.col("noisy")
    return _noisy(s).select("work_id", "noisy", titles.cleaned(t).alias("cleaned"), titles.normalised(t).alias("normalised_raw"), titles.year_in(t).alias("year_in"), titles.prefix_of(t).alias("prefix"))


@plan("title_rules", f"""
with n as (select work_id, {_NOISE_SQL} as t from works)
select work_id, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) as ascii, trim(regexp_replace(regexp_replace(lower(t), '\\([^)]*\\)', '', 'g'), ':.*$', '')) as before_colon,
 lower(trim(case when contains(t, ': ') then regexp_extract(t, ':\\s*(.+)$', 1) else t end)) as after_colon, trim(regexp_replace(lower(t), '^(the|an|a)\\s+', '')) as no_article, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') as letters,
 regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from n
""")  # fmt: skip
def title_rules(s: Star) -> DataFrame:
    """The other normalisers, kept apart since their results differ."""
    t = F.col("noisy")
    return _noisy(s).select(
        "work_id", titles.normalised_ascii(t).alias("ascii"), titles.normalised_before_colon(t).alias("before_colon"), titles.normalised_after_colon(t).alias("after_colon"),
        titles.normalised_without_articles(t).alias("no_article"), titles.letters_only(t).alias("letters"), titles.slug(t).alias("slug"),
    )


_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NO_THE = r"regexp_replace({}, '^the\s+', '')"
_RULES = {
    "seasons": _SQUEEZED.format(r"regexp_replace(" + _NO_THE.format("lower(t)") + r", '[^a-z0-9_\s]', '', 'g')"),
    "checks": _SQUEEZED.format(r"regexp_replace(regexp_replace(regexp_replace(" + _NO_THE.format("lower(t)") + r", '\s*\([^)]*\)\s*$', ''), '\s*:.*$', ''), '[^a-z0-9_\s''-]', '', 'g')"),
    "blocklist": r"trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '^(film club|lost reels|classic matinee):\s*', ''), '\s*\+\s*(q&a|intro)\s*$', ''), '\s*\([^)]*\)\s*$', ''))",
    "two_stages": r"replace(" + _SQUEEZED.format(_NO_THE.format(r"regexp_replace(regexp_replace(regexp_replace(lower(t), '^(preview|opening night|\d+(st|nd|rd|th) anniversary( screening)?):\s*', ''), '\s*\+\s*(q&a|intro).*$', ''), '\s*\([^)]*\)\s*$', '')")) + ", '&', 'and')",
    "gently": _SQUEEZED.format(r"regexp_replace(" + _NO_THE.format("lower(t)") + r", '[^\p{L}\p{N}\s]', '', 'g')"),
    "exactly": _SQUEEZED.format(r"regexp_replace(lower(t), '[^\p{L}\p{N}\s]', ' ', 'g')"),
    "marks": "nullif(lower(t), '')",
}
#: Titles with what these rules leave out, in Spark and in SQL.
_SHAPES = ["Film Club: {} + Q&A", "The {} (4K Restoration)", "Opening Night: {} + intro by the director", "30th anniversary screening: {}", "{}: Part 2 - the \"end\"", "Lost Reels: The {}", "{}'s night & day", "{}"]
_SHAPES_SQL = "case work_id % 8 " + " ".join("when {} then '{}' || title || '{}'".format(i, *(x.replace("'", "''") for x in o.split("{}"))) for i, o in enumerate(_SHAPES)) + " end"


@plan("more_title_rules", f"with n as (select work_id, {_SHAPES_SQL} as t from works) select work_id, replace(" + _RULES["blocklist"] + ", '\"', '') as blocklist, " + ", ".join(f"{v} as {k}" for k, v in _RULES.items() if k != "blocklist") + " from n")
def more_title_rules(s: Star) -> DataFrame:
    """The rules of seasons, checks, the blocklist, the programme, the gap filler, exact matches and the client index, each its own."""
    shapes = F.array(*(F.concat(F.lit(a), F.col("title"), F.lit(b)) for a, b in (o.split("{}") for o in _SHAPES)))
    t = F.col("t")
    return s.works.select("work_id", F.element_at(shapes, (F.col("work_id") % 8 + 1).cast("int")).alias("t")).select(
        "work_id", titles.normalised_for_seasons(t).alias("seasons"), titles.normalised_for_checks(t).alias("checks"), titles.normalised_for_blocklist(t).alias("blocklist"), titles.normalised_in_two_stages(t).alias("two_stages"),
        titles.normalised_gently(t).alias("gently"), titles.normalised_exactly(t).alias("exactly"), titles.without_marks(t).alias("marks"),
    )


@plan("title_classes", f"""
with n as (select work_id, {_NOISE_SQL} as t from works)
select work_id, case when contains(lower(t), 'quiz') then 'event' else 'film' end as class, array_to_string(list_filter([case when contains(lower(t), 'quiz') then 'quiz' end, case when contains(lower(t), 'preview') then 'preview' end], lambda x: x is not null), ',') as events,
 case when contains(lower(t), '35mm') then '35mm' else '' end as formats, case when contains(lower(t), 'quiz') then 'keyword' end as not_film, starts_with(t, 'Preview: ') as has_prefix, contains(t, '(35mm)') as has_suffix from n
""")  # fmt: skip
def title_classes(s: Star) -> DataFrame:
    """Events, formats, classes and flags from titles."""
    t, f = F.col("noisy"), titles.flags(F.col("noisy"))
    return _noisy(s).select("work_id", titles.content_class(t).alias("class"), F.array_join(titles.events(t), ",").alias("events"), F.array_join(titles.formats(t), ",").alias("formats"), titles.not_a_film(t).alias("not_film"), f["has_prefix"].alias("has_prefix"), f["has_suffix"].alias("has_suffix"))


#: Titles as programmes give them, with what else a showing offers; in Spark and in SQL.
_OFFERS = ["{} in 3D", "Relaxed screening: {}", "{} with French subtitles", "{} (audio described)", "The Long Season: {}", "{} with English ST, subtitled", "Northern Film Festival : {} 3-D", "{}"]
_OFFERS_SQL = "case work_id % 8 " + " ".join(f"when {i} then '{a}' || title || '{b}'" for i, (a, b) in enumerate(o.split("{}") for o in _OFFERS)) + " end"
_ACCESS_SQL = {"3d": r"\b(in\s+)?3d\b|\b3-d\b", "relaxed": r"\brelaxed\s+(screening|film|cinema|performance)\b", "subtitles": r"\bsubtitles?\b|\bsubtitled\b|\bsubt\b|\bcc\b", "audio_description": r"\baudio[\s-]+described?\b"}


@plan("event_extras", f"""
with n as (select work_id, {_OFFERS_SQL} as t from works)
select work_id, array_to_string(list_filter([{", ".join(f"case when regexp_matches(lower(t), '{p}') then '{k}' end" for k, p in _ACCESS_SQL.items())}], lambda x: x is not null), ',') as access,
 case when regexp_matches(lower(t), '\\bfrench\\s+subtitles\\b') then 'fr' when regexp_matches(lower(t), '\\benglish\\s+(subtitles|st)\\b') then 'en' end as subtitles,
 nullif(regexp_extract(t, '(?i)^([A-Z][^:]{{4,80}}?\\s+(?:Season|Retrospective|Series|Festival|Programme|Strand|presents?))\\s*:', 1), '') as season from n
""")  # fmt: skip
def event_extras(s: Star) -> DataFrame:
    """X11: what a showing offers besides the film, the language of its subtitles, and the season it is part of."""
    shapes = F.array(*(F.concat(F.lit(a), F.col("title"), F.lit(b)) for a, b in (o.split("{}") for o in _OFFERS)))
    t = F.element_at(shapes, (F.col("work_id") % 8 + 1).cast("int"))
    rows = s.works.select("work_id", t.alias("t"))
    return rows.select("work_id", F.array_join(titles.access(F.col("t")), ",").alias("access"), titles.subtitle_language(F.col("t")).alias("subtitles"), titles.season_in(F.col("t")).alias("season"))


@plan("checked_ratings", """
with n as (select work_id, year, floor(popularity * 10)::int % 101 as tenths, year + work_id % 5 - 2 as told from works)
select work_id, case when work_id % 7 <> 0 and abs(told - year) <= 1 and tenths <= 100 then tenths / 10.0::double end as rating, work_id % 7 <> 0 and abs(told - year) > 1 as other_year from n
""")  # fmt: skip
def checked_ratings(s: Star) -> DataFrame:
    """A rating read from a page's text, taken only if the year told with it is the work's own or one beside it."""
    tenths = F.floor(F.col("popularity") * 10).cast("int") % 101
    told = F.when(F.col("work_id") % 7 == 0, F.lit("no rating yet")).otherwise(F.concat(F.lit("Rated "), F.format_number(tenths / 10, 1), F.lit(" / 10 ("), (F.col("year") + F.col("work_id") % 5 - 2).cast("string"), F.lit(")")))
    rating, year = values.rating_and_year(told)
    near = F.abs(year - F.col("year")) <= 1
    return s.works.select("work_id", F.when(near, rating).alias("rating"), F.coalesce(~near, F.lit(False)).alias("other_year"))


_CLEAN_SQL = "case work_id % 6 when 0 then title when 1 then title when 3 then 'The ' || title when 5 then 'Quiz & ' || title else t end"


@plan("title_variants", rf"""
with n as (select work_id, title, {_NOISE_SQL} as t from works), c as (select work_id, t, {_CLEAN_SQL} as c from n),
b as (select *, regexp_replace(c, '(?i)^(the|an|a)\s+', '') as bare, regexp_replace(t, '\([^)]*\)\s*$', '') as outer_, regexp_extract(t, '\(([A-Za-z0-9 ,.''!?&:-]+)\)\s*$', 1) as inner_ from c),
l as (select *, [trim(t), c, trim(regexp_replace(c, ':.*$', '')), trim(regexp_extract(c, ':\s*(.+)$', 1)), bare, 'The ' || bare] as vs from b)
select work_id, list_filter(vs, lambda v, i: v <> '' and list_position(vs, v) = i) as variants,
 case when length(t) >= 10 and contains(t, ' ') and length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 4 and upper(t) = t then array_to_string(list_transform(string_split(t, ' '), lambda w: case when regexp_matches(w, '[0-9.]') then w else upper(w[1]) || lower(w[2:]) end), ' ') else t end as cased,
 case when inner_ <> '' and regexp_matches(outer_, '[^\x00-\x7F]') then trim(inner_) end as english from l
""")  # fmt: skip
def title_variants(s: Star) -> DataFrame:
    """Ordered search variants, smart case and bracketed titles."""
    t = F.col("noisy")
    return _noisy(s).select("work_id", titles.variants(t).alias("variants"), titles.smart_case(t).alias("cased"), titles.bracketed_english(t).alias("english"))


#: Titles with references in them, in Spark and in SQL; the SQL has what they stand for.
_BYTES = ["iexcl", "cent", "pound", "sect", "copy", "laquo", "deg", "plusmn", "micro", "middot", "raquo", "iquest"]
_DECODED_SQL = "case work_id % 7 when 0 then title || chr((256 + work_id * 31 % 20000)::int) when 1 then chr((127744 + work_id % 400)::int) || title when 2 then title || ' & ' || maker when 3 then title || chr(192 + ascii([{}][1 + work_id % 12]) - 128) when 4 then title || '&Ouml;&Atilde;' when 5 then title || '&' else title || ' ½&nosuch; <' end".format(
    ", ".join(f"'{chr(name2codepoint[n])}'" for n in _BYTES)
)


@plan("decoded_titles", f"select work_id, {_DECODED_SQL} as decoded from works")
def decoded_titles(s: Star) -> DataFrame:
    """References in titles: numbers of both kinds, names, runs of names that spell UTF-8, and what stands for nothing."""
    k, t = F.col("work_id"), F.col("title")
    byte = F.element_at(F.array(*map(F.lit, _BYTES)), (k % 12 + 1).cast("int"))
    shapes = [
        F.concat(t, F.lit("&#"), (k * 31 % 20000 + 256).cast("string"), F.lit(";")), F.concat(F.lit("&#x"), F.lower(F.hex(k % 400 + 127744)), F.lit(";"), t), F.concat(t, F.lit(" &amp; "), "maker"),
        F.concat(t, F.lit("&Atilde;&"), byte, F.lit(";")), F.concat(t, F.lit("&Ouml;&Atilde;")), F.concat(t, F.lit("&#38;")), F.concat(t, F.lit(" &frac12;&nosuch; &lt;")),
    ]
    return s.works.select("work_id", titles.decoded(F.element_at(F.array(*shapes), (k % 7 + 1).cast("int"))).alias("decoded"))


#: Titles inside those of events, in Spark and in SQL.
_EVENTS = [
    "NT Live: {}", "LFF: {} (35mm)", "{} + Q&amp;A with the crew", 'Reel Society presents "{}"', "Sing-A-Long-A {}", "{} + Second Film", "{} (4K Restoration) (Preview) [subtitled]", "The Big Quiz: {}",
    "Classic Matinee: {} - 30th Anniversary screening", "  '{}'  ", "35mm: {} - 70mm", "{}",
]
_EVENTS_SQL = "case work_id % 12 " + " ".join("when {} then '{}' || title || '{}'".format(i, *(x.replace("'", "''") for x in o.split("{}"))) for i, o in enumerate(_EVENTS)) + " end"


def _extraction_sql() -> str:
    """The steps one by one, each a common table: text t, methods m, confidence f, compilation c, broadcast b."""
    quoted = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    steps = ["s0 as (select work_id, o, replace(trim(o), '&amp;', '&') as t, []::varchar[] as m, 1.0::double as f, false as c, false as b from n)"]

    def step(cond: str, **new: str) -> None:
        cols = ", ".join(f"case when {cond} then {new[k]} else {k} end as {k}" if k in new else k for k in "tmfcb")
        steps.append(f"s{len(steps)} as (select work_id, o, {cols} from s{len(steps) - 1})")

    for pattern, method in ((X.PRESENTED, "presents_pattern"), (X.SUNG, "singalong_pattern")):
        step(f"regexp_matches(t, {quoted(pattern)})", t=f"regexp_extract(t, {quoted(pattern)}, 1)", m=f"['{method}']", f=str(X.SURE[method]))
    name, festivals = f"regexp_extract(t, {quoted(X.PREFIX)}, 1)", ", ".join(f"'{x}'" for x in X.FESTIVALS)
    step(f"{name} <> ''", t=f"regexp_replace(t, {quoted(X.PREFIX)}, '')", m="list_append(m, 'prefix_removal')", f=f"case when upper({name}) in ({festivals}) then 0.3 else least(f, 0.9) end", c=f"upper({name}) in ({festivals})", b=f"regexp_matches(lower({name}), '{'|'.join(X.BROADCAST_WORDS)}')")
    for e in X.ENDINGS:
        step(f"regexp_matches(t, {quoted(e)})", t=f"trim(regexp_replace(t, {quoted(e)}, ''))", m="list_append(m, 'suffix_removal')", f="least(f, 0.85)")
    step("contains(t, ' + ') and not list_contains(m, 'suffix_removal')", t=f"trim(regexp_extract(t, {quoted(X.FIRST_OF_TWO)}, 1))", m="list_append(m, 'double_feature')", f="least(f, 0.7)")
    no_film = f"regexp_matches(o, {quoted('|'.join(X.NO_FILMS))})"
    return f"""
with n as (select work_id, {_EVENTS_SQL} as o from works), {", ".join(steps)},
e as (select *, {no_film} as x, trim(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^["''“”]+|["''“”]+$', '', 'g')) as u from s{len(steps) - 1})
select work_id, case when x then trim(o) else u end as extracted, case when x then 'non_film_detected' when u = o or len(m) = 0 then 'none' else array_to_string(m, '+') end as method, case when x then 0.0::double when u = o then 1.0::double else f end as confidence,
 not x and u <> o and c as compilation, not x and u <> o and b as broadcast, x as non_film from e
"""


@plan("extracted_titles", _extraction_sql())
def extracted_titles(s: Star) -> DataFrame:
    """The film's title inside an event's, by which patterns it was found, and how sure that is."""
    shapes = F.array(*(F.concat(F.lit(a), F.col("title"), F.lit(b)) for a, b in (o.split("{}") for o in _EVENTS)))
    rows = s.works.select("work_id", F.element_at(shapes, (F.col("work_id") % 12 + 1).cast("int")).alias("t"))
    return rows.select("work_id", X.extracted(F.col("t")).alias("e")).select("work_id", "e.*")


@plan("known_kinds", """
with e as (select lower(trim(title)) as key, case work_id // 50 % 4 when 0 then 'concert' when 1 then 'live_broadcast' else 'event' end as kind, row_number() over (partition by lower(trim(title)) order by work_id) as r from works where work_id % 50 = 0 and title <> '')
select work_id, title, coalesce(kind, case when regexp_matches(title, '(?i)^royal') then 'live_broadcast' when regexp_matches(title, '(?i)ring\\b') then 'event' end) as known from works left join e on lower(trim(title)) = key and r = 1
""")
def known_kinds(s: Star) -> DataFrame:
    """Entries that a list knows to be no films, by title and then by pattern; the list is every fiftieth work."""
    kinds = F.element_at(F.array(F.lit("concert"), F.lit("live_broadcast"), F.lit("talk"), F.lit(None)), (F.floor(F.col("work_id") / 50) % 4 + 1).cast("int"))
    entries = s.works.where(F.col("work_id") % 50 == 0).select(F.col("work_id").alias("place"), "title", kinds.alias("kind"))
    return X.known_kinds(s.works.select("work_id", "title"), entries, [("^royal", "live_broadcast"), (r"ring\b", None)])


@plan("stripped_pages", """
select page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) as chars, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<p>')) as paragraphs from pages
""")  # fmt: skip
def stripped_pages(s: Star) -> DataFrame:
    """Text and fields of scraped pages."""
    return s.table("pages").select("page_id", F.length(titles.without_markup(F.col("html"))).alias("chars"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@plan("page_urls", r"""
with p as (select page_id, regexp_replace(url, '#.*$', '') as u from pages), q as (select page_id, lower(regexp_extract(u, '^(https?://[^/?]+)', 1)) as head, regexp_replace(u, '^https?://[^/?]+', '') as tail from p),
r as (select page_id, head, regexp_replace(regexp_replace(tail, '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g') as tail from q)
select page_id, regexp_replace(head, '://www\.', '://') || regexp_replace(regexp_replace(tail, '\?&*$', ''), '/$', '') as plain from r
""")  # fmt: skip
def page_urls(s: Star) -> DataFrame:
    """URLs in one form."""
    return s.table("pages").select("page_id", values.plain_url(F.col("url")).alias("plain"))


@plan("venue_distances", """
select venue_id, round(2 * 3958.8 * asin(least(1.0, sqrt(power(sin((51.5 - lat) * pi() / 360), 2) + cos(lat * pi() / 180) * cos(51.5 * pi() / 180) * power(sin((-0.12 - lng) * pi() / 360), 2)))), 4) as miles,
 lat between 51.3::double and 51.7::double and lng between -0.5::double and 0.2::double as in_box, ((lat < 51.35::double) <> (lat < 51.6::double)) and ((lng < 0.1::double) <> (lng < -0.5::double)) as in_ring from venues
""")  # fmt: skip
def venue_distances(s: Star) -> DataFrame:
    """Distance, box and polygon."""
    ring = [(-0.5, 51.35), (0.1, 51.35), (0.1, 51.6), (-0.5, 51.6)]
    miles = values.haversine_miles(F.col("lat"), F.col("lng"), F.lit(51.5), F.lit(-0.12))
    return s.venues.select("venue_id", F.round(miles, 4).alias("miles"), values.in_box(F.col("lat"), F.col("lng")).alias("in_box"), values.in_polygon(F.col("lng"), F.col("lat"), ring).alias("in_ring"))


@plan("reachable", """
with t as (select venue_id, ceil((venue_id * 97 % 5400) / 60.0)::bigint as minutes, case when venue_id % 3 = 0 then 'walking' else 'transit' end as mode from venues where venue_id % 7 <> 0),
r as (select showing_id, work_id, venue_id, price, minutes, mode, date_diff('minute', timestamp '1998-06-01 12:00:00', shows_at) - minutes as left_ from showings join t using (venue_id) where shows_at between timestamp '1998-06-01 12:00:00' and timestamp '1998-06-01 23:59:59')
select showing_id, work_id, venue_id, price, minutes, mode, case when left_ < 0 then 'missed' when left_ <= 30 then 'now' when left_ <= 60 then 'soon' else 'later' end as urgency from r
""")  # fmt: skip
def reachable(s: Star) -> DataFrame:
    """Travel times joined to showings; venues without one drop out."""
    minutes = values.minutes(F.col("venue_id") * 97 % 5400)
    t = s.venues.where("venue_id % 7 <> 0").select("venue_id", minutes.alias("minutes"), F.when(F.col("venue_id") % 3 == 0, "walking").otherwise("transit").alias("mode"))
    now = ts("1998-06-01 12:00:00")
    r = s.showings.where(F.col("shows_at").between(now, ts("1998-06-01 23:59:59"))).join(t, "venue_id")
    left = F.timestamp_diff("MINUTE", now, F.col("shows_at")) - F.col("minutes")
    return r.select("showing_id", "work_id", "venue_id", "price", "minutes", "mode", values.urgency(left).alias("urgency"))


@plan("decades_and_guards", """
select year, case when year < 1970 then 'Pre-1970' when year >= 2000 then (year // 10 * 10) || 's' else (year // 10 * 10 % 100) || 's' end as short, case when year < 1950 then 'Pre-1950' else (year // 10 * 10) || 's' end as long,
 case when year between 1900 and 2019 then year end as guarded, year < 2012 as repertory, count(*) as n from works group by all
""")  # fmt: skip
def decades_and_guards(s: Star) -> DataFrame:
    """P15, P16, X15, X17, X26."""
    y = F.col("year")
    return s.works.groupBy("year", calendar.decade_short(y).alias("short"), calendar.decade_long(y).alias("long"), values.guarded_year(y, 2014).alias("guarded"), (y < 2012).alias("repertory")).agg(F.count("*").alias("n"))


@plan("local_hours", f"""
with l as (select {london_sql()} as local, shows_at from showings) select hour(local) as hour, dayofweek(local) in (0, 6) as weekend, count(*) as n, count(*) filter (where local <> shows_at) as summer from l group by 1, 2
""")  # fmt: skip
def local_hours(s: Star) -> DataFrame:
    """X20, X21, X22."""
    l = s.showings.withColumn("local", calendar.london(F.col("shows_at")))  # noqa: E741
    return l.groupBy(F.hour("local").alias("hour"), F.dayofweek("local").isin(1, 7).alias("weekend")).agg(F.count("*").alias("n"), F.count_if(F.col("local") != F.col("shows_at")).alias("summer"))


@plan("composite_keys", """
select venue_id || '-' || replace(title, ' ', '-') || '-' || strftime(date_trunc('minute', shows_at), '%Y-%m-%dT%H:%M') || '-' || format as key, lower(title) || '|' || strftime(shows_at, '%Y-%m-%dT%H:%M:%S') as second_key, to_json({'id': showing_id, 'title': title})::varchar as body from showings join works using (work_id)
""")  # fmt: skip
def composite_keys(s: Star) -> DataFrame:
    """Composite keys and JSON bodies."""
    rows = s.showings.join(s.works, "work_id")
    minute = F.date_format(F.date_trunc("MINUTE", "shows_at"), "yyyy-MM-dd'T'HH:mm")
    return rows.select(
        F.concat_ws("-", "venue_id", F.replace("title", F.lit(" "), F.lit("-")), minute, "format").alias("key"), F.concat(F.lower("title"), F.lit("|"), F.date_format("shows_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("second_key"),
        F.to_json(F.struct(F.col("showing_id").alias("id"), "title")).alias("body"),
    )


@plan("festival_states", """
with f as (select chain, quarter(shows_at)::int as season, year(shows_at)::int as year, min(shows_at) as starts, max(shows_at) as ends, min(scraped_at) as on_sale from showings join venues using (venue_id) group by 1, 2, 3)
select chain, year, season, case when timestamp '1998-06-01' > ends then 'past' when timestamp '1998-06-01' >= starts then 'ongoing' when timestamp '1998-06-01' >= on_sale then 'on_sale' else 'upcoming' end as state from f
""")  # fmt: skip
def festival_states(s: Star) -> DataFrame:
    """A chain's showings of a quarter as a festival, with its state as of a day: past, ongoing, on sale since it was first listed, or upcoming."""
    f = s.showings.join(s.venues, "venue_id").groupBy("chain", F.year("shows_at").alias("year"), F.quarter("shows_at").alias("season"))
    f = f.agg(F.min("shows_at").alias("starts"), F.max("shows_at").alias("ends"), F.min("scraped_at").alias("on_sale"))
    return f.select("chain", "year", "season", values.ticket_status(ts("1998-06-01"), F.col("starts"), F.col("ends"), F.col("on_sale")).alias("state"))
