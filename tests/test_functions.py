from __future__ import annotations

import datetime as dt
import random
import re
from html.entities import name2codepoint

import pytest
from pyspark.sql import functions as F

from stagelight.functions import calendar, extraction, titles, values
from stagelight.operators import dedupe, health, ingest, requests, search
from stagelight.operators import listing as L
from stagelight.sources.saved import saved


def one(spark, column, **lits):
    """The value of a column over literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in lits.items()), F.lit(1).alias("_")).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("utc", "local"), [("2025-03-30 00:59:00", "2025-03-30 00:59:00"), ("2025-03-30 01:00:00", "2025-03-30 02:00:00"), ("2025-10-26 00:59:00", "2025-10-26 01:59:00"), ("2025-10-26 01:00:00", "2025-10-26 01:00:00"), ("2025-07-01 12:00:00", "2025-07-01 13:00:00")])
def test_london(spark, utc, local):
    assert str(one(spark, calendar.london(ts(utc)))) == local


@pytest.mark.parametrize(("local", "utc"), [("2025-03-30 01:30:00", "2025-03-30 00:30:00"), ("2025-10-26 01:30:00", "2025-10-26 00:30:00"), ("2025-01-06 19:30:00", "2025-01-06 19:30:00"), ("2025-06-06 19:30:00", "2025-06-06 18:30:00")])
def test_from_london_counts_the_skipped_hour_as_summer(spark, local, utc):
    assert str(one(spark, calendar.from_london(ts(local)))) == utc


@pytest.mark.parametrize(("day", "saturday"), [("2025-01-06", "2025-01-11"), ("2025-01-11", "2025-01-11"), ("2025-01-12", "2025-01-11")])
def test_weekend(spark, day, saturday):
    assert str(one(spark, calendar.weekend_of(F.lit(day).cast("date"))[0])) == saturday


@pytest.mark.parametrize(("raw", "clean"), [("Preview: Amélie", "Amélie"), ("Star Wars: A New Hope", "Star Wars: A New Hope"), ("Alien (1979)", "Alien"), ("Jaws (35mm) (1975)", "Jaws (35mm)"), ("Tom &amp; Jerry", "Tom & Jerry"), ("Heat - 4K Restoration", "Heat"), ("", "")])
def test_cleaned(spark, raw, clean):
    assert one(spark, titles.cleaned(F.lit(raw))) == clean


def test_normalisers_differ(spark):
    t = F.lit("The Amélie: Part Two (1968)")
    assert one(spark, titles.normalised(t)) == "amelie part two"
    assert one(spark, titles.normalised_ascii(t)) == "the amlie part two 1968"
    assert one(spark, titles.normalised_before_colon(t)) == "the amélie"
    assert one(spark, titles.normalised_after_colon(t)) == "part two (1968)"
    assert one(spark, titles.bracketed_english(F.lit("七人の侍 (Seven Samurai)"))) == "Seven Samurai"
    assert one(spark, titles.bracketed_english(F.lit("Heat (Director)"))) is None
    assert one(spark, titles.smart_case(F.lit("THE LONG GOODBYE"))) == "The Long Goodbye"


def _plainly_decoded(text):
    """References resolved by Python's own means, in the order that is asked for."""

    def run(m):
        names = re.findall("&([A-Za-z0-9]+);", m.group())
        if any(n not in titles.BYTE_NAMES for n in names):
            return m.group()
        try:
            return bytes(name2codepoint[n] for n in names).decode()
        except UnicodeDecodeError:
            return m.group()

    def code(base):
        return lambda m: chr(int(m[1], base)) if int(m[1], base) <= 0x10FFFF and not 0xD800 <= int(m[1], base) <= 0xDFFF else m.group()

    text = re.sub("(?:&[A-Za-z0-9]+;){2,}", run, text)
    text = re.sub("&#[xX]([0-9a-fA-F]+);", code(16), text)
    text = re.sub("&#([0-9]+);", code(10), text)
    return re.sub("&([A-Za-z0-9]+);", lambda m: titles.NAMES.get(m[1], m.group()), text)


def test_references_equal_a_plain_decoder(spark):
    """All names in all pairs, numbers at the edges of what is allowed, nested references and random strings of pieces."""
    dice = random.Random(5)
    pieces = [f"&{n};" for n in [*titles.BYTE_NAMES, *titles.NAMES, "nosuch"]] + "&#x26; &#X1F3AC; &#38; &#0065; &#xD800; &#x110000; &#x10FFFF; &#00000000000000000000233; &#99999999999999999999999; &#; &#x; & ; a # x \n".split(" ")
    texts = ["", "&", "&&amp;", "&#x26;amp;", "&#38;#65;", "&Atilde;&iexcl;", "&Acirc;&nosuch;", *(a + b for a in pieces for b in pieces[::7]), *("".join(dice.choices(pieces, k=dice.randint(1, 9))) for _ in range(2000))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", titles.decoded(F.col("t")).alias("d")).collect()
    assert [(r.t, r.d) for r in rows if r.t is not None and r.d != _plainly_decoded(r.t)] == []
    assert [r.d for r in rows if r.t is None] == [None]


def test_titles_inside_events(spark):
    cases = [
        ("Heat", "Heat", "none", 1.0, False, False, False), ("", "", "none", 1.0, False, False, False), (None, "", "none", 1.0, False, False, False), ("  Heat ", "Heat", "none", 1.0, False, False, False),
        ("nt live: Hamlet", "Hamlet", "prefix_removal", 0.9, False, True, False), ("LFF: Shorts + Q&A", "Shorts", "prefix_removal+suffix_removal", 0.3, True, False, False),
        ("Pub Quiz: Heat", "Pub Quiz: Heat", "non_film_detected", 0.0, False, False, True), ("Club presents “Heat”", "Heat", "presents_pattern", 0.95, False, False, False),
        ("Sing-A-Long-A Grease + Hair", "Grease", "singalong_pattern+double_feature", 0.7, False, False, False), ("Heat + Ronin", "Heat", "double_feature", 0.7, False, False, False),
        ("Heat (4K Restoration) (Preview)", "Heat (4K Restoration)", "suffix_removal", 0.85, False, False, False), ("Heat (Preview) [sub]", "Heat (Preview)", "suffix_removal", 0.85, False, False, False), ("Encore", "Encore", "none", 1.0, False, False, False),
        ("Heat (15) [sub]", "Heat (15)", "suffix_removal", 0.85, False, False, False), ("Heat [sub] (15)", "Heat", "suffix_removal+suffix_removal", 0.85, False, False, False), ("Tom &amp; Viv", "Tom & Viv", "none", 1.0, False, False, False),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", extraction.extracted(F.col("t")).alias("e")).collect()
    assert [(cases[r.i], tuple(r.e)) for r in rows if tuple(r.e) != cases[r.i][1:]] == []


def test_every_event_prefix_is_known(spark):
    rows = spark.createDataFrame([(p, f"{p.upper()}: Some Title") for p in extraction.EVENT_PREFIXES], "p string, t string").select("p", extraction.extracted(F.col("t")).alias("e")).collect()
    assert [r.p for r in rows if r.e.extracted != "Some Title"] == []


def test_known_kinds(spark):
    entries = spark.createDataFrame([(2, " Jazz Night ", "concert"), (1, "jazz night", None), (3, "Opera", "live_broadcast"), (4, None, "concert"), (5, "", "concert")], "place int, title string, kind string")
    rows = spark.createDataFrame([("JAZZ NIGHT",), ("Opera ",), ("Opera club",), ("Heat",), (None,), ("",)], "title string")
    got = {r.title: r.known for r in extraction.known_kinds(rows, entries, [("club$", "talk")]).collect()}
    assert got == {"JAZZ NIGHT": "event", "Opera ": "live_broadcast", "Opera club": "event", "Heat": None, None: None, "": None}


@pytest.mark.parametrize(("text", "minutes"), [("7:30", 1170), ("19:30", 1170), ("12am", 0), ("12pm", 720), ("11:05", 665), ("9:59 am", 599), ("25:00", None), ("none", None)])
def test_clock(spark, text, minutes):
    assert one(spark, values.clock(F.lit(text))) == minutes


@pytest.mark.parametrize(("text", "day"), [("2025-02-03", "2025-02-03"), ("3/2/2025", "2025-02-03"), ("Mon 3 Feb", "2025-02-03"), ("3rd January", "2026-01-03"), ("4 January 2024", "2024-01-04"), ("soon", None), ("31/2/2025", None)])
def test_listing_date(spark, text, day):
    found = one(spark, values.listing_date(F.lit(text), F.lit("2025-01-06").cast("date")))
    assert (str(found) if found else None) == day


def test_small_values(spark):
    assert one(spark, values.runtime(F.lit("601"))) is None and one(spark, values.runtime(F.lit(" 95 min"))) == 95
    assert one(spark, values.postcode(F.lit("se1 8xt"))) == "SE1 8XT" and one(spark, values.postcode(F.lit("12345"))) is None
    assert one(spark, values.in_polygon(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)])) is True
    assert one(spark, values.in_polygon(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 2)])) is False
    assert one(spark, health.half_up(F.lit(-2.5))) == -2 and one(spark, health.half_up(F.lit(2.5))) == 3


def test_similarities(spark):
    tri = lambda a, b: one(spark, search.overlap(search.trigrams(F.lit(a)), search.trigrams(F.lit(b))))
    assert round(tri("The Thin Man", "The Third Man"), 3) == 0.643
    assert tri("Amélie", "amelie") == 1 and tri("", "") == 0
    assert one(spark, search.dice(F.lit("a"), F.lit("a"))) == 1 and one(spark, search.dice(F.lit("aaaa"), F.lit("aa"))) == 0.5
    zero, vector = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, search.cosine(zero, vector)) == 0 and one(spark, search.cosine(vector, vector)) == 1
    with pytest.raises(Exception, match="differ in length"):
        one(spark, search.cosine(vector, F.array(F.lit(1.0))))
    assert one(spark, search.levenshtein_similarity(F.lit(""), F.lit(""))) == 1


def test_cursor_and_params():
    assert L.decode_cursor(L.encode_cursor("2025-01-06T12:00:00Z", "a_b".replace("_", ""))) == ("2025-01-06T12:00:00Z", "ab")
    assert L.decode_cursor("none") is None
    f = L.Filters(search="x y", venues=[1, 2], hour_from=3, genres=["a"], single_only=True)
    assert requests.from_params(requests.to_params(f)) == f
    assert requests.from_params("hour_from=abc&venues=1,x&junk=1") == L.Filters(venues=[1])


def test_streak_stops_at_a_failed_run(spark):
    rows = [(1, 1, "success", 0), (1, 2, "failed", 0), (1, 3, "success", 0), (1, 4, "success", 0), (2, 1, "success", 5), (3, 9, "success", None)]
    runs = spark.createDataFrame([(v, i, dt.datetime(2025, 1, i), s, n) for v, i, s, n in rows], "venue_id long, run_id long, started_at timestamp_ntz, status string, found int")
    assert {r.venue_id: r.streak for r in health.leading_empty_runs(runs).collect()} == {1: 2, 2: 0, 3: 1}


def test_leave_one_out_medians(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 5, 9, 20])] + [("b", 10, 3)], "g string, k long, v int")
    got = {r.k: r.others_median for r in health.leave_one_out_medians(df, "g", "k", "v").collect()}
    assert got == {0: 9, 1: 9, 2: 5, 3: 5, 10: None}


@pytest.mark.parametrize(("seconds", "near"), [(119, True), (120, False), (121, False), (0, False)])
def test_close_pairs_at_the_limit(spark, seconds, near):
    base = dt.datetime(2025, 1, 6, 12, 1, 59)
    df = spark.createDataFrame([(1, base, 1), (1, base + dt.timedelta(seconds=seconds), 2), (2, base, 3)], "v long, t timestamp_ntz, id long")
    assert [(r.a, r.b) for r in dedupe.close_pairs(df, ["v"], "t", "id", 120).collect()] == ([(1, 2)] if near else [])


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.node: r.root for r in dedupe.min_labels(links, saved).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 60}
    assert dedupe.min_labels(links.where("a < 0"), saved).count() == 0


def test_upsert_and_sync(spark):
    schema = "k long, v string, at int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], schema)
    new = spark.createDataFrame([(2, None, 2), (3, "c", 2), (3, "d", 3), (None, "m", 2)], schema)
    merged = {(r.k, r.v, r.at) for r in ingest.upsert(old, new, ["k"], [F.asc("at")], ["v"]).collect()}
    assert merged == {(1, "a", 1), (2, "b", 2), (3, "c", 2), (None, "n", 1), (None, "m", 2)}
    client = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (4, "z", 1)], schema)
    assert {(r.k, r.v, r.winner) for r in ingest.synced(old.where("k is not null"), client, ["k"], "at").collect()} == {(1, "a", "server"), (2, "y", "client"), (4, "z", "client")}


def test_calendar_events(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART:20250106T193000Z\r\nSUMMARY:Ham\r\n let\\, live\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = ingest.calendar_events(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string"), "k", "text").collect()
    assert [(r.k, r.uid, str(r.starts), r.summary) for r in got] == [(1, "1", "2025-01-06 19:30:00", "Hamlet, live")]


@pytest.mark.parametrize("title, clean, kind, events, formats", [
    ("UK PREMIERE Iron Horse", "Iron Horse", "film", ["premiere"], []),
    ("Saturday Morning Picture Club: Paddington (2014)", "Paddington", "film", [], []),
    ("Late Night: Alien - Director's Cut", "Alien", "film", [], []),
    ("Ealing Film Society presents: Kes", "Kes", "film", [], []),
    ("Classic Matinee: Preview: Brief Encounter", "Brief Encounter", "film", ["preview"], []),
    ("NT Live: Hamlet", "Hamlet", "live_broadcast", [], []),
    ("Pub Quiz Night", "Pub Quiz Night", "event", ["quiz"], []),
    ("Abba in Concert", "Abba in Concert", "concert", [], []),
    ("Dune (70mm IMAX) + Q&A", "Dune", "film", ["q_and_a"], ["70mm_imax", "70mm", "imax"]),
    ("Akira 4K Restoration, Japanese subtitles", "Akira 4K Restoration, Japanese subtitles", "film", [], ["dcp_4k"]),
    ("Beyond the Hills", "Beyond the Hills", "film", [], []),
])
def test_title_rules(spark, title, clean, kind, events, formats):
    t = F.lit(title)
    r = spark.range(1).select(titles.cleaned(t).alias("clean"), titles.content_class(t).alias("kind"), titles.events(t).alias("events"), titles.formats(t).alias("formats")).first()
    assert (r.clean, r.kind, r.events, r.formats) == (clean, kind, events, formats)


def test_access_subtitles_and_seasons(spark):
    assert one(spark, titles.access(F.lit("Relaxed screening in 3D, subtitled")), x=1) == ["3d", "relaxed", "subtitles"]
    assert one(spark, titles.subtitle_language(F.lit("Ran with English ST")), x=1) == "en" and one(spark, titles.subtitle_language(F.lit("Ran")), x=1) is None
    assert one(spark, titles.season_in(F.lit("Kurosawa Season: Ran")), x=1) == "Kurosawa Season" and one(spark, titles.season_in(F.lit("Ran: the film")), x=1) is None


def test_every_listed_phrase_of_titles(spark):
    """Each programme name before each mark, each ending in brackets and after a dash, and each broadcast and keyword."""
    rows = [(p, f"{p.title()}{mark} Ran") for p in titles.PREFIXES for mark in (":", " |", " -")] + [(p, f"Ran {form.format(p)}") for p in titles.SUFFIXES for form in ("({})", "[{}]", "- {}", "| {}")]
    found = spark.createDataFrame(rows, "phrase string, t string").select("phrase", "t", titles.cleaned(F.col("t")).alias("c")).where("c <> 'Ran'").collect()
    assert found == []
    told = spark.createDataFrame([(p, f"{p.upper()}: Title") for p in titles.BROADCASTS], "phrase string, t string").where(titles.content_class(F.col("t")) != "live_broadcast").collect()
    assert told == []
    not_films = spark.createDataFrame([(k, f"Our {k.title()} here") for k in titles.KEYWORDS], "phrase string, t string").where(titles.not_a_film(F.col("t")).isNull()).collect()
    assert not_films == []


def test_ratings_with_years(spark):
    texts = ["Rated 7.8 / 10 (1998)", "8/10 (2001)", "11/10 (1999)", "7.8 / 10", None]
    rating, year = values.rating_and_year(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rating, year).collect()]
    assert got == [(7.8, 1998), (8.0, 2001), (None, 1999), (None, None), (None, None)]


@pytest.mark.parametrize("rule, title, want", [
    (titles.normalised_for_seasons, "The Amélie: 2", "amlie 2"), (titles.normalised_for_cleanup, "Preview: The Ran (35mm)", "ran"), (titles.normalised_for_checks, "The “Ran” – it’s on (4K)", "\"ran\" - it's on".replace('"', "")),
    (titles.normalised_for_blocklist, "TV Party, Tonight!: “Ran” (1985) + Q&A", "ran"), (titles.normalised_in_two_stages, "Seniors' Free Matinee: The Amélie & 8½ + in conversation with X", "amelie and 8 1/2"),
    (titles.normalised_in_two_stages, "UK Premiere of 4K Restoration: Ran", "ran"), (titles.normalised_gently, "The Amélie, 七人!", "amelie 七人"), (titles.normalised_exactly, "Alien: Romulus.", "alien romulus"), (titles.without_marks, "Ça va?", "ca va?"), (titles.without_marks, "", None),
])
def test_other_title_rules(spark, rule, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(rule(F.col("t"))).first()[0] == want
