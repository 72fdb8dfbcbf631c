"""The film's title inside an event's, with how it was found and how sure that is; and entries that a list knows to be no films."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions.titles import references_decoded, squeezed

#: Names before a colon that are no part of a title.
EVENT_PREFIXES = """
Drink & Dine; Drink and Dine; Dine & Drink; Arabic Cinema Club; Saturday Morning Picture Club; Classic Matinee; Varda Film Club; Artist's Film Picks; Films For Workers; Reclaim the Frame presents
Sonic Cinema; The Liberated Film Club; Underscore Cinema; Dub Me Always; Carers & Babies; Carers and Babies; Queer Horror Nights; A Festive Feast; Funeral Parade presents; UK Premiere
Met Opera Live; Met Opera Encore; National Theatre Live; NT Live; Royal Opera House; ROH Live; Royal Ballet; Bolshoi Ballet; Berliner Philharmoniker Live; Exhibition on Screen
Doc 'N Roll; Doc N Roll; LSFF; LFF; BFI Flare; 35mm; 70mm; 4K; IMAX
""".strip().replace("\n", "; ").split("; ")
#: Festivals among them, whose entries are compilations, and parts of names of broadcasts.
FESTIVALS = ["LSFF", "LFF", "BFI FLARE"]
BROADCAST_WORDS = ["opera", "theatre", "ballet", "nt live", "roh", "exhibition on screen", "berliner philharmoniker"]
#: What is cut off a title's end, in this order.
ENDINGS = [
    r"\s*\+\s*Q&(?:amp;)?A.*$", r"\s*\+\s*Intro.*$", r"\s*\+\s*Introduction.*$", r"\s*\+\s*Panel.*$", r"\s*\+\s*Discussion.*$", r"\s*with\s+Q&(?:amp;)?A.*$", r"\s*with\s+Shadow\s+Cast.*$", r"\s*with\s+Live\s+.*$",
    r"\s*\+\s*PJ\s+Party.*$", r"\s*\+\s*Pajama\s+Party.*$", r"\s*\(4K\s+Restoration\)$", r"\s*\(4K\s+Remaster(?:ed)?\)$", r"\s*\(4K\s+Re-?release\)$", r"\s*\(Restored\)$", r"\s*\(Digital\s+Restoration\)$",
    r"\s*\(Director'?s?\s+Cut\)$", r"\s*\(Extended\s+(?:Edition|Cut)\)$", r"\s*\(Original\s+Cut\)$", r"\s*\(Theatrical\s+Cut\)$", r"\s*4K$", r"\s*\(35mm\)$", r"\s*[-•]\s*\d+(?:th|st|nd|rd)?\s+Anniversary.*$",
    r"\s*\(\d+(?:th|st|nd|rd)?\s+Anniversary\)$", r"\s*-\s*Preview$", r"\s*\(Preview\)$", r"\s*\(\d{4}\s+Encore\)$", r"\s*Encore$", r"\s*Double[- ]?Bill$", r"\s*\+\s+.+Double[- ]?Bill$", r"\s*\(202[5-9]\)$", r"\s*\(203\d\)$",
    r"\s*TBC$", r"\s+Sing-?A?-?Long!?$", r":\s*Extended\s+Edition$", r"\s+-\s+Original\s+Cut$", r"\s*\+\s*(?:Prosecco|Mulled\s+Wine).*$", r"\s*\((U|PG|12A?|15|18)\*?\)\s*$", r"\s*\[.*?\]\s*$", r"\s*-\s*(35mm|70mm|4k|imax)\s*$",
]
#: Entries that are no films, by pattern.
NO_FILMS = [
    r"\bQuiz\b", r"\bReading\s+Group\b", r"\bCafé\s+Philo\b", r"\bCafe\s+Philo\b", r"\bCafés\s+philo\b", r"\bCompetition\b", r"\bStory\s+Time\b", r"\bBaby\s+Comptines\b", r"\bLanguage\s+Activity\b", r"\bIn\s+conversation\s+with\b",
    r"\bCome\s+and\s+Sing\b", r"\bMarathon$", r"\bOrgan\s+Trio\b", r"\bBlues\s+at\b", r"\bFunky\s+Stuff\b", r"\bMusic\s+Video\s+Preservation\b", r"\bComedy:", r"\bClub\s+Room\s+Comedy\b", r"\bVinyl\s+Reggae\b", r"\bVinyl\s+Sisters\b",
    r"\bAnimated\s+Shorts\s+for\b",
]
#: A quoted title after its presenter, a title sung along to, the first of two films, and how sure each finding is.
PRESENTED, SUNG, FIRST_OF_TWO = r'^.+\s+presents?\s+["“](.+)["”]$', r"^Sing-?A-?Long-?A?\s+(.+)$", r"^(.+?)\s*\+\s*.+$"
SURE = {"presents_pattern": 0.95, "singalong_pattern": 0.9, "prefix_removal": 0.9, "suffix_removal": 0.85, "double_feature": 0.7, "compilation": 0.3}
#: An event's name and its colon.
PREFIX = "^(" + "|".join(map(re.escape, EVENT_PREFIXES)) + r"):\s*"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def _state(text: Column, methods: Column, sure: Column, compilation: Column, broadcast: Column) -> Column:
    return F.struct(text.alias("text"), methods.alias("methods"), sure.alias("sure"), compilation.alias("compilation"), broadcast.alias("broadcast"))


def _whole(s: Column, pattern: str, method: str) -> Column:
    """The part of a whole title that a pattern names; the method then stands alone."""
    new = _state(F.regexp_extract(s.text, _any_case(pattern), 1), F.array(F.lit(method)), F.lit(SURE[method]), s.compilation, s.broadcast)
    return F.when(s.text.rlike(_any_case(pattern)), new).otherwise(s)


def _without_prefix(s: Column) -> Column:
    name = F.regexp_extract(s.text, _any_case(PREFIX), 1)
    festival = F.upper(name).isin(FESTIVALS)
    sure = F.when(festival, F.lit(SURE["compilation"])).otherwise(F.least(s.sure, F.lit(SURE["prefix_removal"])))
    new = _state(F.regexp_replace(s.text, _any_case(PREFIX), ""), F.concat(s.methods, F.array(F.lit("prefix_removal"))), sure, festival, F.lower(name).rlike("|".join(BROADCAST_WORDS)))
    return F.when(name != "", new).otherwise(s)


def _ending(pattern: str) -> Callable[[Column], Column]:
    """The step that cuts this ending off."""

    def step(s: Column) -> Column:
        new = _state(F.trim(F.regexp_replace(s.text, _any_case(pattern), "")), F.concat(s.methods, F.array(F.lit("suffix_removal"))), F.least(s.sure, F.lit(SURE["suffix_removal"])), s.compilation, s.broadcast)
        return F.when(s.text.rlike(_any_case(pattern)), new).otherwise(s)

    return step


def _first_of_two(s: Column) -> Column:
    two = F.contains(s.text, F.lit(" + ")) & ~F.array_contains(s.methods, "suffix_removal") & s.text.rlike(FIRST_OF_TWO)
    new = _state(F.trim(F.regexp_extract(s.text, FIRST_OF_TWO, 1)), F.concat(s.methods, F.array(F.lit("double_feature"))), F.least(s.sure, F.lit(SURE["double_feature"])), s.compilation, s.broadcast)
    return F.when(two, new).otherwise(s)


def extracted(title: Column) -> Column:
    """A struct: extracted, method (those that acted, joined by a plus), confidence, compilation, broadcast, non_film.

    Null titles count as empty. Steps in order: no film, decoding, presented, sung along to, prefix, endings, two films, quotes. A title of which nothing is left stays whole.
    """
    title = F.coalesce(title, F.lit(""))
    none = F.array().cast("array<string>")
    s = _state(references_decoded(F.trim(title)), none, F.lit(1.0), F.lit(False), F.lit(False))
    for step in (lambda s: _whole(s, PRESENTED, "presents_pattern"), lambda s: _whole(s, SUNG, "singalong_pattern"), _without_prefix, *map(_ending, ENDINGS), _first_of_two):
        s = _let(s, step)

    def result(text: Column, method: Column, sure: Column, compilation: Column, broadcast: Column, non_film: bool) -> Column:
        return F.struct(text.alias("extracted"), method.alias("method"), sure.alias("confidence"), compilation.alias("compilation"), broadcast.alias("broadcast"), F.lit(non_film).alias("non_film"))

    def told(s: Column) -> Column:
        text = F.trim(F.regexp_replace(squeezed(s.text), "^[\"'“”]+|[\"'“”]+$", ""))
        method = F.when(F.size(s.methods) == 0, "none").otherwise(F.array_join(s.methods, "+"))
        no = F.lit(False)
        return F.when((text != title) & (text != ""), result(text, method, s.sure, s.compilation, s.broadcast, False)).otherwise(result(title, F.lit("none"), F.lit(1.0), no, no, False))

    no_film = result(F.trim(title), F.lit("non_film_detected"), F.lit(0.0), F.lit(False), F.lit(False), True)
    return F.when(F.trim(title).rlike(_any_case("|".join(NO_FILMS))), no_film).otherwise(_let(s, told))


def known_kinds(rows: DataFrame, entries: DataFrame, patterns: list[tuple[str, str | None]]) -> DataFrame:
    """rows with `known`: the kind (concert, live_broadcast or event) of the first entry whose title is theirs but for case and blanks around it, else of the first pattern found, else null.

    entries: place, title, kind. They meet by an equality join, so they may be as many as the rows; patterns are a short list. Titles of no text are no entries; a kind that is null or another counts as event.
    """
    key = lambda c: F.lower(F.trim(c))
    kind = lambda c: F.when(c.isin("concert", "live_broadcast"), c).otherwise(F.lit("event"))
    listed = entries.where(F.col("title") != "").groupBy(key(F.col("title")).alias("_key")).agg(F.min_by(F.struct(kind(F.col("kind")).alias("k")), "place").alias("_entry"))
    found = F.coalesce(F.col("_entry.k"), *(F.when(F.col("title").rlike(_any_case(p)), kind(F.lit(k))) for p, k in patterns))
    return rows.join(listed, key(F.col("title")) == F.col("_key"), "left").withColumn("known", found).drop("_key", "_entry")
