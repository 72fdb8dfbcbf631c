"""Personal data by bootstrapped contextual extraction.

One pass over the texts finds the base entities (email, ip, card, phone) by their formats, and every other candidate: a word
with an at sign between other characters, a word with three digits or more, or a run of LEAST_DIGITS digits or more in groups.
Each carries the lexical patterns that it bears witness to, from the most special to the most general: the words around it (two
before, one before, one after, one at either side), its own shape with lengths and leading character, and its shape without
lengths. Base entities are seeds. The graph of patterns and instances is then scored by rounds of joins and sums: a pattern is
as sure of a kind as the weighted mean of its distinct instances, shrunk towards 0; an instance's score is that not all of
its sure patterns are wrong about it (noisy or). Patterns above CONFIDENT with SUPPORT distinct seed instances or more are sure and add the unseen identifiers that bear
them as spans of their kind, such as card numbers with a mistyped digit, addresses with letters beyond ASCII, or numbers that
stand where only numbers of one kind do. Base spans always stay.

Only identifiers and contexts leave a task, as short strings and positions; the graph is summed by (pattern, instance) before it
is joined, so a pattern that holds a third of all rows arrives as partial sums. No text is shuffled or collected.

Positions are in code points, the end is exclusive. Null texts count as empty: no spans, and the digest of an empty list.
Rows alike in doc_id are scanned each on its own. Very long texts, words and runs of digits take time in proportion to
their length; none is too long to be a candidate. Columns other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern's score, and the distinct seed instances behind it, for it to add spans.
CONFIDENT, SUPPORT = 0.8, 8
#: What a pattern's mean is shrunk with: so many instances of score 0. An instance of unknown kind weighs less than a seed.
SHRINK, UNKNOWN = 1.0, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match inside a run of digits would begin at the run's start too, so only those are tried: long runs stay cheap.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A candidate number has that many digits at least: fewer identify nobody.
LEAST_DIGITS = 7
#: What parts candidates; what a candidate number is made of.
CHUNK = re.compile(r"[^\s\"'<>\[\]{},;:=|]+")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
WORD = re.compile(r"\S+")
#: Longer instances go by their digest, longer words of a context by their ends.
LONGEST_KEY, LONGEST_WORD = 64, 32


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is the whole run of its characters before the at sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base entities, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _lexical(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.lower())


def form(instance: str) -> str:
    """The shape of an identifier: runs of letters and of digits with their lengths, other characters as they are."""
    return re.sub(r"[^\W\d_]+|[0-9]+", lambda m: f"{'0' if m[0][0] in '0123456789' else 'a'}{len(m[0])}", instance)


def patterns(text: str, start: int, end: int) -> list[str]:
    """What a span bears witness to: patterns around it, from at most 80 characters at either side, and of its own shape."""
    before = [w[-LONGEST_WORD:] for w in map(_lexical, WORD.findall(text, max(0, start - 80), start)[-2:])]
    after = [w[:LONGEST_WORD] for w in map(_lexical, WORD.findall(text, end, min(len(text), end + 80))[:1])]
    out = ["L1 " + before[-1]] if before else []
    if len(before) == 2:
        out.append("L2 " + " ".join(before))
    if after:
        out.append("R1 " + after[0])
        if before:
            out.append("B " + before[-1] + " _ " + after[0])
    shape = form(text[start:end])
    # The leading digit of a number tells who issued it; the leading letter of a name tells nothing.
    special = ("S " + (text[start] if text[start] in "0123456789" else "") + shape)[:LONGEST_KEY]
    return [*out, special, ("C " + re.sub("[0-9]+", "", re.sub("0[0-9]+", "d", shape)))[:LONGEST_KEY]]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans that look like identifiers, whatever their format."""
    for m in CHUNK.finditer(text):
        word = m[0]
        start, end = m.start() + len(word) - len(word.lstrip("().!?*#$%&-_/\\")), m.end() - len(word) + len(word.rstrip("().!?*#$%&-_/\\+@"))
        if end > start:
            inner = text[start:end]
            if "@" in inner[1:] or not inner.isdecimal() and sum(map(inner.count, "0123456789")) >= 3:
                yield start, end
    for m in NUMBER.finditer(text):
        if sum(map(m[0].count, "0123456789")) >= LEAST_DIGITS:
            yield m.start(), m.end()


def mentions(text: str) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, kind or -1, end, instance, patterns) of base entities and of candidates that touch none, the longest of those that touch each other."""
    base = base_spans(text)
    found = [(a, k, b) for a, k, b in base]
    taken, i = sorted((a, b) for a, _, b in base), 0
    open_: list[tuple[int, int]] = []
    for a, b in sorted(set(candidates(text))):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        if open_ and a < open_[-1][1]:
            if b - a > open_[-1][1] - open_[-1][0]:
                open_[-1] = (a, b)
        else:
            open_.append((a, b))
    found += [(a, -1, b) for a, b in open_]
    return [(a, k, b, _key(text[a:b]), patterns(text, a, b)) for a, k, b in sorted(found)]


def _key(instance: str) -> str:
    key = instance.lower()
    return key if len(key) <= LONGEST_KEY else hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()


FOUND = "array<struct<start: int, kind: int, end: int, instance: string, patterns: array<string>>>"


def _mentions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[dict(zip(("start", "kind", "end", "instance", "patterns"), m, strict=True)) for m in mentions(t or "")] for t in texts])


def scored_patterns(seen: DataFrame) -> DataFrame:
    """pattern, kind, score, support of each pattern that a seed has, from mentions (kind, instance, pattern)."""
    # An instance is a seed of the kind that its format gives it; -1: of none.
    edges = durable(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("n")), "edges")
    seeded = edges.where("kind >= 0").groupBy("pattern").agg(F.count("*").alias("support")).where(f"support >= {SUPPORT}")
    edges = durable(edges.join(seeded.select("pattern"), "pattern", "left_semi"), "edges")
    kinds = F.when(F.col("kind") >= 0, F.array("kind")).otherwise(F.array(*map(F.lit, range(len(KINDS)))))
    graph = edges.select("pattern", "instance", (F.col("kind") >= 0).alias("seed"), F.explode(kinds).alias("of"))
    scores = None
    for _ in range(ROUNDS):
        known = F.when(F.col("seed"), F.lit(1.0))
        edge_scores = graph.withColumn("s", F.coalesce(known, F.lit(0.0))) if scores is None else graph.join(scores, ["instance", "of"], "left").withColumn("s", F.coalesce(known, "score", F.lit(0.0)))
        # Distinct instances of other kinds count against a pattern.
        sums = edge_scores.groupBy("pattern", "of").agg(F.sum(F.col("s") * F.when(F.col("seed"), 1.0).otherwise(UNKNOWN)).alias("s"), F.sum(F.col("seed").cast("long")).alias("support"))
        sizes = edges.groupBy("pattern").agg(F.sum(F.when(F.col("kind") >= 0, 1.0).otherwise(UNKNOWN)).alias("n"))
        rated = sums.join(sizes, "pattern").select("pattern", "of", "support", (F.col("s") / (F.col("n") + SHRINK)).alias("score"))
        rated = durable(rated, "patterns")
        # Noisy or over the sure patterns of an instance; unsure ones are too many and too general to add up.
        wrong = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))
        sure = rated.where(f"score >= {CONFIDENT} and support >= {SUPPORT}").select("pattern", "of", "score")
        linked = graph.where("not seed").join(sure, ["pattern", "of"])
        scores = linked.groupBy("instance", "of").agg((1 - F.exp(wrong)).alias("score"))
        scores = durable(scores, "instances")
    return rated.withColumnRenamed("of", "kind")


def personal_data(docs: DataFrame, hidden: Column | None = None) -> DataFrame:
    """One row per document: doc_id, and arrays base and added of (start, kind, end).

    hidden, over doc_id, marks documents whose base entities are no seeds, but candidates like any other: what is added of
    those measures the method. Their base spans are left out then.
    """
    found = docs.select("doc_id", F.pandas_udf(_mentions, FOUND)(text_of()).alias("found"))
    found = durable(found.withColumn("_row", F.monotonically_increasing_id()), "mentions")
    if hidden is not None:
        unknown = F.transform("found", lambda m: m.withField("kind", F.lit(-1)))
        found = found.withColumn("found", F.when(hidden, unknown).otherwise(F.col("found")))
    seen = found.select("_row", F.explode("found").alias("m")).select("_row", "m.start", "m.kind", "m.end", "m.instance", F.explode("m.patterns").alias("pattern"))
    sure = scored_patterns(seen).where(f"score >= {CONFIDENT} and support >= {SUPPORT}").groupBy("pattern").agg(F.max_by("kind", "score").alias("said"))
    added = seen.where("kind < 0").join(sure, "pattern").groupBy("_row").agg(F.collect_set(F.struct("start", F.col("said").alias("kind"), "end")).alias("added"))
    # Bounded by the mentions of one text.
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    base = F.transform(F.filter("found", lambda m: m["kind"] >= 0), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    return found.select("_row", "doc_id", base.alias("base")).join(added, "_row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # In SQL: a second parameter of a lambda would be the place in the array.
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
