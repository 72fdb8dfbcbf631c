"""Hybrid text search: weighted terms, trigram similarity, rank fusion and boosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions.stemming import lexeme, stems_of

#: Letters with marks and what they are without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿßœæø"
BARE = "aaaaaaceeeeiiiinooooouuuuyysoao"
#: Weights of field classes A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
CLASSES = "ABCD"


def folded(text: Column) -> Column:
    """Small letters without marks."""
    return F.translate(F.lower(text), MARKED, BARE)


def terms(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_matches(positions: DataFrame, key: str, query: list[str]) -> DataFrame:
    """key, score of documents that have all stems of the query: the sum of the weights of their places."""
    hit = positions.where(F.col("term").isin(query)).groupBy(key).agg(F.sum("weight").alias("score"), F.count_distinct("term").alias("n"))
    return hit.where(F.col("n") == len(set(query))).drop("n")


def words_of(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, word, pos, class: a row per occurrence; fields (column: class) follow each other."""
    placed = lambda c, k: F.transform(terms(F.col(c)), lambda t: F.struct(t.alias("word"), F.lit(CLASSES.index(k)).alias("class")))
    parts = [F.coalesce(placed(c, k), F.array().cast("array<struct<word:string,class:int>>")) for c, k in fields.items()]
    return docs.select(key, F.posexplode(F.concat(*parts)).alias("pos", "t")).select(key, "t.word", "pos", "t.class")


def term_positions(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, term, pos, weight: a row per occurrence of a stem, without an index; stop words count as places only."""
    found = words_of(docs, key, fields)
    weight = F.element_at(F.array(*(F.lit(WEIGHTS[c]) for c in CLASSES)), F.col("class") + 1)
    return found.join(stems_of(found), "word").select(key, F.col("stem").alias("term"), "pos", weight.alias("weight"))


Condition = tuple[bool, list[tuple[int, str]]]


def web_query(query: str) -> list[list[Condition]]:
    """Alternatives (or) of conditions that all hold: whether the words must be absent (-), and their stems with places, on end if quoted.

    Stop words are left out, but keep their place inside quotes; a condition of stop words alone is none.
    """
    out: list[list[Condition]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower().translate(str.maketrans(MARKED, BARE))):
        found = [(i, t) for i, t in enumerate(map(lexeme, re.findall(r"[^\W_]+", quoted or word))) if t]
        if word == "or" and not minus:
            out.append([])
        elif found:
            out[-1].append((bool(minus), [(i - found[0][0], t) for i, t in found]))
    return [o for o in out if any(not absent for absent, _ in o)]


def web_terms(query: str) -> list[str]:
    """All stems that a web query looks up."""
    return sorted({t for o in web_query(query) for _, words in o for _, t in words})


def web_matches(positions: DataFrame, key: str, query: str) -> DataFrame:
    """key, score of documents that a web query finds, ranked by cover density: each shortest run of words that holds all of the
    query's terms counts by its weights, and less the more other words it has.

    One pass over a document's hits: it keeps each term's last place, so a run that ends at a hit begins at the earliest of them.
    """
    wanted = web_query(query)
    if not wanted:
        return positions.select(key, F.lit(0.0).alias("score")).limit(0)
    asked = sorted({t for o in wanted for absent, words in o if not absent for _, t in words})
    hit = positions.where(F.col("term").isin(web_terms(query))).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "term", "weight"))).alias("h"))

    def on_end(words: list[tuple[int, str]]) -> Column:
        # The places of each word, moved to the first one's: what all have in common begins the phrase.
        moved = [F.expr(f"transform(filter(h, x -> x.term = '{t}'), x -> x.pos - {i})") for i, t in words]
        common = moved[0]
        for m in moved[1:]:
            common = F.array_intersect(common, m)
        return F.size(common) > 0

    holds = F.lit(False)
    for option in wanted:
        each = F.lit(True)
        for absent, words in option:
            each &= ~on_end(words) if absent else on_end(words)
        holds |= each
    own = hit.where(holds).withColumn("h", F.filter("h", lambda y: y["term"].isin(asked)))
    names = ", ".join(f"'{t}'" for t in asked)
    # Of each term: the number of its last hit, its place, and the sum of 1 / weight before it; terms that the document lacks stand behind all.
    start = (
        f"named_struct('last', transform(array({names}), t -> named_struct('i', if(exists(h, y -> y.term = t), -1, 2147483647), 'pos', 0, 'inverse', 0D)),"
        " 'i', 0, 'inverse', 0D, 'begun', -1, 'sum', 0D)"
    )
    last = f"transform(s.last, (l, k) -> if(array({names})[k] = y.term, named_struct('i', s.i, 'pos', y.pos, 'inverse', s.inverse), l))"
    step = (
        f"transform(transform(array({last}), l -> named_struct('last', l, 'b', array_min(l))), n -> named_struct('last', n.last, 'i', s.i + 1, 'inverse', s.inverse + 1 / y.weight,"
        " 'begun', if(n.b.i >= 0, n.b.i, s.begun), 'sum', s.sum + if(n.b.i >= 0 and n.b.i > s.begun,"
        " (s.i - n.b.i + 1) / (s.inverse + 1 / y.weight - n.b.inverse) / (1 + (y.pos - n.b.pos) - (s.i - n.b.i)), 0D)))[0]"
    )
    return own.select(key, F.expr(f"aggregate(h, {start}, (s, y) -> {step}, s -> s.sum)").alias("score"))


def trigrams(text: Column) -> Column:
    """The set of trigrams of a text's words, each padded with two blanks before and one behind."""
    words = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def overlap(a: Column, b: Column) -> Column:
    """Share of two sets' union that both have; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def similar_to(docs: DataFrame, key: str, text: str, query: str, least: float) -> DataFrame:
    """key, similarity of texts at least so similar to one query."""
    s = overlap(trigrams(F.col(text)), trigrams(F.lit(query)))
    return docs.select(key, s.alias("similarity")).where(F.col("similarity") >= least)


def places(scored: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The best rows with their rank r; cut first, so that the global window sees few rows."""
    return scored.orderBy(*order).limit(most).withColumn("r", F.row_number().over(Window.orderBy(*order)))


def fused(ranked: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score: reciprocal rank fusion."""
    out = ranked[0].select(key, "r")
    for d in ranked[1:]:
        out = out.unionAll(d.select(key, "r"))
    return out.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("r"))).alias("score"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def contained_similarity(a: Column, b: Column) -> Column:
    """1 if equal, the share of the shorter in the longer if it holds it, else the similarity of spelling."""
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when(a == b, 1.0).when((F.length(short) > 0) & F.contains(long_, short), F.length(short) / F.length(long_)).otherwise(levenshtein_similarity(a, b))


def word_overlap(a: Column, b: Column) -> Column:
    """Words in common as a share of the smaller set."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def bigrams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2))


def numbered_bigrams(text: Column) -> Column:
    """Bigrams with their number among equal ones: sets that have in common what the bigrams have with their repeats."""
    found = bigrams(text)
    return F.transform(found, lambda g, i: F.concat(g, F.size(F.filter(F.slice(found, 1, i + 1), lambda h: h == g)).cast("string")))


def dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams, counted with their repeats, over all bigrams; equality for texts of under two characters."""
    x, y = bigrams(a), bigrams(b)
    times = lambda xs, g: F.size(F.filter(xs, lambda h: h == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double")).otherwise(2 * common / (F.length(a) + F.length(b) - 2))


def titles_match(a: Column, b: Column) -> Column:
    """Equal, one in the other from 6 characters on, or much alike by bigrams."""
    shorter = F.least(F.length(a), F.length(b))
    return (a == b) | ((shorter >= 6) & (F.contains(a, b) | F.contains(b, a))) | (dice(a, b) >= 0.85)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is 0; an error if their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(same.isNull(), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.92, "merge").when(similarity >= 0.85, "review").otherwise("apart")


def length_aware(words: Column) -> Column:
    """The similarity that a title of so many words needs."""
    return F.when(words <= 3, 0.78).when(words <= 5, 0.70).otherwise(0.60)


def word_similarity(query: Column, text: Column) -> Column:
    """The largest overlap of the query's trigrams with those of any run of the text's ordered trigrams."""
    q = trigrams(query)
    words = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    ordered = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3))))
    n = F.size(ordered)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: overlap(q, F.array_distinct(F.slice(ordered, i, k))))))
    return F.when(n > 0, F.array_max(runs)).otherwise(0.0)


def ambiguity(title: Column, year: Column, common: list[str]) -> Column:
    """How likely a title names several works: short, made of common words, without a year; 1 at most."""
    words = terms(title)
    score = (
        F.when(F.size(words) <= 1, 0.4).when(F.size(words) == 2, 0.2).otherwise(0.0) + F.when(F.length(title) <= 5, 0.2).otherwise(0.0)
        + F.when(F.exists(words, lambda w: w.isin(common)), 0.25).otherwise(0.0) + F.when(year.isNull(), 0.3).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


def confidence(title: Column, year: Column, runtime: Column, popularity: Column) -> Column:
    """Weighted agreement of four signals, each between 0 and 1."""
    return 0.4 * title + 0.25 * year + 0.2 * runtime + 0.15 * popularity


def runtime_check(a: Column, b: Column) -> Column:
    """How two runtimes agree: unknown, match within 5 minutes, close within 15, else apart."""
    gap = F.abs(a - b)
    return F.when(gap.isNull(), "unknown").when(gap <= 5, "match").when(gap <= 15, "close").otherwise("apart")
