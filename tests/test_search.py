"""Stems, the stored index and web queries; similarity joins against all pairs."""

from __future__ import annotations

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stagelight.functions import stemming
from stagelight.operators import fuzzy_index, search
from stagelight.operators import similarity_joins as joins
from stagelight.operators.text_index import Entity, TextIndex, kept_index, state_of

#: Known pairs of a word and its Porter2 stem.
STEMS = """
rings ring, caresses caress, ponies poni, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, agreed agre, feed feed, plastered plaster,
motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, falling fall, hissing hiss, failing fail, filing file,
happy happi, by by, say say, relational relat, conditional condit, rational ration, digitizer digit, conformably conform, radically radic,
differently differ, analogously analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formality formal, sensitivity sensit, sensibility sensibl, triplicate triplic, formative format, formalize formal,
electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, adjustable adjust, irritant irrit,
replacement replac, adjustment adjust, dependent depend, adoption adopt, communism communism, activate activ, effective effect, bowdlerize bowdler,
probate probat, rate rate, cease ceas, controlling control, rolling roll, generate generat, generically generic, general general, consign consign,
consigned consign, consistency consist, consolation consol, consolingly consol, knackeries knackeri, knightly knight, knots knot, skies sky, news news,
inning inning, proceed proceed, dying die, universal univers, university univers, films film, screenings screen, running run, festivals festiv,
cinemas cinema, theatre theatr, economies economi, economy economi, large larg, plates plate, middle middl, europe europ, youth youth, boyish boyish,
sayings say, betrayed betray, luxuriated luxuri, fulfilment fulfil, bed bed, shred shred, beds bed, hop hop, evenly even, bias bias, arsenal arsenal,
community communiti
""".strip().replace("\n", " ")


def test_stems():
    pairs = [p.split() for p in STEMS.split(", ")]
    assert len(pairs) > 100 and {w: stemming.stem(w) for w, _ in pairs} == dict(pairs)
    assert [stemming.lexeme(w) for w in ("the", "themselves", "rings", "t", "12")] == [None, None, "ring", None, "12"]


def test_distinct_words_are_stemmed(spark):
    words = spark.createDataFrame([("rings",), ("ring",), ("the",), ("rings",), (None,)], "word string")
    assert sorted(tuple(r) for r in stemming.stems_of(words).collect()) == [("ring", "ring"), ("rings", "ring")]


def test_web_queries():
    assert search.web_query('"red rings" -bolts or Süß gears') == [[(False, [(0, "red"), (1, "ring")]), (True, [(0, "bolt")])], [(False, [(0, "sus")]), (False, [(0, "gear")])]]
    assert search.web_query('"lord of the rings" the') == [[(False, [(0, "lord"), (3, "ring")])]]
    assert search.web_query("-only") == [] and search.web_query("") == [] and search.web_query("of the") == []


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "red big ring", ""), (2, "red ring", ""), (3, "ring", "red"), (4, "ring red ring", ""), (5, "red", "")], "id int, a string, b string")
    got = {r.id: r.score for r in search.web_matches(search.term_positions(docs, "id", {"a": "A", "b": "B"}), "id", "red ring").collect()}
    # A cover of n terms counts n / (sum of inverse weights) / (1 + words between).
    assert got == pytest.approx({1: 0.5, 2: 1.0, 3: 2 / 3.5, 4: 2.0})


ROWS = [(1, "The Lord of the Rings", "Tolkien"), (2, "Ring", "Nakata"), (3, "Lord Jim", "Brooks"), (4, "The lord and ring", None), (5, None, None), (6, "Rings of lords, rings", "the"), (7, "Äpfel ringing", "")]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(ROWS, "id long, title string, maker string")
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/index"
    return TextIndex.write(spark, {"work": Entity(docs, "id", {"title": "A", "maker": "B"}), "other": Entity(docs, "id", {"maker": "A"})}, path)


def test_postings(index):
    got = {(r.term, r.id): r.places for r in index.lookup("work", ["ring", "lord", "nakata"]).collect()}
    assert got == {("lord", "1"): [4], ("ring", "1"): [16], ("ring", "2"): [0], ("nakata", "2"): [5], ("lord", "3"): [0], ("lord", "4"): [4], ("ring", "4"): [12], ("ring", "6"): [0, 12], ("lord", "6"): [8], ("ring", "7"): [4]}
    assert index.lookup("other", ["ring"]).count() == 0 and index.lookup("work", ["the"]).count() == 0


@pytest.mark.parametrize("query, ids", [("rings", [1, 2, 4, 6, 7]), ('"lord of the ring"', [1]), ("ring -lords", [2, 7]), ('"rings of lord" or brook', [3, 6]), ("apfel", [7]), ("the", [])])
def test_queries_of_the_index(index, query, ids):
    found = search.web_matches(index.positions("work", "id", search.web_terms(query)), "id", query)
    assert sorted(r.id for r in found.collect()) == ids


def test_lookups_read_only_their_ranges(index):
    plan = index.lookup("work", ["ring", "lord"])._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "head" in line.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in line.split("PushedFilters")[1]
    files = index.lookup("work", ["ring", "lord"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {os.path.basename(os.path.dirname(r.f)) for r in files} == {"head=ri", "head=lo"}


def test_an_index_is_written_again_when_its_table_changes(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/t"
    spark.createDataFrame([(1, "ring")], "id long, title string").write.parquet(path)
    one = lambda: kept_index(spark, "t", [spark.read.parquet(path)], {"t": Entity(spark.read.parquet(path), "id", {"title": "A"})})
    first = one()
    assert one().path == first.path
    spark.createDataFrame([(2, "rings")], "id long, title string").write.mode("append").parquet(path)
    assert one().path != first.path and sorted(r.id for r in one().lookup("t", ["ring"]).collect()) == ["1", "2"]


def test_cover_density_of_many_hits(spark):
    docs = spark.createDataFrame([(1, "red ring " * 4000)], "id int, a string")
    (got,) = search.web_matches(search.term_positions(docs, "id", {"a": "A"}), "id", "red ring").collect()
    assert got.score == pytest.approx(7999)


def random_titles(n, seed):
    rng = random.Random(seed)
    syllables = "ka lo mi ren tas vo shi dun pel gra nor bex quo fal zim hor ust ine ory ack".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    for t in titles[: n // 4]:
        # Some with a few letters changed, left out or put in.
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "x", "ab" + t[at]]) + t[at + 1 :]
        titles.append(t)
    return sorted({t for t in titles if t.strip()} | {"a", "b", "ab", "abc", "abd", "aaaa", "aaaaa", "aaaab"})


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.8, 1.0])
def test_edit_pairs_are_those_of_all_pairs(spark, least):
    titles = random_titles(180, 4)
    df = spark.createDataFrame([(t,) for t in titles] * 2 + [(None,), ("",)], "t string")
    got = {(r.a, r.b): r.similarity for r in joins.edit_pairs(df, "t", least).collect()}
    want = {(a, b): s for i, a in enumerate(titles) for b in titles[i + 1 :] if (s := 1 - levenshtein(a, b) / max(len(a), len(b))) >= least}
    assert got == pytest.approx(want) and (len(want) > 10 or least == 1)


@pytest.mark.parametrize("least, meet", [(0.3, 2), (0.4, 1), (0.43, 3), (0.7, 2), (1.0, 2)])
def test_set_pairs_are_those_of_all_pairs(spark, least, meet):
    titles = random_titles(150, 6)
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(titles)] + [(None, 1)], "t string, half int")
    sets = df.select("t", "half", search.trigrams(F.col("t")).alias("s"))
    held = {r.t: set(r.s or []) for r in sets.collect()}
    share = lambda a, b: len(held[a] & held[b]) / len(held[a] | held[b])
    want = {(a, b): share(a, b) for i, a in enumerate(titles) for b in titles[i + 1 :] if held[a] and share(a, b) >= least}
    met = joins.set_candidates(sets, "t", "s", least, meet=meet).select(F.least("a", "b"), F.greatest("a", "b")).collect()
    assert set(want) <= {tuple(r) for r in met} and (len(want) > 10 or least == 1)
    if meet == 2:
        assert {(r.a, r.b): r.similarity for r in joins.set_pairs(sets, "t", "s", least).collect()} == pytest.approx(want)
        halves = {t: i % 2 for i, t in enumerate(titles)}
        assert {(r.a, r.b) for r in joins.set_pairs(sets, "t", "s", least, ["half"]).collect()} == {p for p in want if halves[p[0]] == halves[p[1]]}


def test_few_pairs_are_candidates(spark):
    """Random titles of the same 20 syllables, which have more in common than real ones."""
    titles = random_titles(3000, 8)
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    all_pairs = len(titles) * (len(titles) - 1) / 2
    assert joins.edit_candidates(df, "t", 0.8).count() < 0.02 * all_pairs
    sets = df.select("t", search.numbered_bigrams(F.col("t")).alias("s"))
    assert joins.set_candidates(sets, "t", "s", joins.dice_to_share(0.85)).count() < 0.02 * all_pairs


def test_membership(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "id long, t string")
    reps, members = joins.classes(rows, "id", "t")
    assert sorted(tuple(r) for r in reps.select("t", "rep").collect()) == [("x", 1), ("y", 3), ("z", 4)]
    pairs = spark.createDataFrame([(1, 3)], "a long, b long")
    assert sorted(tuple(r) for r in joins.membership(members, "id", pairs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)]


def test_near_words_are_those_of_all_words(spark):
    """Deletions for few edits, pieces for more; against the whole vocabulary times all terms."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 18))) for _ in range(300)} | {"a", "ab", "supplier000003", "suppliers00003x"})
    asked = []
    for w in words[::6]:
        at = rng.randrange(len(w))
        asked.append(w[:at] + rng.choice(["", "x", "b" + w[at]]) + w[at + 1 :] or "z")
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    queries = spark.createDataFrame([("q", i, t) for i, t in enumerate(dict.fromkeys(asked))], "query string, k int, term string")
    got = {(r.term, r.word): r.edits for r in fuzzy_index.near_words(vocabulary, queries).collect()}
    most = lambda t: min(6, int(0.3 * len(t) + 0.5))
    want = {(t, w): d for t in set(asked) for w in words if most(t) and (d := levenshtein(t, w)) <= most(t)}
    assert sorted(got.items() - want.items())[:5] == [] and sorted(want.items() - got.items())[:5] == [] and len(want) > 50


def test_few_words_meet_a_term(spark):
    words = sorted({w for t in random_titles(2000, 2) for w in t.split()})
    index = fuzzy_index.deletion_index(spark.createDataFrame([(w,) for w in words], "word string"))
    term = spark.createDataFrame([("renvoshi",)], "term string").select(F.explode(fuzzy_index.rests(F.col("term"), 2)).alias("rest"))
    assert index.join(term, "rest").select("word").distinct().count() < 0.02 * len(words)


def test_contained_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    inner, outer = texts[::2] + ["zz", "zzzz", "é"], texts[1::2] + ["xzzx", "éé"]
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts] + [(None,), ("",)], "t string")
    got = {(r.inner, r.outer) for r in joins.contained_pairs(frame(inner), frame(outer), "t").collect()}
    assert got == {(a, b) for a in inner for b in outer if a in b} and len(got) > 50
    assert "NestedLoop" not in joins.contained_pairs(frame(inner), frame(outer), "t")._jdf.queryExecution().executedPlan().toString()
