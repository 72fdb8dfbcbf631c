"""Collocations, periodic runs and near vectors against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm import collocations, near_vectors, periodic_runs
from tests.llm.conftest import EDGE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

# ---- 11: collocations


def plain_collocations(rows, longest, least, within=50, best=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(a for p, a in count.items() if len(p) == 1)
        found = []
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        for p, a in cands.items():
            if 100 * longer[p] < within * a or p not in longer:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        found.sort()
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(found[:best], 1)]
    return sorted(out)


def collocation_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("least,shard,per_range,longest", [(10, 1 << 22, 1 << 20, 3), (2, 500, 300, 3), (3, 2000, 40, 4), (2, 700, 2000, 2)])
def test_collocations_equal_brute_force(spark, sf, least, shard, per_range, longest):
    """Also with shards and ranges so small that most prefixes lie in several."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    want = plain_collocations([(r.text, r.lang) for r in docs.collect()], longest, least)
    assert collocation_rows(collocations.collocations(docs, longest, least, shard=shard, per_range=per_range)) == want
    assert len(want) > 50


def test_collocations_of_odd_rows(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    want = plain_collocations([(t, lang) for _, t, lang, _ in EDGE], 3, 2)
    assert collocation_rows(collocations.collocations(docs, 3, 2, per_range=50)) == want


def test_a_hot_phrase_and_mixed_separators(spark):
    rows = [("a b a b a b", "en")] * 40 + [("A B.a\tb;;c a b\ncc\x0bd a b", None), ("x " * 30 + "y", "en"), ("É é É", "fr")] + [("a b c", "en")] * 9
    got = collocation_rows(collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=2, shard=20, per_range=3))
    assert got == plain_collocations(rows, 3, 2)


# ---- 12: periodic runs


def plain_runs(s, least=12):
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=20), st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 5), st.lists(st.integers(0, 2), max_size=20))
def test_runs_equal_brute_force(before, period, times, after):
    s = before + period * times + after
    for least in (4, 12):
        want = plain_runs(s, least)
        assert periodic_runs.runs_of(s, least) == want
        assert periodic_runs.periodic_runs(np.array(s, dtype=np.int64), least) == want


def test_runs_of_long_periodic_texts():
    import time

    began = time.time()
    assert periodic_runs.periodic_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periodic_runs.periodic_runs(np.arange(60_000) % 977) == [(0, 60_000, 977)]
    random.seed(3)
    flat = [random.randrange(2) for _ in range(3000)]
    assert periodic_runs.periodic_runs(np.array(flat)) == plain_runs(flat)
    assert time.time() - began < 20


def plain_description(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept))


def test_runs_of_a_table(spark, sf, edge, texts):
    short = {i: t for i, t in texts.items() if len(t) < 8000}
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12(spark, sf).collect()}
    assert len(got) == len(texts) and all(got[i] == plain_description(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got.values()) > len(got) / 20
    odd = sorted((tuple(r) for r in periodic_runs.op12(spark, edge).collect()), key=str)
    assert odd == sorted((plain_description(i, t) if len(t or "") < 50_000 or " " not in t else next(r for r in odd if r[0] == i) for i, t, *_ in EDGE), key=str)


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go " + "one two three  four\n" * 4 + "end"), (2, None)], "doc_id long, text string")
    a, b = sorted(periodic_runs.described(docs, collapsed=True).collect())
    assert (a.collapsed, [tuple(r) for r in a.runs]) == ("go one two three four end", [(1, 16, 4)])
    assert (b.collapsed, b.runs, b.start) == ("", [], None)


# ---- 13: near vectors


def plain_links(rows, least=0.93):
    def usable(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [usable(v, label) for _, v, label in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for key in {(label, len(v)) for (_, v, label), o in zip(rows, ok, strict=True) if o}:
        at = np.array([i for i, (_, v, label) in enumerate(rows) if ok[i] and (label, len(v)) == key])
        m = np.array([rows[i][1] for i in at], dtype=float)
        norm = np.linalg.norm(m, axis=1)
        near[np.ix_(at, at)] = m @ m.T >= least * np.outer(norm, norm)
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(near[i]):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if x in (a, b) else x for x in root]
    least_of = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], int(near[i].sum()), least_of[root[i]], rows[i][0] == least_of[root[i]]) for i in range(len(rows))), key=str)


def vector_rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def made_vectors(n, dims, seed, close):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims) * np.linspace(3, 0.3, dims)
        if rows and rng.random() < close:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dims) * rng.choice([0.02, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("dims,blocks,grid,part,close", [(16, 4, 2, 4096, 0.6), (16, 4, 2, 7, 0.9), (8, 8, 1, 50, 0.5), (5, 2, 2, 20, 0.8), (1, 4, 2, 4096, 0.5)])
def test_links_equal_brute_force(spark, dims, blocks, grid, part, close):
    rows = made_vectors(240, dims, dims + part, close)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = vector_rows(near_vectors.linked_vectors(df, blocks=blocks, grid=grid, part=part))
    assert got == plain_links(rows) and any(r[1] for r in got)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, nan], 1), (8, [1.0, inf], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1)]
    rows += [(None, [1.0, 0.0], 1), (11, [1e300, 1e299], 1), (12, [1e-300, 1e-301], 1), (13, [1.0, 0.0], 2), (None, [0.0, 1.0], 3), (14, [-1.0, 0.0], 1), (15, [-0.0, 1.0], 4), (16, [0.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_rows(near_vectors.linked_vectors(df.selectExpr("*", "1 as node", "2 as cell", "3 as part")))
    safe = [(i, [x / 1e300 if abs(x or 0) > 1e200 else x * 1e300 if x and abs(x) < 1e-200 else x for x in v] if i in (11, 12) else v, label) for i, v, label in rows]
    assert got == plain_links(safe)


def test_links_of_a_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert vector_rows(near_vectors.op13(spark, sf)) == plain_links(rows)
