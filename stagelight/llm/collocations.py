"""Phrase collocations from depth-limited count tries.

Each word begins a path of up to `longest` words within its piece; a trie of these paths counts every phrase by the paths that
pass through it. A task cuts its texts into shards of SHARD words, and writes each shard's trie as its leaves in order: the
words in byte order, and the paths as places among them. Prefix ranges, chosen from a bounded sample of paths so that they
hold about RANGE leaves each, cut a shard's leaves into rows; the rows of a range meet in one task, which merges the sorted
leaves. Only where ranges fall depends on the sample, no count does. A hot phrase is one leaf a shard.

A prefix whose leaves lie in several ranges is counted by each shard before the cut, and its count goes with every range it
reaches, so a range's task knows the whole count of each node it walks and of its ancestors, the left parts. A node's suffix
link leads to the phrase without its first word; the right parts come by following it, one join for each depth. Nodes of a
smaller count than a candidate needs are no part of any, and go no further than the merge.

Arithmetic is in decimals of 38 digits: exact for counts up to 10**15. Null texts are empty; a null lang is `und`; repeated
rows count again; other columns are unread. A text of any length is cut between words before it is split, so that a task holds a shard
and one text. No words: no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

#: Words that count towards a phrase in one shard's trie, and leaves in a range, about.
SHARD, RANGE = 1 << 22, 1 << 20
#: Documents, and places of each, from which the ranges are chosen.
SAMPLE, PLACES = 4000, 32
#: Bytes that are split into words at a time.
CHUNK = 1 << 20
END = b"."  # a mark between pieces: the full stop is in no word
_PARTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)

_GAP = re.compile(rb"[ \t]")

Path = tuple[bytes, ...]


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with END behind each piece; a long one by and by."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        to = gap.start() if gap else len(text)
        yield text[at:to].lower().translate(_PARTS).replace(b"\n", b" . ").split()
        at = to
    yield [END]


class Leaves:
    """Sorted distinct paths with counts. A path is `depth` places among the sorted words, from 1; 0 stands behind its end."""

    def __init__(self, words: list[bytes], paths: np.ndarray, counts: np.ndarray):
        """From paths (a row each) in any order, with repeats."""
        self.words = words
        bits = max(1, (len(words) + 1).bit_length())
        key, used = np.zeros(len(paths), np.uint64), 0
        for column in paths.T:
            if used + bits > 64:
                key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
                used = max(1, len(key).bit_length())
            key, used = (key << np.uint64(bits)) | column.astype(np.uint64), used + bits
        # A stable sort merges the shards' leaves, which come in order.
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.paths = paths[order[first]]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else counts[:0]

    def path(self, i: int) -> Path:
        return tuple(self.words[k - 1] for k in self.paths[i] if k)

    def place(self, path: Path) -> int:
        """How many leaves come before a path."""
        low, high = 0, len(self.paths)
        for depth, word in enumerate(path):
            column = self.paths[low:high, depth]
            k = bisect_left(self.words, word)
            there = k < len(self.words) and self.words[k] == word
            a = low + int(np.searchsorted(column, k + 1, "left"))
            b = low + int(np.searchsorted(column, k + 1, "right")) if there else a
            low, high = a, b
            if low == high:
                return low
        return low

    def total(self, prefix: Path) -> int:
        """Of how many paths this is a prefix."""
        a, b = self.place(prefix), self.place((*prefix[:-1], prefix[-1] + b"\0"))
        return int(self.counts[a:b].sum())


def prefixes(path: Path | None, depth: int) -> list[Path]:
    return [path[:k] for k in range(1, min(len(path) + 1, depth))] if path else []


def _edges(cuts: list[Path], i: int, depth: int) -> list[Path]:
    """The prefixes that range i may share with others: those of the paths that bound it."""
    low, high = cuts[i - 1] if i else None, cuts[i] if i < len(cuts) else None
    return [*prefixes(low, depth), *(p for p in prefixes(high, depth) if p not in prefixes(low, depth))]


class Shard:
    """The words of one language that a task has met since it last wrote a trie."""

    def __init__(self, depth: int):
        self.depth, self.held, self.size = depth, [], 0
        self.places: defaultdict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.places[END]

    def add(self, words: list[bytes]) -> None:
        self.held.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def leaves(self) -> Leaves:
        met = list(self.places)[1:]
        order = sorted(range(len(met)), key=met.__getitem__)
        rank = np.zeros(len(met) + 1, np.uint32)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(met) + 1)
        line = np.concatenate([rank[x] for x in self.held] + [np.zeros(self.depth, np.uint32)])
        n = len(line) - self.depth
        columns = [line[:n]]
        for k in range(1, self.depth):
            columns.append(np.where(columns[-1] > 0, line[k : n + k], 0))
        paths = np.stack(columns, axis=1)[line[:n] > 0]
        return Leaves([met[i] for i in order], paths, np.ones(len(paths), np.int64))


_ROW = "lang string, range int, words binary, paths binary, counts binary, edges array<bigint>"
_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("words", pa.binary()), ("paths", pa.binary()), ("counts", pa.binary()), ("edges", pa.list_(pa.int64()))])
_NODE = "lang string, depth int, phrase string, a bigint, lefts array<bigint>"


def _rows(lang: str, leaves: Leaves, cuts: list[Path], depth: int) -> Iterator[dict]:
    """A shard's leaves, cut into ranges, with the counts of the prefixes that a range may share."""
    places = [0, *(leaves.place(c) for c in cuts), len(leaves.paths)]
    for i in range(len(cuts) + 1):
        edges = [leaves.total(p) for p in _edges(cuts, i, depth)]
        paths, counts = leaves.paths[places[i] : places[i + 1]], leaves.counts[places[i] : places[i + 1]]
        if len(paths) or any(edges):
            used = np.zeros(len(leaves.words) + 1, bool)
            used[paths.ravel()] = True
            used[0] = True
            small = (np.cumsum(used) - 1).astype(np.uint32)[paths]
            words = b"\n".join(leaves.words[k - 1] for k in np.flatnonzero(used)[1:].tolist())
            yield {"lang": lang, "range": i, "words": words, "paths": small.T.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "edges": edges}


def _shards(docs: DataFrame, cuts: dict[str, list[Path]], depth: int, size: int) -> DataFrame:
    """The rows of all shards' tries."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            for row in _rows(lang, shards.pop(lang).leaves(), cuts.get(lang, []), depth):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, lang in enumerate(batch.column(0).to_pylist()):
                ended = True
                for words in tokens(texts[i].as_py() or b""):
                    # A shard ends with a piece, so that no path is cut.
                    if lang in shards and shards[lang].size >= size and ended:
                        yield from flush(lang)
                    shards.setdefault(lang, Shard(depth)).add(words)
                    ended = words[-1:] == [END]
        for lang in list(shards):
            yield from flush(lang)

    return docs.mapInArrow(written, _ROW)


def _merge(pdf: pd.DataFrame, cuts: dict[str, list[Path]], depth: int, least: int) -> pd.DataFrame:
    """The nodes of one range with at least `least` paths, each with the counts of its ancestors; and the range's share of all paths."""
    lang, i = pdf["lang"].iloc[0], int(pdf["range"].iloc[0])
    split = [w.split(b"\n") if w else [] for w in pdf["words"]]
    words = sorted(set().union(*split))
    at = {w: k for k, w in enumerate(words, 1)}
    paths, counts = [], []
    for ws, p, c in zip(split, pdf["paths"], pdf["counts"], strict=True):
        rank = np.fromiter((0, *(at[w] for w in ws)), np.uint32, len(ws) + 1)
        paths.append(rank[np.frombuffer(p, np.uint32).reshape(depth, -1).T])
        counts.append(np.frombuffer(c, np.uint32).astype(np.int64))
    leaves = Leaves(words, np.concatenate(paths), np.concatenate(counts))
    bounds = cuts.get(lang, [])
    names = _edges(bounds, i, depth)
    edges = dict(zip(names, np.array(list(pdf["edges"]), dtype=np.int64).reshape(len(pdf), len(names)).sum(axis=0).tolist(), strict=True))
    low, high = bounds[i - 1] if i else (), bounds[i] if i < len(bounds) else None
    # The walk: each depth's nodes are the runs of leaves with the same prefix.
    out: list[tuple[int, str, int, list[int]]] = [(0, "", int(leaves.counts.sum()), [])]
    above = np.zeros((len(leaves.paths), 0), np.int64)  # of each leaf, the counts of its ancestors
    new = np.zeros(len(leaves.paths), bool)
    new[:1] = True
    for d in range(1, depth + 1):
        column = leaves.paths[:, d - 1]
        new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(leaves.counts, first) if len(first) else leaves.counts[:0]
        inside = column[first] > 0
        names_of = {k: leaves.path(first[k])[:d] for k in {0, len(first) - 1} if 0 <= k < len(first)}
        for k, name in names_of.items():
            if inside[k] and name in edges:
                sums[k] = edges[name]
        for k in np.flatnonzero(inside & (sums >= least)).tolist():
            name = names_of.get(k) or leaves.path(first[k])[:d]
            if name not in edges:
                out.append((d, b" ".join(name).decode(), int(sums[k]), above[first[k]].tolist()))
        above = np.column_stack((above, np.repeat(sums, np.diff(np.append(first, len(new))))))
    # A shared prefix belongs to the range that its own place is in.
    for name, n in edges.items():
        if n >= least and low <= name and (high is None or name < high):
            out.append((len(name), b" ".join(name).decode(), n, [edges[name[:k]] for k in range(1, len(name))]))
    return pd.DataFrame([(lang, *row) for row in out], columns=["lang", "depth", "phrase", "a", "lefts"])


def _cuts(docs: DataFrame, n: int, depth: int, per_range: int) -> dict[str, list[Path]]:
    """The paths at which each language's ranges begin, from a sample of at most some SAMPLE x PLACES paths."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, out = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), {"lang": [], "path": [], "weight": []}
            for i, lang in enumerate(langs):
                words = [w for part in tokens(texts[i].as_py() or b"") for w in part]
                picked = np.unique(np.linspace(0, len(words) - 1, PLACES).astype(int)).tolist()
                for k in picked:
                    path = words[k : k + depth]
                    path = path[: path.index(END)] if END in path else path
                    if path:
                        out["lang"].append(lang)
                        out["path"].append(b"\n".join(path))
                        out["weight"].append(len(words) / len(picked))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("path", pa.binary()), ("weight", pa.float64())]))

    share = min(1.0, SAMPLE / max(1, n))
    met: dict[str, list[tuple[Path, float]]] = defaultdict(list)
    for r in docs.sample(share, 11).mapInArrow(sampled, "lang string, path binary, weight double").toLocalIterator():
        met[r.lang].append((tuple(bytes(r.path).split(b"\n")), r.weight))
    cuts = {}
    for lang, paths in met.items():
        paths.sort()
        weights = np.cumsum([w for _, w in paths])
        ranges = int(np.ceil(weights[-1] / share / per_range))
        steps = weights[-1] * np.arange(1, ranges) / max(1, ranges)
        cuts[lang] = sorted({paths[k][0] for k in np.searchsorted(weights, steps).tolist()})
    return cuts


def counted(docs: DataFrame, longest: int = 3, least: int = 10, shard: int = SHARD, per_range: int = RANGE) -> DataFrame:
    """lang, depth, phrase, a (its count), lefts (the counts of its first words); of depth 0 parts of each language's number of words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    cuts = _cuts(texts, texts.count(), longest, per_range)
    rows = _shards(texts, cuts, longest, shard)
    # As many partitions as ranges, where those are more than the session's: a task's rows do not grow with the input.
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(usual, sum(len(c) + 1 for c in cuts.values())), "lang", "range")
    return rows.groupBy("lang", "range").applyInPandas(lambda pdf: _merge(pdf, cuts, longest, least), _NODE)


def _rest(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, instr({phrase}, ' ') + 1)")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = "decimal(19,0)"
    top = F.lit(1_000_000).cast("decimal(7,0)") * (a.cast(wide) * a.cast(wide)).cast("decimal(31,0)")
    return F.call_function("div", top, left.cast(wide) * right.cast(wide))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, best: int = 2000, shard: int = SHARD, per_range: int = RANGE) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score, and cut, the words before the weakest place."""
    nodes = durable(counted(docs, longest, least, shard, per_range), "nodes")
    total = nodes.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    linked = nodes.where("depth = 1").select("lang", "phrase", "a", F.expr("cast(array() as array<bigint>)").alias("lefts"), F.expr("cast(array() as array<bigint>)").alias("rights"))
    phrases = []
    for d in range(2, longest + 1):
        rest = linked.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.concat(F.array("a"), "rights").alias("rights"))
        here = nodes.where(F.col("depth") == d).withColumn("_rest", _rest("phrase"))
        linked = here.join(rest, (F.col("lang") == F.col("_l")) & (F.col("_rest") == F.col("_p"))).select("lang", "phrase", "a", "lefts", "rights")
        phrases.append(linked.withColumn("size", F.lit(d)))
    every = phrases[0]
    for more in phrases[1:]:
        every = every.unionByName(more)
    every = durable(every, "phrases")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = every.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    cuts = F.array_min(
        F.transform(F.arrays_zip("lefts", "rights"), lambda x, i: F.struct(_score(F.col("a"), x["lefts"], x["rights"]).alias("score"), (i + 1).alias("cut"), x["lefts"].alias("l"), x["rights"].alias("r")))
    )
    kept = every.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < within * F.col("a"), F.lit(True)))
    scored = kept.select("lang", "phrase", "a", cuts.alias("best")).select("lang", "phrase", "a", "best.*")
    # Only the best of each partition reach the window.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


OP11_SQL = r"""
with words as (
  select doc, piece, coalesce(lang, 'und') lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') w
  from (select doc, lang, unnest(pieces) p, generate_subscripts(pieces, 1) piece
        from (select row_number() over () doc, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') pieces from documents))
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) i from words
), f as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) a from places, (values (1), (2), (3)) as s(k) where i + k - 1 <= len(w) group by all
), n as (
  select lang, sum(a)::bigint n from f where k = 1 group by lang
), cand as (
  select *, string_split(phrase, ' ') w from f where k >= 2 and a >= 10
), parts as (
  select lang, phrase, a, k, j, array_to_string(w[1:j], ' ') lp, array_to_string(w[j + 1:], ' ') rp from cand, (values (1), (2)) as s(j) where j < k
), often as (
  select lang, phrase, a from f where a >= 10
), cut as (
  select c.lang, c.phrase, c.a, c.k, j, l.a l, r.a r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) score
  from parts c join often l on l.lang = c.lang and l.phrase = c.lp join often r on r.lang = c.lang and r.phrase = c.rp
), best as (
  select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1
), inside as (
  select lang, p phrase, max(a) a from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) p from cand where k = 3) group by all
)
select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, n.n, b.score::bigint score
from best b join n using (lang) left join inside i on i.lang = b.lang and i.phrase = b.phrase and b.k = 2
where i.a is null or 100 * i.a < 50 * b.a
qualify row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) <= 2000
"""
