"""Periodic runs: maximal stretches of a text in which words q apart are identical, at least LEAST words and two periods long.

A run of smallest period q and length L makes the words of its first L - q places end again q places further on, and no longer
common suffix does. In the suffix automaton these two ends come together first in the state whose longest string has just that
length, and there they are neighbours. So the ordered sets of end positions are merged up the suffix links, each smaller set
into the larger one, and a new pair of neighbours no further apart than the state's length is the seed of a square: the
stretch behind it has reached its left end. The seeds of a run follow each other to the right, one place at a time; the last
of them, after which the words differ, has the run's right end too. So a run costs as many looks as it has seeds.

A run holds each of its six-word strings twice, less than half of its length apart. So the automaton is built only over the
stretches that such repeats cover, found by sorting hashes; false hits among hashes cost time, never a run. Texts are
independent: nothing is shuffled, a text is read whole, and one of n words costs n log n steps at most in the merging of sets,
with some 700 bytes a word of a covered stretch.

Null and empty texts have no words and no runs. Repeated rows are judged one by one; a null doc_id is kept. Other columns are
left out, so that their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runs import Runs

LEAST = 12
#: A run of LEAST words or more holds every string of so many words twice.
SEED = LEAST // 2
#: Rounds of cutting down to what repeats within its own stretch; more would only save more time.
ROUNDS = 4
#: Rows taken from a batch at a time.
SLICE = 256
BLOCK = 512

Run = tuple[int, int, int]


class Ends:
    """An ordered set of places, in blocks, so that adding one moves few."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, place: int):
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Add a new place; its neighbours."""
        blocks, tops = self.blocks, self.tops
        at = min(bisect_left(tops, place), len(blocks) - 1)
        block = blocks[at]
        i = bisect_left(block, place)
        before = block[i - 1] if i else (tops[at - 1] if at else None)
        after = block[i] if i < len(block) else None
        block.insert(i, place)
        if after is None:
            tops[at] = place
        self.size += 1
        if len(block) > 2 * BLOCK:
            blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            tops[at : at + 1] = [block[BLOCK - 1], block[-1]]
        return before, after


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: the length of its longest string, its suffix link, and the place it was made for or -1."""
    follow: list[dict[int, int]] = [{}]
    length, link, place = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(symbols):
        new = len(length)
        follow.append({})
        length.append(i + 1)
        link.append(0)
        place.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                place.append(-1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, place


def runs_of(symbols: list[int], least: int = LEAST) -> list[Run]:
    """All runs (start, length, smallest period) of a sequence, in order."""
    n = len(symbols)
    if n < least:
        return []
    length, link, place = automaton(symbols)
    ends: list[Ends | None] = [Ends(p) if p >= 0 else None for p in place]
    found: dict[tuple[int, int], int] = {}
    for v in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        p, mine = link[v], ends[v]
        # A seed's stretch has the state's length and a period not above it: shorter states have none of the least length.
        if p < 0 or mine is None or 2 * length[p] < least:
            continue
        ends[v] = None
        held = ends[p]
        if held is None:
            ends[p] = mine
            continue
        if held.size < mine.size:
            held, mine = mine, held
        reach, last = length[p], None
        for end in mine:
            before, after = held.add(end)
            # Two ends out of the same set have met before, in a longer string.
            pairs = ((None if before == last else before, end), (end, after))
            last = end
            for low, high in pairs:
                if low is not None and high is not None and high - low <= reach:
                    if high + 1 < n and symbols[high + 1] == symbols[low + 1]:
                        continue  # the run's last pair of ends gives all of it
                    start, period = low - reach + 1, high - low
                    if high + 1 - start >= least:
                        key = (start, high + 1 - start)
                        found[key] = min(period, found.get(key, period))
        ends[p] = held
    return sorted((start, size, period) for (start, size), period in found.items())


def covered(ids: np.ndarray, seed: int = SEED) -> list[tuple[int, int]]:
    """The stretches of a text (start, end) that strings of `seed` words cover which occur again in the same stretch."""
    if len(ids) < 2 * seed:
        return []
    at = np.arange(len(ids) - seed + 1)
    hashes, stretch = Runs(ids).all(seed), np.zeros(len(at), np.uint64)
    parts: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        keys = hashes[at] ^ (stretch * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        left = at[twice]
        if not len(left):
            return []
        # Strings that overlap or touch are one stretch.
        new = np.concatenate(([True], np.diff(left) > seed))
        stretch = np.cumsum(new).astype(np.uint64)
        first = np.flatnonzero(new)
        lasts = left[np.append(first[1:], len(left)) - 1]
        parts = [(a, b) for a, b in zip(left[first].tolist(), (lasts + seed).tolist(), strict=True)]
        if len(left) == len(at):
            break
        at = left
    return parts


def periodic_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs of a text's words, given as numbers."""
    found: list[Run] = []
    for start, end in covered(ids, least // 2):
        found += [(start + s, n, q) for s, n, q in runs_of(ids[start:end].tolist(), least)]
    return found


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


_COLUMNS = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_MORE = [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())]
Judge = Callable[[object, np.ndarray], np.ndarray]


def described(docs: DataFrame, reorder: Judge | None = None, collapsed: bool = False) -> DataFrame:
    """A row per document: doc_id, n_runs, the greatest run, runs_sha256, collapsed_sha256; with `collapsed` also runs and the collapsed text.

    `reorder` says which word stands at each place, given doc_id and the places; by default each stands at its own.
    """
    kind = next(f for f in docs.schema.fields if f.name == "doc_id").dataType.simpleString()
    more = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if collapsed else ""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), *_COLUMNS, *(_MORE if collapsed else [])])
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names: defaultdict[bytes, int] = defaultdict()
                names.default_factory = names.__len__
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = (text or b"").split()
                    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
                    if reorder is not None:
                        places = reorder(doc_id, np.arange(len(words)))
                        ids, words = ids[places], [words[i] for i in places.tolist()]
                    runs = periodic_runs(ids)
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    if runs:
                        words = [w for w, gone in zip(words, dropped(len(words), runs).tolist(), strict=True) if not gone]
                    text = b" ".join(words)
                    row = {
                        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
                        "runs_sha256": hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest(),
                    }
                    if collapsed:
                        row |= {"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": text.decode()}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    made = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}"
    return docs.select("doc_id", "text").mapInArrow(judged, made)


def wound(doc_id: object, places: np.ndarray) -> np.ndarray:
    """The query's own change of one document in ten: from some place on, its words go round with a period. A null doc_id changes nothing."""
    n, h = len(places), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return places
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.where(places >= a, a + (places - a) % period, places)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark.read.parquet(f"{sf_dir}/documents.parquet"), wound)
