"""Near-duplicate vectors by a pigeonhole join over subspaces.

Two vectors of the same label link where their cosine is at least `least`; their directions are then no further apart than
2 - 2 x least in squared distance. All directions are turned by one orthogonal matrix and their coordinates dealt into BLOCKS
blocks. Each block has a budget, its share of that squared distance in proportion to the variance it holds; of a linked pair
at least one block's distance is within its budget. So each block is joined by range in a grid of its GRID widest directions:
cells are twice the radius wide, a row is at home in one and visits those after it that its radius reaches. Inside a task the
pairs within the block's budget are candidates, and each is verified on the whole vectors, in double precision, by the first
block that finds it. The matrix turns the principal axes of a bounded sample; results do not depend on it.

Equal vectors of a label are one node, by 128 bits of hash; nodes count for all their rows. A cell with more than PART rows
is dealt into parts, and every two parts meet in a task of their own: rows grow with a dense cell's rows times its parts, and
no pair is ever a row. A task gives sums of links and a spanning forest of its links, from which components come.

Vectors link with nothing that are null or of length zero, hold null or non-finite components, or have a null label; so do those
of different length. Flat data (no direction wider than another) leaves large cells: then the join is a blocked comparison
of each label's vectors. Rows alike are judged alike, also with a null vec_id, which is no smallest one. Other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, salted_join
from .components import components

BLOCKS, GRID = 4, 2
#: Vectors to fit the axes on, and rows of a cell that meet in one task, about.
SAMPLE, PART = 20_000, 4096
#: Rows that are held against a part at a time.
STEP = 512
#: What rounding may add to a distance between directions.
SLACK = 1e-9


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def axes(sample: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The turning matrix, each block's columns of it, widest first, and each block's share of the variance."""
    dims = sample.shape[1]
    variance, turn = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims) if len(sample) > 1 else np.eye(dims))
    order = np.argsort(-variance)
    blocks = min(blocks, dims)
    # Dealt to and fro, so that each block has a like share.
    dealt = [[] for _ in range(blocks)]
    for i, column in enumerate(order.tolist()):
        k = i % (2 * blocks)
        dealt[k if k < blocks else 2 * blocks - 1 - k].append(column)
    variance = np.maximum(variance, 0) + 1e-6
    held = np.array([variance[d].sum() for d in dealt])
    return turn, [np.array(d) for d in dealt], held / held.sum()


class Join:
    """The join's fixed figures for vectors of one length."""

    def __init__(self, sample: np.ndarray, least: float, blocks: int, grid: int):
        self.least, self.grid = least, grid
        self.turn, self.blocks, share = axes(sample, blocks)
        self.budgets = (2 - 2 * least) * share + SLACK

    def turned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Turned directions, and the vectors scaled so that squares keep in range."""
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ self.turn, scaled

    def cells(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, str, bool]]:
        """block, rows, cell of each, and whether they visit it only."""
        for b, columns in enumerate(self.blocks):
            radius = float(np.sqrt(self.budgets[b]))
            wide = turned[:, columns[: self.grid]]
            home = np.floor(wide / (2 * radius)).astype(np.int64)
            rest = wide - home * 2 * radius
            every = np.arange(len(turned))
            yield b, every, self._names(home), False
            for step in np.ndindex(*(3,) * wide.shape[1]):
                move = np.array(step) - 1
                if tuple(move) <= (0,) * len(move):
                    continue  # each two cells meet in the later one
                gap = np.where(move > 0, 2 * radius - rest, np.where(move < 0, rest, 0.0))
                near = (gap**2).sum(axis=1) <= self.budgets[b] + SLACK
                if near.any():
                    yield b, every[near], self._names(home[near] + move), True

    @staticmethod
    def _names(cells: np.ndarray) -> list[str]:
        return [",".join(map(str, c)) for c in cells.tolist()]

    def linked(self, block: int, a: tuple, b: tuple) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of a, in order, the rows of b that link with it and that no earlier block finds. Both: turned, scaled, lengths."""
        for at in range(0, len(a[0]), STEP):
            x, xs, xn = (v[at : at + STEP] for v in a)
            y, ys, yn = b
            i, j = np.nonzero(self._within(x, y, block))
            if len(i):
                # Candidates in slices, verified on whole vectors; pairs that an earlier block finds are its own.
                keep = []
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    ok = np.einsum("ij,ij->i", xs[p], ys[q]) >= self.least * xn[p] * yn[q]
                    for e in range(block):
                        d = x[p][:, self.blocks[e]] - y[q][:, self.blocks[e]]
                        ok &= (d * d).sum(axis=1) > self.budgets[e]
                    keep.append(ok)
                ok = np.concatenate(keep)
                i, j = i[ok], j[ok]
            ends = np.searchsorted(i, np.arange(len(x) + 1))
            for r in range(len(x)):
                yield at + r, j[ends[r] : ends[r + 1]]

    def _within(self, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        c = self.blocks[block]
        u, v = x[:, c], y[:, c]
        d = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (u @ v.T)
        return d <= self.budgets[block] + SLACK


class _Forest:
    """Which of a task's rows are connected already; only links that connect are given."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """One of `others` for each part that i was apart from."""
        parts, first = np.unique(self.root[others], return_index=True)
        apart = parts != self.root[i]
        if not apart.any():
            return []
        met = np.append(parts[apart], self.root[i])
        self.root[np.isin(self.root, met)] = met.min()
        return others[first[apart]].tolist()


_CELL = "label string, dims int, block int, cell string, visits boolean, node long, copies long, vector "


def _meet(pdf: pd.DataFrame, joins: dict[int, Join]) -> pd.DataFrame:
    """Of two parts of a cell: sums of links (a, null, n), and a spanning forest of the links (a, b, 0)."""
    join, block = joins[int(pdf["dims"].iloc[0])], int(pdf["block"].iloc[0])
    # Rows of both parts in one order; what is compared are two runs of it.
    pdf = pdf.sort_values(["part", "visits", "node"], kind="stable")
    vectors = np.stack(list(pdf["vector"])).astype(float)
    turned, scaled = join.turned(vectors)
    lengths = np.linalg.norm(scaled, axis=1)
    nodes, copies, visits, part = (pdf[c].to_numpy() for c in ("node", "copies", "visits", "part"))
    first = part == pdf["p"].to_numpy()
    same = bool(pdf["p"].iloc[0] == pdf["q"].iloc[0])
    left = np.arange(len(pdf)) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
    links, forest, edges = np.zeros(len(pdf), np.int64), _Forest(len(pdf)), []
    side = lambda at: (turned[at], scaled[at], lengths[at])
    for r, found in join.linked(block, side(left), side(right)):
        i, others = left[r], right[found]
        others = others[~(visits[others] & visits[i])]
        if same:
            others = others[others > i]
        if len(others):
            links[i] += copies[others].sum()
            np.add.at(links, others, copies[i])
            edges += [(nodes[i], nodes[j]) for j in forest.join(i, others)]
    some = np.flatnonzero(links)
    return pd.DataFrame(
        {"a": np.append(nodes[some], [a for a, _ in edges]).astype("int64"), "b": pd.array([None] * len(some) + [b for _, b in edges], dtype="Int64"), "n": np.append(links[some], np.zeros(len(edges), np.int64)).astype("int64")}
    )


def linked_vectors(vectors: DataFrame, least: float = 0.93, blocks: int = BLOCKS, grid: int = GRID, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    # Single precision travels as it is; all arithmetic is in double.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    vector = F.col("embedding").cast(kind)
    keyed = vectors.select("vec_id", F.col("label").cast("string").alias("label"), vector.alias("vector"))
    usable = _usable(F.col("vector"), F.col("label"))
    keyed = keyed.withColumn("h", F.when(usable, F.xxhash64("vector"))).withColumn("g", F.when(usable, F.xxhash64(F.lit(7), "vector")))
    by = ["label", "h", "g"]
    nodes = keyed.where("h is not null").groupBy(*by).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    # The axes of a bounded sample; one matrix for each length of vectors.
    sample = nodes.select("vector").sample(min(1.0, SAMPLE / max(1, n)), 13).limit(2 * SAMPLE).toPandas()["vector"]
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    lengths = [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]
    joins = {}
    for d in lengths:
        held = np.array(by_length.get(d, []), dtype=float).reshape(-1, d)
        held = held / np.abs(held).max(axis=1, keepdims=True)
        joins[d] = Join(held / np.linalg.norm(held, axis=1, keepdims=True), least, blocks, grid)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby(pdf["vector"].map(len)):
                join = joins[d]
                turned, _ = join.turned(np.stack(list(rows["vector"])).astype(float))
                for b, at, cells, visits in join.cells(turned):
                    some = rows.iloc[at]
                    yield pd.DataFrame({"label": some["label"], "dims": d, "block": b, "cell": cells, "visits": visits, "node": some["node"], "copies": some["copies"], "vector": some["vector"]})

    rows = nodes.select("label", "node", "copies", "vector").mapInPandas(placed, _CELL + kind)
    cell = ["label", "dims", "block", "cell"]
    # Cells with one row, or with visitors alone, hold no pair.
    sizes = durable(rows.groupBy(*cell).agg(F.count("*").alias("rows"), F.count_if(~F.col("visits")).alias("homes")).where("rows > 1 and homes > 0"), "cells")
    sizes = sizes.select(*cell, F.ceil(F.col("rows") / part).cast("int").alias("parts"))
    dealt = rows.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    met = pairs.groupBy(*cell, "p", "q").applyInPandas(lambda pdf: _meet(pdf, joins), "a long, b long, n long")
    met = durable(met, "met")
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(met.where("b is not null").select("a", "b"))
    firsts = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    told = nodes.select(*by, "node", "first", "copies").join(links, "node", "left").join(roots.join(firsts, "root").select("node", "component_id"), "node", "left")
    told = told.select(*by, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    # A vector that a third of all rows share is dealt in parts.
    out = salted_join(keyed.select("vec_id", *by), F.xxhash64("vec_id"), durable(told, "told"), by)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
