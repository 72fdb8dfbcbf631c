"""Near-duplicates by MinHash with tensored banding.

A document's set is that of its hashed word shingles. Two small collections of HALF keys each, of ROWS minhashes, are
computed a set; every pair of one key from either makes a table key: HALF x HALF tables from 2 x HALF x ROWS minhashes. At a
similarity of 0.8 a pair shares no table with probability 2 x (1 - 0.8^3)^11 = 0.0007, at 0.9 with 1e-6.

Documents with equal sets are one node, found by grouping digests. Among the nodes of a bucket, the one whose keys meet the
most others is its anchor, and a node belongs to the star of each of its anchors: a few, since near copies share anchors.
First all members are held against their anchors on full sets. What is then in the anchor's component needs no more; any
other member of a star is held against all of the star, in blocks of bounded size. So every pair that shares a table is
either compared on full sets or already known to be connected; nothing is capped, and no bucket's pairs are emitted.

Components come from contraction of the links. Only (key, node) rows, digests and the sets of nodes that share a bucket are
shuffled. Null and empty texts have no shingles and link with nothing. A text with fewer words than a shingle is one shingle.
Rows alike in text fall into one group whatever their ids; null ids come last, and a group of null ids only has a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bloom, durable, fenced, probe, salted_join, settled, shield, text_of
from .components import components

HALF, ROWS = 11, 3
#: Shingles in a block of a star, about; a block is what one call holds.
BLOCK = 50_000
SEED = 9

_SIGNED = "n_shingles long, digest binary, a array<long>, b array<long>"
_draw = np.random.default_rng(SEED)
_FLIP = _draw.integers(0, 2**64, 2 * HALF * ROWS, dtype=np.uint64)
_TIMES = _draw.integers(0, 2**64, 2 * HALF * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(docs: DataFrame, words: int, name: str = "shingles") -> DataFrame:
    """docs with the array of the hashes of each text's runs of `words` words; null where there is no word."""
    df = fenced(docs, _h=F.transform(F.filter(F.split(ascii_lower(text_of()), SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n, run = F.size("_h"), F.col("_h")
    for k in range(1, words):
        left = F.greatest(n - k, F.lit(0))
        run = F.zip_with(F.slice(run, 1, left), F.slice("_h", k + 1, left), lambda a, b: F.xxhash64(a, b))
    whole = F.array(F.aggregate("_h", F.lit(17).cast("long"), lambda s, h: F.xxhash64(s, h)))
    return df.withColumn(name, F.when(n >= words, run).when(n > 0, whole)).drop("_h")


def _distinct(hashes) -> np.ndarray:
    return np.unique(np.asarray(hashes, dtype=np.int64))


def minhashes(distinct: np.ndarray) -> np.ndarray:
    least = np.full(len(_FLIP), 2**64 - 1, dtype=np.uint64)
    values = distinct.view(np.uint64)
    for i in range(0, len(values), 4096):
        mixed = (values[i : i + 4096, None] ^ _FLIP) * _TIMES
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """2 x HALF keys of ROWS minhashes each, none alike by place."""
    rows = least.reshape(2 * HALF, ROWS)
    key = np.arange(1, 2 * HALF + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size, digest and half keys of each set; on views of Arrow's buffers, so that a batch is held once."""
    for sets in batches:
        values, ends = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
        valid = sets.is_valid().to_numpy(zero_copy_only=False)
        sizes, digests, keys, held = [], [], [np.empty(0, np.int64)], [0]
        for i in range(len(sets)):
            one = _distinct(values[ends[i] : ends[i + 1]]) if valid[i] else values[:0]
            sizes.append(len(one))
            digests.append(hashlib.sha256(one.tobytes()).digest()[:16] if len(one) else None)
            if len(one):
                keys.append(half_keys(minhashes(one)))
            held.append(held[-1] + HALF * bool(len(one)))
        halves = np.concatenate(keys).reshape(-1, 2, HALF)
        a, b = (pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(halves[:, k].ravel())) for k in (0, 1))
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), a, b], names=["n_shingles", "digest", "a", "b"])


def _sizes(offsets: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(offsets, total))


def _linked(one: np.ndarray, joined: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the joined sets are at least that similar to one set."""
    hit = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    shared = np.add.reduceat(hit.astype(np.int64), offsets)
    return 100 * shared >= percent * (len(one) + sizes - shared)


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets])
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes


class NearCopies:
    """Signatures, nodes and links of a set of documents."""

    def __init__(self, docs: DataFrame, words: int, percent: int = 80):
        self.docs, self.words, self.percent = docs, words, percent
        signed = shingles(docs.select("doc_id", "text"), words).select("doc_id", F.xxhash64(text_of()).alias("text_key"), F.arrow_udf(_sign, _SIGNED)("shingles").alias("s"))
        self.rows = durable(signed.select("doc_id", "text_key", "s.*"), "signed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
        nodes = self.rows.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(first.alias("at"), F.first("a").alias("a"), F.first("b").alias("b"))
        nodes = nodes.select("digest", "n_shingles", "at.doc_id", "at.text_key", "a", "b").withColumn("node", F.monotonically_increasing_id())
        self.nodes = durable(nodes, "nodes")
        stars = self._stars()
        links = self._to_anchors(stars)
        roots = components(links)
        more = self._outliers(stars, roots)
        self.links = durable(links.unionByName(more), "links")
        self.roots = components(self.links)

    def _stars(self) -> DataFrame:
        """anchor and node, once each, the anchor among its own nodes."""
        # Sets of under 4 cannot be 0.8 similar without being equal.
        able = self.nodes.where("n_shingles >= 4")
        keys = able.select("node", F.explode("a").alias("ka"), "b").select("node", "ka", F.explode("b").alias("kb")).select(F.xxhash64("ka", "kb").alias("key"), "node")
        counts = durable(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        maybe = probe(keys, F.col("key"), bloom(counts, F.col("key"), counts.count()), "maybe").where("maybe").drop("maybe")
        held = durable(maybe.join(counts, "key"), "held")
        weight = held.groupBy("node").agg(F.sum("n").alias("weight"))
        best = held.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("anchor"))
        return durable(held.join(best, "key").select("anchor", "node").distinct(), "stars")

    def _sets(self, stars: DataFrame) -> DataFrame:
        """node, shingles (distinct, sorted), a and b of the nodes in stars, from their texts, read again."""
        needed = durable(self.nodes.join(stars.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "n_shingles", "a", "b"), "needed")
        key = F.xxhash64("doc_id", "text_key")
        docs = self.docs.select("doc_id", "text", F.xxhash64(text_of()).alias("text_key"))
        docs = probe(docs, key, bloom(needed, key, needed.count()), "needed").where("needed").drop("needed")
        same = docs["doc_id"].eqNullSafe(needed["doc_id"]) & (docs["text_key"] == needed["text_key"])
        texts = docs.join(needed, same).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "a", "b", "text")))
        return durable(shingles(texts, self.words).select("node", "n_shingles", "a", "b", F.array_sort(F.array_distinct("shingles")).alias("shingles")), "sets")

    def _to_anchors(self, stars: DataFrame) -> DataFrame:
        """Links between nodes and the anchors of their stars."""
        self.sets = self._sets(stars)
        weights = self.sets.select("node", "n_shingles")
        sizes = stars.join(weights, "node").groupBy("anchor").agg(F.sum("n_shingles").alias("total"))
        blocks = durable(sizes.select("anchor", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("anchor", "star"), "blocks")
        members = stars.where("anchor <> node").join(blocks, F.col("anchor") == F.col("star")).select("star", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
        centres = blocks.select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("star").alias("node"))
        rows = members.unionByName(centres).join(self.sets.select("node", "shingles"), "node")
        percent = self.percent

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            at = pdf["node"].to_numpy() == pdf["star"].to_numpy()
            rest = pdf[~at]
            if not len(rest):
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            joined, offsets, sizes = _joined(list(rest["shingles"]))
            near = _linked(np.asarray(pdf[at]["shingles"].iloc[0]), joined, offsets, sizes, percent)
            return pd.DataFrame({"a": rest["node"].to_numpy()[near], "b": rest["star"].to_numpy()[near]})

        return durable(rows.groupBy("star", "block").applyInPandas(compare, "a long, b long"), "links")

    def _outliers(self, stars: DataFrame, roots: DataFrame) -> DataFrame:
        """Links of a star's members outside its anchor's component with all that share a table with them."""
        root = roots.withColumnRenamed("node", "_n")
        placed = stars.join(root, F.col("node") == F.col("_n"), "left").select("anchor", "node", F.coalesce("root", "node").alias("root"))
        heads = placed.where("anchor = node").select("anchor", F.col("root").alias("main"))
        placed = placed.join(heads, "anchor").withColumn("out", F.col("root") != F.col("main"))
        placed = durable(placed.join(self.sets.select("node", "n_shingles"), "node"), "placed")
        open_ = placed.groupBy("anchor").agg(F.sum(F.when(F.col("out"), F.col("n_shingles"))).alias("outside"), F.sum("n_shingles").alias("total"), F.count("*").alias("n"))
        # A lone outlier beside the anchor has been compared already.
        open_ = durable(open_.where("outside > 0 and n > 2").select("anchor", F.ceil(F.col("outside") / BLOCK).cast("int").alias("outs"), F.ceil(F.col("total") / BLOCK).cast("int").alias("ins")), "open")
        at = placed.join(open_, "anchor")
        mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outs = at.where("out").select("anchor", "node", "root", F.lit(True).alias("asks"), mine("outs").alias("o"), every("ins").alias("i"))
        ins = at.where("node <> anchor").select("anchor", "node", "root", F.lit(False).alias("asks"), mine("ins").alias("i"), every("outs").alias("o"))
        rows = outs.unionByName(ins).join(self.sets.select("node", "a", "b", "shingles"), "node")
        percent = self.percent

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["asks"].to_numpy()
            q, r = pdf[asks], pdf[~asks]
            out_a, out_b = [], []
            if len(q) and len(r):
                nodes, roots_, sizes = r["node"].to_numpy(), r["root"].to_numpy(), np.array([len(s) for s in r["shingles"]])
                a, b, sets = np.stack(list(r["a"])), np.stack(list(r["b"])), list(r["shingles"])
                for node, root_, ka, kb, mine_ in zip(q["node"], q["root"], q["a"], q["b"], q["shingles"], strict=True):
                    one = np.asarray(mine_)
                    may = (roots_ != root_) & (100 * np.minimum(sizes, len(one)) >= percent * np.maximum(sizes, len(one)))
                    may &= (a == np.asarray(ka)).any(axis=1) & (b == np.asarray(kb)).any(axis=1)
                    at_ = np.flatnonzero(may)
                    if len(at_):
                        joined, offsets, n = _joined([sets[k] for k in at_])
                        found = nodes[at_[_linked(one, joined, offsets, n, percent)]]
                        out_a += [node] * len(found)
                        out_b += found.tolist()
            return pd.DataFrame({"a": out_a, "b": out_b}, dtype="int64")

        return durable(rows.groupBy("anchor", "o", "i").applyInPandas(compare, "a long, b long"), "links")

    def judged(self) -> DataFrame:
        """A row per document: doc_id, text_key, n_shingles, component_id, links (of its node), kept."""
        degree = self.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        by_root = self.roots.join(self.nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        linked = self.roots.join(by_root, "root").join(degree, "node", "left").select("node", "component_id", "links")
        sizes = self.rows.where("n_shingles > 0").groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
        told = self.nodes.select("node", "digest", "doc_id").join(linked, "node", "left").join(sizes, "digest", "left").where("component_id is not null or copies > 1")
        told = told.select("digest", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
        # A digest that a third of all rows share is dealt in parts.
        out = salted_join(self.rows.select("doc_id", "text_key", "n_shingles", "digest"), F.xxhash64("doc_id", "text_key"), durable(told, "told"), ["digest"])
        return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest doc_id, of rows alike in that too just one."""
    docs, restore = shield(docs, "doc_id", "text")
    judged = NearCopies(docs, words, percent).judged()
    # Only what goes, or repeats with its id, is looked up.
    told = judged.groupBy("doc_id", "text_key").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"), F.max("n_shingles").alias("_size"))
    told = told.where("not _kept or (_n > 1 and _size > 0)").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_kept", "_n")
    tagged = docs.withColumn("text_key", F.xxhash64(text_of()))
    return restore(settled(tagged, durable(told, "told"), [("doc_id", "_id"), ("text_key", "_key")]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = NearCopies(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
    return near.judged().select("doc_id", "n_shingles", "component_id", "kept", "links")
