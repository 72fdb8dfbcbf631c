"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash, so a block is a random sample of its source and the order of blocks is a random
permutation. Targets fix how many whole passes and how many blocks of a last, partial pass each source gives: its quota of
block slots. The tree halves the output shards again and again; at each node the left half's quotas are a multivariate
hypergeometric draw from the node's, made source by source from the inverse distribution function at a hash of the node, so
they are exact, sum up at every level and are the same in every run. Each leaf then takes the next disjoint run of its
sources' permuted slots, and its rows are shuffled locally by a hash, in PIECES, so that a shard is written by many tasks. The
number of shards follows the number of words, and the number of blocks that of the shards: a shard has SLOTS of them or more,
and as many as any other but for one. Where there are too few documents for that, fewer shards are made.

Only rows of (document, source, size, hash) are grouped; text is read once to count words. The block that the target cuts, with
its neighbours up to POOL documents on either side, is split on, in at most BLOCKS blocks a level, until it holds few documents; these are picked
by size to fill what is left, with one exchange to come nearer. Windows see a source's blocks as a whole, some SLOTS numbers for each shard it could fill alone.

Null texts have size 0. Null is a source like any other, ordered last. Documents alike in id, source and text are treated alike. If
all sizes are 0, all targets are. Rows with equal hashes share a fate. Very long texts are read once to be counted, in one row, and
no document is cut. Other columns pass by untouched, whatever their names. A node of the tree holds one number a source, so sources
are meant to be as many as a registry has, tens of thousands at most, not one a document. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, durable, shield, text_of

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source, and so a document, at most
BLOCKS = 1024
BLOCK_DOCS = 512
#: Output shards: so many at least, and one more for each SHARD_WORDS words of the mix. A shard's rows are dealt in PIECES for writing.
SHARDS, SHARD_WORDS, PIECES = 16, 20_000_000, 64
#: Blocks of a shard, at least.
SLOTS = 4
#: Documents on either side of a target's cut that its last words are chosen from too, where there are so many, and all of them at most.
POOL, MOST_POOL = BLOCK_DOCS // 2, 6 * BLOCK_DOCS
SEED = 20


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE + "+")).cast("long")


def _hash() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", text_of())


def _unit(h: str, level: int) -> Column:
    """A number in [0, 1) from the hash; another one for each level."""
    return F.shiftrightunsigned(F.xxhash64(F.col(h), F.lit(level)), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, target and at, its number; a row per source, the only thing that a window sees as a whole.

    Raising the common level until none is above its cap: with sources ordered by cap a weight, the level is the largest of
    what remains after capping the first k, for each k.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.col("at"), F.lit(len(WEIGHTS))) + 1)
    ranked = total.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", MOST * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    return levels.select("source", "source_size", "docs", "at", F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("weight")).alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Mix:
    """A mix of documents: targets, passes over each block, shards of each slot, and the picked documents of cut blocks."""

    def __init__(self, docs: DataFrame, shards: int | None = None):
        sizes = docs.select("doc_id", "source", size_of(text_of()).alias("size"), _hash().alias("h"))
        self.sizes = durable(sizes, "sizes")
        targets = durable(source_targets(self.sizes), "targets")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        self.targets = targets.withColumn("passes", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        words = self.targets.agg(F.sum("target")).first()[0] or 0
        shards = shards or max(SHARDS, -int(-words // SHARD_WORDS))
        self._cut(shards, words)
        self._deal(shards)

    def _cut(self, shards: int, words: float) -> None:
        """Find which blocks of the partial pass are taken whole, level by level down to the block that is cut."""
        # A source's blocks are as its part of the shards, were each source taken once.
        part = F.ceil(F.col("source_size") * (SLOTS * shards / max(words, 1.0)))
        at = self.targets.select("at", F.col("source").alias("_s"), "rest", F.col("docs").alias("n"), F.least("docs", part).alias("least"))
        inside = self.sizes.join(at.select("at", "_s"), _same_source("source", "_s")).select("at", "h", "size")
        level, self.levels = 0, []
        while True:
            n_blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_DOCS)), "least").cast("int")
            split = at.select("at", "rest", n_blocks.alias("n_blocks"))
            placed = inside.join(split, "at").withColumn("block", F.floor(_unit("h", level) * F.col("n_blocks")).cast("int"))
            sums = durable(placed.groupBy("at", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n")).join(split, "at"), "blocks")
            so_far = Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
            state = sums.withColumn("upto", F.sum("words").over(so_far)).withColumn("docs", F.sum("n").over(so_far))
            over = F.col("upto") > F.col("rest")
            crossing = over & (F.col("upto") - F.col("words") < F.col("rest"))
            # The block that the target cuts, and those on either side of it until there are POOL documents more to choose from.
            last = F.max(F.when(crossing, F.col("docs"))).over(Window.partitionBy("at"))
            state = state.withColumn("cut", F.coalesce(crossing | F.when(over, F.col("docs") - F.col("n") - last < POOL).otherwise(last - F.col("docs") < POOL), F.lit(False)))
            state = durable(state.withColumn("whole", ~over & ~F.col("cut")), "passes")
            self.levels.append(state)
            left = F.first("rest") - F.coalesce(F.sum(F.when(F.col("whole"), F.col("words"))), F.lit(0))
            cut = state.groupBy("at").agg(left.alias("rest"), F.sum(F.when(F.col("cut"), F.col("n"))).alias("n")).where("n is not null")
            # Rows of equal hashes are one entry from here on, so each level parts what the one before did not.
            inside = placed.drop("rest", "n_blocks").join(state.where("cut").select("at", "block"), ["at", "block"], "left_semi")
            inside = durable(inside.groupBy("at", "h").agg(F.sum("size").alias("size")), "cut")
            at, level = cut.select("at", "rest", "n", F.lit(1).alias("least")), level + 1
            if (inside.groupBy("at").count().agg(F.max("count")).first()[0] or 0) <= MOST_POOL:
                break
        # Within the cut blocks, at most MOST_POOL documents: by size, the largest first, each taken if it still fits.
        lists = inside.where("size > 0").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("size", "h")), asc=False).alias("docs")).join(at.select("at", "rest"), "at")
        doc, none = "struct<size: bigint, h: bigint>", "named_struct('size', 0L, 'h', 0L)"
        fill = f"aggregate(docs, named_struct('left', rest, 'taken', cast(array() as array<{doc}>)), (s, d) -> if(d.size <= s.left, named_struct('left', s.left - d.size, 'taken', concat(s.taken, array(d))), s))"
        filled = lists.selectExpr("at", "docs", f"explode(array({fill})) as f")
        # Then the one that, in place of a taken one or of none, comes nearest to the target.
        untaken = "array_except(docs, f.taken)"
        nearer = "abs(f.left - u.size + t.size) < s.gap"
        swap = f"aggregate({untaken}, named_struct('gap', f.left, 'goes', {none}, 'comes', {none}), (r, u) -> aggregate(concat(array({none}), f.taken), r, (s, t) -> if({nearer}, named_struct('gap', abs(f.left - u.size + t.size), 'goes', t, 'comes', u), s)))"
        swapped = filled.selectExpr("at", "f", f"explode(array({swap})) as s")
        kept = swapped.selectExpr("at", "explode(if(s.comes.size > 0, concat(array_except(f.taken, array(s.goes)), array(s.comes)), f.taken)) as d")
        self.picked = durable(kept.select("at", F.col("d.h").alias("h")).withColumn("picked", F.lit(True)), "picked")

    def _deal(self, shards: int) -> None:
        """Quotas of block slots by source, split down the tree; then each shard's slots. These tables have some SLOTS rows a shard."""
        top = self.levels[0]
        per = F.coalesce(F.sum((F.col("whole") | F.col("cut")).cast("int")), F.lit(0))
        quota = top.groupBy("at").agg(per.alias("partial"), F.count("*").alias("blocks")).join(self.targets.select("at", "passes"), "at")
        quota = quota.select("at", (F.col("blocks") * F.col("passes") + F.col("partial")).cast("int").alias("k")).where("k > 0")
        quota = durable(quota, "quota")
        shards = self.shards = max(1, min(shards, (quota.agg(F.sum("k")).first()[0] or 0) // SLOTS))
        node = quota.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "k"))).alias("quotas"))
        node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "quotas")
        while shards > 1:
            node = _halve(node)
            shards = (shards + 1) // 2
        leaf = durable(node.select(F.col("first").alias("shard"), F.inline("quotas")).where("k > 0"), "quotas")
        before = F.sum("k").over(Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        runs = leaf.withColumn("start", F.coalesce(before, F.lit(0))).select("at", "shard", F.explode(F.sequence("start", F.col("start") + F.col("k") - 1)).alias("slot"))
        # Slots: whole passes first, then the partial one; within a pass, blocks in the order of their numbers, which is a random one.
        turns = top.join(self.targets.select("at", "passes"), "at").withColumn("turns", F.col("passes") + (F.col("whole") | F.col("cut")).cast("int"))
        seen = turns.where("turns > 0").select("at", "block", "cut", "passes", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        slots = seen.withColumn("slot", (F.row_number().over(Window.partitionBy("at").orderBy("turn", "block")) - 1).cast("long"))
        dealt = slots.join(runs.withColumn("slot", F.col("slot").cast("long")), ["at", "slot"])
        part = F.col("cut") & (F.col("turn") == F.col("passes"))
        slots = dealt.groupBy("at", "block").agg(F.sort_array(F.collect_list(F.when(~part, F.col("shard")))).alias("whole_in"), F.max(F.when(part, F.col("shard"))).alias("cut_in"))
        self.slots = durable(slots, "slots")
        self.marks = [durable(top.join(self.slots, ["at", "block"], "left"), "marks"), *self.levels[1:]]

    def copies(self, docs: DataFrame) -> DataFrame:
        """docs, which needs h and source, with the shards that take a copy: an array of at most MOST."""
        at = self.targets.select(F.col("source").alias("_s"), "at", "source_size", "target", F.col("docs").alias("_n"))
        out = docs.join(at, _same_source("source", "_s"))
        cut = F.lit(False)
        for level, state in enumerate(self.marks):
            blocks = state.groupBy("at").agg(F.max("n_blocks").alias("_blocks"))
            out = out.join(blocks, "at", "left").withColumn(f"_b{level}", F.floor(_unit("h", level) * F.col("_blocks")).cast("int")).drop("_blocks")
            marks = state.select("at", F.col("block").alias(f"_b{level}"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), *(() if level else ("whole_in", "cut_in")))
            out = out.join(marks, ["at", f"_b{level}"], "left")
            inside = F.lit(True) if level == 0 else F.col("_in")
            taken = F.coalesce(inside & F.col("_whole"), F.lit(False))
            if level:
                cut = cut | taken
            out = out.withColumn("_in", F.coalesce(inside & F.col("_cut"), F.lit(False))).withColumn("_taken", cut).drop("_whole", "_cut")
            cut = F.col("_taken")
        out = out.join(self.picked, ["at", "h"], "left").withColumn("_taken", F.col("_taken") | (F.col("_in") & F.coalesce("picked", F.lit(False))))
        none = F.array().cast("array<int>")
        shards = F.concat(F.coalesce("whole_in", none), F.when(F.col("_taken") & F.col("cut_in").isNotNull(), F.array("cut_in")).otherwise(none))
        return out.withColumn("shards", shards)

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mixed rows with docs' own columns: a row per copy, those of a shard's piece together and in the order of a hash."""
        docs, restore = shield(docs, "doc_id", "source", "text")
        dealt = self.copies(docs.withColumn("h", _hash())).select(*docs.columns, "h", F.posexplode("shards").alias("turn", "shard"))
        order = F.xxhash64("h", "turn")
        # Pieces are a second hash, so no partition holds more than its part of a shard, and their number is the session's.
        return restore(dealt.withColumn("piece", F.pmod(order, F.lit(PIECES))).repartition("shard", "piece").sortWithinPartitions("shard", "piece", order, "doc_id"))


#: ln n!: exact products up to 15, Stirling's series above.
def _ln_factorial(n: str) -> str:
    exact, product = ["0D"], 1
    for i in range(1, 16):
        product *= i
        exact.append(f"{product}D")
    x = f"cast({n} as double)"
    return f"(case when {n} < 16 then ln(element_at(array({', '.join(['1D', *exact[1:]])}), cast({n} as int) + 1)) else {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) end)"


def _drawn() -> str:
    """How many of the K among N are in a random n of them: the first x at which the distribution function reaches u. Terms beyond 12 deviations are below 1e-30."""
    lf = _ln_factorial
    p = f"exp({lf('q.k')} - {lf('x')} - {lf('(q.k - x)')} + {lf('(a.among - q.k)')} - {lf('(a.draws - x)')} - {lf('(a.among - q.k - a.draws + x)')} - {lf('a.among')} + {lf('a.draws')} + {lf('(a.among - a.draws)')})"
    mean = "cast(a.draws as double) * q.k / a.among"
    far = f"12 * sqrt({mean} * (1 - cast(a.draws as double) / a.among)) + 12"
    low = f"greatest(0, a.draws - (a.among - q.k), cast(floor({mean} - ({far})) as int))"
    high = f"least(a.draws, q.k, cast(ceil({mean} + {far}) as int))"
    u = "(shiftrightunsigned(xxhash64(first, n, q.at, 11), 11) / 9007199254740992D)"
    walked = f"aggregate(sequence({low}, {high}), named_struct('c', 0D, 'got', -1), (s, x) -> case when s.got >= 0 then s else named_struct('c', s.c + {p}, 'got', case when s.c + {p} >= {u} then x else -1 end) end)"
    return f"(case when a.draws <= 0 then 0 when a.draws >= a.among then q.k else coalesce(nullif({walked}.got, -1), {high}) end)"


def _halve(node: DataFrame) -> DataFrame:
    """Nodes (first, n shards, quotas) into their halves; a node of one shard stays."""
    total = "aggregate(quotas, 0, (s, q) -> s + q.k)"
    left_n = "cast(ceil(n / 2) as int)"
    node = node.selectExpr("first", "n", "quotas", f"explode_outer(array({total})) as total").selectExpr("*", f"explode_outer(array(cast(round(total * cast({left_n} as double) / n) as int))) as wanted")
    step = f"transform(array({_drawn()}), d -> named_struct('among', a.among - q.k, 'draws', a.draws - d, 'out', concat(a.out, array(named_struct('at', q.at, 'k', d)))))[0]"
    fold = f"aggregate(quotas, named_struct('among', total, 'draws', wanted, 'out', cast(array() as array<struct<at:int,k:int>>)), (a, q) -> {step}).out"
    left = node.where("n > 1").selectExpr("first", "n", "quotas", f"explode_outer(array({fold})) as got")
    kept = node.where("n <= 1").select("first", "n", "quotas")
    low = left.selectExpr("first", f"{left_n} as n", "got as quotas")
    high = left.selectExpr(f"first + {left_n} as first", f"n - {left_n} as n", "zip_with(quotas, got, (q, g) -> named_struct('at', q.at, 'k', q.k - g.k)) as quotas")
    return durable(kept.unionByName(low).unionByName(high), "nodes")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = mix.copies(mix.sizes)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.size("shards").alias("copies"), F.col("shards").cast("string").alias("shards"))
