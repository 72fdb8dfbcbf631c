"""Similarity joins that compare few pairs: texts within an edit distance, and sets that share a part of their union.

`edit_pairs` cuts the shorter text of a pair evenly into d + 1 pieces, d being the edits that the pair may differ by: one piece
is left untouched, so it stands in the longer text, not far from its own place. Pieces and the longer texts' substrings at those
places are joined by equality, together with the two lengths.

`set_pairs` sorts each set's members by rarity. Two sets that are alike enough have `meet` of their first members in common,
of which the smaller set needs to look at fewer, and where they first meet enough members are left behind in both. So sets are
joined by choices of that many first members; sizes and places are held against these bounds in the join, and pairs of sets
that cannot be alike are no rows. Sets so small that fewer in common may be enough meet by fewer as well. Frequent members
stand last, and are looked up in sets alone that have no rarer ones. The choices of a set grow with that power of the members
looked up, two by default: the join is meant for short texts, such as titles. Three compare fewer pairs, for more rows.

Both take distinct texts or sets: `classes` gives one representative for all rows alike, and which rows it stands for. What is
verified is distinct, so a pair that meets in several ways is compared once. A piece or member that very many texts share
makes rows with the product of the texts on either side; adaptive execution splits such a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(rows: DataFrame, key: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """A representative of all rows alike in `by`, the one with the least key (rep, by); and the membership (key, rep). Rows with a null are left out."""
    known = rows.where(" and ".join(f"{c} is not null" for c in by))
    reps = known.groupBy(*by).agg(F.min(key).alias("rep"))
    return reps, known.select(key, *by).join(reps, list(by)).select(key, "rep")


def edits(length: Column | int, least: float) -> Column:
    """The edits that leave a text of so many characters `least` similar to a shorter one; rounding never loses one."""
    return F.floor((1 - least) * length + 1e-9).cast("int")


def _pieces(size: Column, n: Column) -> Column:
    """Where n even pieces of a text begin (from 1) and how long they are; the longer ones come last."""
    short, longer = F.floor(size / n).cast("int"), F.pmod(size, n)
    first = n - longer
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.struct(
            k.alias("k"), F.when(k <= first, (k - 1) * short + 1).otherwise((k - 1) * short + 1 + k - 1 - first).cast("int").alias("at"), F.when(k <= first, short).otherwise(short + 1).alias("len")
        ),
    )


def edit_candidates(texts: DataFrame, text: str, least: float, within: list[str] | None = None) -> DataFrame:
    """a, b: pairs of distinct texts of which one may be `least` similar to the other, b the longer one or, of a length, the greater. Columns within are equal."""
    if not 0.5 <= least <= 1:
        raise ValueError("least must be from 0.5 to 1")
    within = within or []
    rows = texts.select(text, *within).distinct().where(f"length({text}) > 0").withColumnRenamed(text, "t").withColumn("n", F.length("t"))
    # Of the shorter text: its pieces for each number of edits that a partner may have.
    most = F.floor(F.col("n") / least + 1e-9).cast("int")
    short = rows.withColumn("d", F.explode(F.sequence(edits(F.col("n"), least), edits(most, least))))
    short = short.withColumn("p", F.explode(_pieces(F.col("n"), F.col("d") + 1)))
    short = short.select(F.col("t").alias("a"), *within, F.col("n").alias("na"), "d", F.col("p.k").alias("k"), F.expr("substr(t, p.at, p.len)").alias("piece"))
    # Of the longer one: its substrings where a piece of a partner of each length may stand.
    long_ = rows.withColumn("d", edits(F.col("n"), least)).withColumn("na", F.explode(F.sequence(F.greatest(F.col("n") - F.col("d"), F.lit(1)), F.col("n"))))
    long_ = long_.withColumn("p", F.explode(_pieces(F.col("na"), F.col("d") + 1)))
    k, at, size, shift = F.col("p.k"), F.col("p.at"), F.col("p.len"), F.col("n") - F.col("na")
    low = F.greatest(F.lit(1), at - (k - 1), at + shift - (F.col("d") + 1 - k))
    high = F.least(F.col("n") - size + 1, at + (k - 1), at + shift + (F.col("d") + 1 - k))
    long_ = long_.withColumn("s", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    long_ = long_.select(F.col("t").alias("b"), "n", *within, "na", "d", F.col("p.k").alias("k"), F.expr("substr(t, s, p.len)").alias("piece")).distinct()
    met = short.join(long_, ["na", "d", "k", "piece", *within]).where("na < n or a < b")
    return met.select("a", "b", *within).distinct()


def edit_pairs(texts: DataFrame, text: str, least: float, within: list[str] | None = None) -> DataFrame:
    """a < b, similarity: distinct texts whose edit distance is at most 1 - `least` of the longer one's length."""
    within = within or []
    longest = F.greatest(F.length("a"), F.length("b"))
    met = edit_candidates(texts, text, least, within).withColumn("similarity", 1 - F.levenshtein("a", "b") / longest).where(F.col("similarity") >= least)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *within, "similarity")


def _choices(members: Column, n: int) -> Column:
    """All choices of n members in order, with the number of the last one (from 1)."""
    if n == 1:
        return F.transform(members, lambda x, i: F.struct((i + 1).alias("at"), F.array(x).alias("x")))
    fewer = _choices(members, n - 1)
    later = lambda j: F.transform(F.filter(fewer, lambda c: c["at"] < j), lambda c: F.struct(j.alias("at"), F.concat(c["x"], F.array(F.element_at(members, j))).alias("x")))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(members)), later))


def set_candidates(sets: DataFrame, key: str, members: str, least: float, within: list[str] | None = None, meet: int = 2) -> DataFrame:
    """a, b: keys of sets that may have `least` of their union in common, a the smaller set or, of a size, the one with the smaller key. Columns within are equal."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    within = within or []
    each = sets.where(F.size(members) > 0).select(F.col(key).alias("rep"), *within, F.explode(members).alias("member"))
    rarity = each.groupBy("member").agg(F.count("*").alias("n"))
    ordered = each.join(rarity, "member").groupBy("rep", *within).agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("m"))
    ordered = ordered.select("rep", *within, F.size("m").alias("size"), F.transform("m", lambda x: x["member"]).alias("m"))
    size, slack = F.col("size"), 1e-9
    common = lambda a, b: F.ceil(least / (1 + least) * (a + b) - slack)

    def keys(share: float, fewest: Column) -> DataFrame:
        """Of each set: choices of `meet` of its first members, and of fewer where a partner may have no more in common with it."""
        out = None
        for k in range(1, meet + 1):
            able = ordered if k == meet else ordered.where(fewest <= k)
            looked = able.select("rep", *within, "size", F.slice("m", F.lit(1), F.least(size, (size - F.ceil(share * size - slack) + k).cast("int"))).alias("m"))
            made = looked.where(F.size("m") >= k).select("rep", *within, "size", F.lit(k).alias("k"), F.explode(_choices(F.col("m"), k)).alias("c")).select("rep", *within, "size", "k", "c.*")
            out = made if out is None else out.unionByName(made)
        return out

    # The smaller set of a pair needs fewer looked up: its share of the larger one is larger than that of the union.
    small = keys(2 * least / (1 + least), common(size, size)).withColumnsRenamed({"rep": "a", "size": "na", "at": "ia"})
    large = keys(least, common(size, F.ceil(least * size - slack))).withColumnsRenamed({"rep": "b", "size": "nb", "at": "ib"})
    needed = common(F.col("na"), F.col("nb"))
    fits = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= least * F.col("nb") - slack)
    # Where two sets first meet, enough members must be left behind; fewer than `meet` count only where so few in common are enough.
    fits &= (F.col("k") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= needed) & F.when(F.col("k") == meet, needed >= meet).otherwise(needed == F.col("k"))
    return small.join(large, ["k", "x", *within]).where(fits).select("a", "b", *within).distinct()


GRAM = 3


def _grams(text: Column) -> Column:
    """All parts of one to GRAM characters."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*(of(k) for k in range(1, GRAM + 1)))))


def contained_pairs(inner: DataFrame, outer: DataFrame, text: str) -> DataFrame:
    """inner, outer: each distinct text with the distinct texts of the other frame that hold it. Nulls and empty texts are in none.

    A text is looked up by that part of GRAM characters, or itself if it is shorter, which the fewest others have; one with a part that none has
    is in none. Texts meet by equality of that part, so no two are compared that have it not in common.
    """
    asks = inner.select(F.col(text).alias("inner")).where("inner <> ''").distinct()
    holds = outer.select(F.col(text).alias("outer")).where("outer <> ''").distinct()
    parts = holds.select("outer", F.explode(_grams(F.col("outer"))).alias("gram"))
    often = parts.groupBy("gram").agg(F.count("*").alias("n"))
    own = asks.select("inner", F.explode(F.filter(_grams(F.col("inner")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length(F.col("inner"))))).alias("gram"))
    rarest = own.join(often, "gram", "left").groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(parts, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def share_of_union(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def set_pairs(sets: DataFrame, key: str, members: str, least: float, within: list[str] | None = None) -> DataFrame:
    """a < b, similarity: keys of sets that have at least so much of their union in common."""
    met = set_candidates(sets, key, members, least, within)
    one = lambda k, s: sets.select(F.col(key).alias(k), F.col(members).alias(s))
    sided = met.join(one("a", "_x"), "a").join(one("b", "_y"), "b").withColumn("similarity", share_of_union(F.col("_x"), F.col("_y")))
    return sided.where(F.col("similarity") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(within or []), "similarity")


def membership(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """key, rep, links: each row of the class rows (key, rep) with the number of classes that its own is linked with."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return rows.join(links, "rep", "left").select(key, "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def dice_to_share(dice: float) -> float:
    """The share of the union that a Dice similarity means."""
    return dice / (2 - dice)


