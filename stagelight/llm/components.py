"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

JUMPS = 3  # doublings of the way up, each round


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for each node in links (a, b); self-links and repeats do no harm.

    Each round every node with a smaller neighbour moves to its smallest one and some way on, and the edges are mapped to
    where their ends went; at least the larger end of each edge moves. Labels and edges are written each round, so a lost
    executor costs one round; those of the round before are deleted then. Sums and minima are formed before the shuffle: a hub's edges arrive as partial minima.
    """
    both = links.where("a is not null and b is not null")
    labels = durable(both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    edges = durable(_edges(both), "links")
    while not edges.isEmpty():
        up, climbed = durable(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "parents"), []
        for _ in range(JUMPS):
            climbed.append(up)
            further = up.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            up = durable(up.join(further, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to")), "parents")
        moved = up.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        old = labels, edges
        labels = durable(labels.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_t", "root").alias("root")), "labels")
        low = edges.join(moved, F.col("lo") == F.col("_n"), "left").select(F.coalesce("_t", "lo").alias("a"), "hi")
        high = low.join(moved, F.col("hi") == F.col("_n")).select("a", F.col("_t").alias("b"))
        edges = durable(_edges(high), "links")
        discard(*climbed, up, *old)
    return labels


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
