"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import shared

#: Rounds after which something is wrong: their number grows with the log of the longest chain.
MOST_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    x = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(x, 20)), F.bit_xor(x)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node it is connected with.

    Each round is two joins of the edges with the smallest neighbour of each node, an aggregate that
    combines before its shuffle; the join's large side is the edges, which adaptive execution splits
    at a hot node. Rounds end in a written table. Null ends, loops and repeats are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared.materialise(now, "edges")
    if now.isEmpty():
        return now.toDF("node", "root")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, now = now, shared.materialise(small.where("a <> b").distinct(), "edges")
        shared.drop(before)
        if (here := _sum(now)) == seen:
            break
        seen = here
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
