"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which the job gives up; stars halve a path's length each round.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; a component is its least node.

    Links may repeat, point either way or lead to their own node; null ends are
    dropped. Each round is two joins against partial minima, written into the
    shared folder; a node with very many links is split by the skew join, never
    gathered. No link gives no row.
    """
    spark = links.sparkSession
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("s"), F.least("a", "b").alias("d")).distinct()
    edges = common.materialise(edges, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d")))
        least = both.groupBy("s").agg(F.min("d").alias("m")).select("s", F.least("s", "m").alias("m"))
        large = both.join(least, "s").filter("d > s").select(F.col("d").alias("s"), F.col("m").alias("d")).filter("s <> d").distinct()
        down = large.groupBy("s").agg(F.min("d").alias("m"))
        small = large.join(down, "s").select(F.explode(F.array(F.struct("s", F.col("m").alias("d")), F.struct(F.col("d").alias("s"), F.col("m").alias("d")))).alias("e")).select("e.s", "e.d").filter("s <> d").distinct()
        new = common.materialise(small, "stars")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("s", "d").cast("decimal(38,0)"))).first())
        edges = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return edges.select(F.col("s").alias("node"), F.col("d").alias("component")).unionByName(edges.select(F.col("d").alias("node"), F.col("d").alias("component")).distinct())
