"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, join_hot, made, written


def components(links: DataFrame) -> DataFrame:
    """(`hi`, `lo`) links -> (`node`, `root`) for every node but the roots; a root is the least node it can reach.

    Alternates two star steps: every node hands its greater neighbours to its least neighbour, then its lesser ones. The
    links of a round never exceed those of the round before and are never held as a list. Least neighbours are partial
    aggregates, and links of hubs meet them by a bounded broadcast (`join_hot`), so no task gets the links of one node.
    The number of rounds grows with the logarithm of the largest component; a graph that needs more than 200 raises.
    Every round is written in the shared folder.
    """
    e = written(links.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct(), "links")
    for _ in range(200):
        ends = e.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if not open_.limit(1).count():  # every node has one root, and roots have none
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        since = made() - 1  # the links of the round before go with what this round writes
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")), least, "a", "n").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        large = written(large.distinct(), "stars")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, "hi", "n").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        discard(since, but=e)
    raise ValueError("the links don't settle")
