"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core.scratch import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = down.join(least, F.col("a") == F.col("k"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``, component being the least node that it reaches.

    Links are pairs of 64-bit integers, in any direction and number; links with a null end and of
    a node to itself are left out. Each round joins the links with the least neighbour of their
    ends, so a node with very many links is one key of a join that Spark can split, never a
    collected group. Rounds are written to the shared folder, which cuts the lineage; they end
    when the links no longer change.
    """
    now = scratch.save(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        after = scratch.save(_small_star(_large_star(now)), "links")
        scratch.drop(now)
        now = after
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
