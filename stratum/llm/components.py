"""Connected components by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut

SALTS = 16


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round is a few aggregations and joins over the edges, whose number never grows; no node's neighbours are
    gathered. Loops and repeated edges are allowed; nulls are not. It ends at the fixed point; ``rounds`` is a bound that raises.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        # large star: the greater neighbours of each node go to its smallest; a node may have very many, so they are salted
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = e.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(least.select(F.col("a").alias("b"), "m", salts), ["b", "salt"], "left")
        large = salted.select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: the smaller neighbours of each node, and it itself, go to its smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    # at the fixed point every node but the smallest of a component has one edge, to the smallest
    return e.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
