"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwave.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b. Large: each node links its larger neighbours to the smallest of its neighbourhood. Small: it links
    its smaller neighbours and itself to it. The minimum of each node is pre-aggregated and written before the join, so that a hub's edges meet a
    table of one row per node and adaptive execution can split them."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), forget_size=True)
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no node has two smaller neighbours, or both a smaller and a larger one. One aggregate, one number."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of edges (a, b) of any orderable type; component is the smallest node reachable. Loops, repeated edges and
    either direction are fine; a null end makes no link. Each round is checkpointed, and nothing but a count a round reaches the driver. Rounds grow
    with the logarithm of the diameter; should `most_rounds` not do, it raises."""
    now = cut_lineage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), forget_size=True)
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = cut_lineage(_stars(cut_lineage(_stars(now, True), forget_size=True), False), forget_size=True)
    raise ValueError(f"components did not settle in {most_rounds} rounds")
