"""Connected components of links of any number, as joins; nothing of the graph comes to the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import Scratch


def _two_way(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select(both.alias("e")).select("e.u", "e.v")


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """Edges (a, b) to (node, component): the smallest node reachable, for every node that has an edge.

    Alternates the large-star and the small-star step, which hang each node on the smallest neighbour, until
    every edge points to the root. Each step is one aggregate, which combines on the map side, and one join,
    whose hot nodes adaptive execution splits. Self links and nulls are ignored.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    sums, turn = _sums(now), 0
    while sums[0]:
        pairs = _two_way(now)
        large = pairs.join(_lowest(pairs), "u").where("v > u and v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = scratch.write(large.distinct(), f"{name}{turn}-large")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(low, "u").where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
        small = small.union(low.select("u", "low"))
        turn += 1
        after = scratch.write(small.distinct(), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}-large", f"{name}{turn - 1}")
        before, sums, now = sums, _sums(after), after
        if sums == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
