"""How well two orders of the same rows agree: Kendall's tau-b and Spearman's rank correlation, for groups of any size.

Discordant pairs are inversions, counted without forming a pair. Rows are range-partitioned by (group, x, y): inversions
inside a slice are counted as its halves are merged. A second range partitioning, by y, gives every row two slices: pairs
of different slices in both orders are counted from the numbers of rows in each cell of slices, and what shares a slice of
y, but none of x, is counted inside that slice. Ties come from counts of equal values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.operators.ranking import tie_ranks
from boardwalk.session import materialise

SLICES = 256
LEAF = 64


def inversions(y: np.ndarray) -> int:
    """Pairs of places i < j with y[i] > y[j]."""
    n = len(y)
    if n <= LEAF:
        return int(np.triu(y[:, None] > y[None, :], 1).sum())
    left, right = y[: n // 2], y[n // 2 :]
    across = len(left) * len(right) - np.searchsorted(np.sort(left), right, "right").sum()
    return inversions(left) + inversions(right) + int(across)


def crossings(cells: np.ndarray) -> int:
    """Of the numbers of rows by slice of x and slice of y: pairs with the lower slice of x and the higher slice of y."""
    before = np.cumsum(cells, axis=0) - cells
    above = before.sum(axis=1, keepdims=True) - np.cumsum(before, axis=1)
    return int((cells * above).sum())


def _inside(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(_g, d): inversions of ``_y`` within each partition's rows of a group, taken in ``order``."""

    def count(batches):
        held = [b for b in batches if len(b)]
        if held:
            whole = pd.concat(held).sort_values(["_g", *order], kind="stable")
            for group, own in whole.groupby("_g", sort=False):
                yield pd.DataFrame({"_g": [group], "d": [inversions(own["_y"].to_numpy())]})

    return rows.select("_g", *dict.fromkeys([*order, "_y"])).mapInPandas(count, "_g string, d long")


def _pairs(of: Column) -> Column:
    return F.coalesce(F.sum(of * (of - 1) / 2), F.lit(0.0))


def kendall(df: DataFrame, x: str, y: str, groups: Sequence[str], slices: int | None = None) -> DataFrame:
    """Per group ``n`` rows with both values, ``discordant`` pairs, and ``tau_b``, which is null where all x or all y are equal.

    Three aggregates and two range partitionings, whatever the group's share of the rows; null and NaN values are left out.
    A task holds a slice; each group has at most ``slices`` squared cells. There are as many as shuffle partitions, up to ``SLICES``.
    """
    slices = slices or min(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)])
    name = F.to_json(F.struct(F.lit(0).alias("_"), *groups), {"ignoreNullFields": "false"})
    rows = df.filter(good).select(*groups, name.alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    by_x = materialise(rows.repartitionByRange(slices, "_g", "_x", "_y").withColumn("_xs", F.spark_partition_id()))
    by_y = materialise(by_x.select("_g", "_xs", "_y").repartitionByRange(slices, "_g", "_y").withColumn("_ys", F.spark_partition_id()))

    def cells(group, own):
        first, second = (np.unique(own[c], return_inverse=True)[1] for c in ("_xs", "_ys"))
        table = np.zeros((first.max() + 1, second.max() + 1), np.int64)
        table[first, second] = own["n"]
        return pd.DataFrame({"_g": [group[0]], "d": [crossings(table)]})

    counted = by_y.groupBy("_g", "_xs", "_ys").agg(F.count(F.lit(1)).alias("n"))
    across = counted.groupBy("_g").applyInPandas(cells, "_g string, d long")
    found = _inside(by_x, ["_x", "_y"]).union(across).union(_inside(by_y, ["_xs", "_y"]))
    discordant = found.groupBy("_g").agg(F.sum("d").alias("discordant"))
    both = by_x.groupBy(*groups, "_g", "_x", "_y").agg(F.count(F.lit(1)).alias("n"))

    def ties(column: str) -> DataFrame:
        return both.groupBy("_g", column).agg(F.sum("n").alias("n")).groupBy("_g").agg(_pairs(F.col("n")).alias(f"tied{column}"))

    total = both.groupBy(*groups, "_g").agg(F.sum("n").alias("n"), _pairs(F.col("n")).alias("tied"))
    whole = total.join(ties("_x"), "_g").join(ties("_y"), "_g").join(discordant, "_g")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    excess = pairs - F.col("tied_x") - F.col("tied_y") + F.col("tied") - 2 * F.col("discordant")
    scale = F.sqrt((pairs - F.col("tied_x")) * (pairs - F.col("tied_y")))
    return whole.select(*groups, "n", "discordant", F.try_divide(excess, scale).alias("tau_b"))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str]) -> DataFrame:
    """Per group the correlation of the average ranks of x and y; null where all x or all y are equal."""
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)])
    rows = materialise(df.filter(good).select(*groups, x, y))
    for column in (x, y):
        ranks = tie_ranks(rows, column, list(groups)).select(*groups, column, F.col("avg_rank").alias(f"_{column}"))
        rows = rows.join(ranks, [*groups, column])
    spread = F.stddev_pop(f"_{x}") * F.stddev_pop(f"_{y}")
    return rows.groupBy(*groups).agg(F.try_divide(F.covar_pop(f"_{x}", f"_{y}"), spread).alias("spearman"))
