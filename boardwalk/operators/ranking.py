"""Ranks, top-k boards and model-against-market gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators.joins import join_small
from boardwalk.operators.slices import place, weight_before

# Board sizes, gap board size and least projection of a listed entity.
BOARD_LIMITS = {"QB": 32, "RB": 50, "WR": 60, "TE": 24}
GAP_BOARD_SIZE = 15
MIN_PROJECTION = 20.0

# Largest k that Spark limits inside each map task (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000


def active(df: DataFrame, points: str = "projected_points", least: float = MIN_PROJECTION) -> DataFrame:
    """Rows projected for at least ``least``; a missing projection counts 0."""
    return df.filter(S.or_zero(points) >= least)


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int | Mapping[str, int], out: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, numbered from 1.

    ``k`` may differ by the (single) group column; groups without an entry get no rows. ``order``
    has to end in a unique key. Spark cuts each map task's rows to k before the shuffle.
    """
    widest = k if isinstance(k, int) else max(k.values())
    if not isinstance(k, int):
        df = df.filter(F.col(groups[0]).isin(list(k)))
    if widest > MAP_SIDE_LIMIT:
        ranked = row_rank(df, groups, order, out)
    else:
        ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    ranked = ranked.filter(F.col(out) <= widest)
    if isinstance(k, int):
        return ranked
    return ranked.filter(F.col(out) <= S.lookup(k, groups[0]))


def position_boards(
    df: DataFrame,
    limits: Mapping[str, int] = BOARD_LIMITS,
    group: str = "position",
    points: str = "projected_points",
    key: str = "player_id",
) -> DataFrame:
    """All ranking boards at once: top rows by projection, with their rank and rank label."""
    order = [S.or_zero(points).desc(), F.col(key)]
    return top_per_group(df, [group], order, limits).withColumn("rank_label", S.rank_label(group, "rank"))


def row_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1..n within each group; ``order`` has to end in a unique key."""
    return place(df, groups, order, out)


def tie_ranks(
    df: DataFrame, value: str, groups: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """One row per distinct value of a group, with ``ties``, ``min_rank`` and ``avg_rank``."""
    scores = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    placed = weight_before(scores, groups, [order], F.col("ties"), "_before")
    return placed.select(
        *groups,
        value,
        "ties",
        (F.col("_before") + 1).alias("min_rank"),
        (F.col("_before") + (F.col("ties") + 1) / 2.0).alias("avg_rank"),
    )


def average_rank(
    df: DataFrame, value: str, out: str, groups: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """Rank of each row where ties share the mean of their places.

    Only distinct values are sorted. They are joined back by value: few of them, as of rounded
    points, are broadcast; with many, adaptive execution splits a value that many rows share. A row
    without a value has no rank.
    """
    ranks = tie_ranks(df, value, groups, descending).select(*groups, value, F.col("avg_rank").alias(out))
    return join_small(df, ranks, [*groups, value])


def value_gap(
    df: DataFrame, rank: str = "avg_rank", market: str = "adp", min_gap: float | None = None
) -> DataFrame:
    """Market price less model rank, its sign as a label, and the stored (cut) rank.

    A row without a market price has no gap. ``min_gap`` keeps the rows flagged on either side.
    """
    gap = F.col(market) - F.col(rank)
    label = F.when(F.col("adp_gap") > 0, S.SLEEPER).when(F.col("adp_gap") < 0, S.BUST)
    flagged = (
        df.withColumn("adp_gap", gap)
        .withColumn("model_rank", F.col(rank).cast("int"))
        .withColumn("label", label)
    )
    return flagged if min_gap is None else flagged.filter(F.abs("adp_gap") >= min_gap)


def of_label(df: DataFrame, label: str) -> DataFrame:
    """The rows of one side; only the two labels exist."""
    if label not in (S.SLEEPER, S.BUST):
        raise ValueError(f"label has to be {S.SLEEPER} or {S.BUST}, not {label!r}")
    return df.filter(F.col("label") == label)


def gap_boards(df: DataFrame, size: int = GAP_BOARD_SIZE, key: str = "player_id") -> DataFrame:
    """The widest gaps of each label, with their reason text."""
    order = [F.abs(S.or_zero("adp_gap")).desc(), F.col(key)]
    labelled = df.filter(F.col("label").isin(S.SLEEPER, S.BUST))
    return top_per_group(labelled, ["label"], order, size).withColumn(
        "reason", S.gap_reason("model_rank", "adp", "label")
    )


def union_boards(*boards: DataFrame) -> DataFrame:
    """One draft board of several tables; columns a table lacks are null."""
    board = boards[0]
    for other in boards[1:]:
        board = board.unionByName(other, allowMissingColumns=True)
    return board
