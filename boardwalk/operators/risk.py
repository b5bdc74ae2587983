"""Intervals and risk tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators.joins import join_small
from boardwalk.operators.quantiles import percentiles


def add_interval(
    df: DataFrame, points: str = "projected_points", spread: str = "uncertainty", z: float = S.Z_80
) -> DataFrame:
    """Whole-point interval around the projection, its low end not below 0."""
    return df.withColumn("ci_low", S.interval_low(points, spread, z)).withColumn(
        "ci_high", S.interval_high(points, spread, z)
    )


def spread_risk(df: DataFrame, points: str = "projected_points", spread: str = "uncertainty") -> DataFrame:
    """Risk by fixed cuts of spread over projection."""
    return df.withColumn("risk", S.spread_risk(points, spread))


def quartile_risk(
    df: DataFrame,
    group: str = "position",
    points: str = "projected_points",
    low: str = "ci_low",
    high: str = "ci_high",
) -> DataFrame:
    """Risk by the quartiles that a group's relative interval widths fall into.

    The lowest quarter is low risk, the highest high; the cut points belong to the outer tiers.
    Rows without a width stay medium.
    """
    width = df.withColumn("cv", F.try_divide(F.col(high) - F.col(low), F.col(points)))
    cuts = percentiles(width, [group], "cv", {"_q1": 0.25, "_q3": 0.75})
    tiers = join_small(width, cuts.drop("n"), [group])
    risk = F.when(F.col("cv") <= F.col("_q1"), "low").when(F.col("cv") >= F.col("_q3"), "high").otherwise("medium")
    return tiers.withColumn("risk", risk).drop("_q1", "_q3")
