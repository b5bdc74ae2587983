"""Quantile intervals from residuals, and their conformal calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.operators.joins import join_small
from boardwalk.operators.quantiles import ACCURACY, order_statistics, percentiles

LOW_SHARE = 0.1
HIGH_SHARE = 0.9
MISS_SHARE = 0.2


def residual_quantiles(
    train: DataFrame, groups: Sequence[str], actual: str = "y", predicted: str = "y_hat"
) -> DataFrame:
    """Per group the 10th and 90th percentile of actual less predicted."""
    residuals = train.withColumn("_e", F.col(actual) - F.col(predicted))
    return percentiles(residuals, groups, "_e", {"e_lo": LOW_SHARE, "e_hi": HIGH_SHARE})


def raw_interval(
    df: DataFrame, quantiles: DataFrame, groups: Sequence[str], predicted: str = "y_hat"
) -> DataFrame:
    """Prediction plus its group's residual quantiles as ``lo`` and ``hi``, null for a new group."""
    joined = join_small(df, quantiles.drop("n"), list(groups))
    return (
        joined.withColumn("lo", F.col(predicted) + F.col("e_lo"))
        .withColumn("hi", F.col(predicted) + F.col("e_hi"))
        .drop("e_lo", "e_hi")
    )


def conformal_margin(
    calibration: DataFrame,
    groups: Sequence[str],
    actual: str = "y",
    low: str = "lo",
    high: str = "hi",
    miss: float = MISS_SHARE,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """How far intervals have to move so that a share ``miss`` of new outcomes falls outside.

    The score of a row is its distance beyond the interval (negative inside); the margin is the
    score at place ceil((n + 1)(1 - miss)), null when the calibration set is too small for one.
    """
    scored = calibration.withColumn(
        "_score", F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))
    )
    place = F.ceil((F.col("n") + 1) * F.lit(1 - miss))
    return order_statistics(scored, groups, "_score", {"margin": (1 - miss, place)}, accuracy)


def widen(
    df: DataFrame, margins: DataFrame, groups: Sequence[str], low: str = "lo", high: str = "hi"
) -> DataFrame:
    """Calibrated intervals ``cal_lo`` and ``cal_hi``, unbounded where there is no margin."""
    joined = join_small(df, margins.drop("n"), list(groups))
    margin = F.coalesce("margin", F.lit(float("inf")))
    return (
        joined.withColumn("cal_lo", F.col(low) - margin)
        .withColumn("cal_hi", F.col(high) + margin)
        .drop("margin")
    )
