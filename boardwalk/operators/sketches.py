"""Distinct counts over any range of days from stored sketches, without the events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """One standard error of an estimate, as a share of the count."""
    return 1.04 / 2 ** (lg_k / 2)


def daily_sketches(df: DataFrame, key: str, by: Sequence[str], time: str = "ts", lg_k: int = LG_K) -> DataFrame:
    """One sketch of the keys per day and value of ``by``: a few KB, however many events there were; null keys count nothing."""
    return df.groupBy(*by, F.to_date(time).alias("day")).agg(F.hll_sketch_agg(F.col(key), F.lit(lg_k)).alias("sketch"))


def distinct_between(sketches: DataFrame, by: Sequence[str | Column], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Estimated number of distinct keys per value of ``by`` over the days from ``first`` to ``last``, both included: sketches
    of days merge without loss, so a key of several days counts once."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("day") >= first)
    if last is not None:
        inside = inside & (F.col("day") <= last)
    return sketches.filter(inside).groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimated"))
