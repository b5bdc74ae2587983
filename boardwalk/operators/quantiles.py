"""Exact order statistics and percentiles per group, whatever the size of the group.

The built-in exact percentile holds every distinct value of a group in one buffer. Here an
approximate percentile only brackets the wanted places; one pass counts what lies below the
bracket and which values lie in it, and the place is read off those counts. The counts are exact,
so a bracket that misses is noticed and widened; the answer never depends on the approximation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.operators.joins import join_small
from boardwalk.session import materialise

ACCURACY = 10_000


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    places: Mapping[str, tuple[float, Column]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: ``n`` values (null and NaN are none), and for each name the value at a place.

    ``places`` maps a name to the share of the group it lies near and to its 1-based place as a
    column of ``n``. A place outside 1..n gives null.
    """
    keys = list(groups) or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    shares = sorted({share for share, _ in places.values()})
    margin = 3.0 / accuracy
    while True:
        found = materialise(_read_places(rows, keys, places, shares, margin, accuracy))
        missed = [F.col(name).isNull() & place.between(1, F.col("n")) for name, (_, place) in places.items()]
        if found.filter(reduce(lambda a, b: a | b, missed)).isEmpty():
            return found if groups else found.drop("_all")
        margin *= 20


def _read_places(rows, keys, places, shares, margin, accuracy) -> DataFrame:
    steps = [min(max(s + sign * margin, 0.0), 1.0) for s in shares for sign in (-1, 1)]
    cuts = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", F.array(*map(F.lit, steps)), accuracy).alias("_cuts"),
    )
    whole = F.col("n") <= accuracy
    for i, share in enumerate(shares):
        low_end, high_end = share - margin <= 0, share + margin >= 1
        cuts = cuts.withColumn(
            f"_lo{i}", F.when(whole | F.lit(low_end), float("-inf")).otherwise(F.col("_cuts")[2 * i])
        ).withColumn(
            f"_hi{i}", F.when(whole | F.lit(high_end), float("inf")).otherwise(F.col("_cuts")[2 * i + 1])
        )
    near = join_small(rows, cuts.drop("_cuts"), keys, "inner")

    inside = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(shares))]
    below = [F.col("_v") < F.col(f"_lo{i}") for i in range(len(shares))]
    counted = near.groupBy(
        *keys, "n", F.when(reduce(lambda a, b: a | b, inside), F.col("_v")).alias("_k")
    ).agg(
        *[F.count_if(c).alias(f"_in{i}") for i, c in enumerate(inside)],
        *[F.count_if(c).alias(f"_below{i}") for i, c in enumerate(below)],
    )
    group = Window.partitionBy(*keys)
    upward = group.orderBy(F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(shares)):
        counted = counted.withColumn(
            f"_end{i}", F.sum(f"_below{i}").over(group) + F.sum(f"_in{i}").over(upward)
        )
    picks = []
    for name, (share, place) in places.items():
        i = shares.index(share)
        here = (F.col(f"_end{i}") - F.col(f"_in{i}") < place) & (place <= F.col(f"_end{i}"))
        picks.append(F.max(F.when(here & (F.col(f"_in{i}") > 0), F.col("_k"))).alias(name))
    return counted.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact percentiles with linear interpolation between the two neighbouring values."""
    places = {}
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        places[f"_{name}_lo"] = (share, F.floor(at) + 1)
        places[f"_{name}_hi"] = (share, F.ceil(at) + 1)
    found = order_statistics(df, groups, value, places, accuracy)
    out = []
    for name, share in shares.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        at = (F.col("n") - 1) * F.lit(share)
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*groups, "n", *out)
