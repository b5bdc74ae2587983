"""Ordered work on groups of any size: range-partitioned slices instead of whole groups.

A window over a group sorts that group in one task. Here rows are range-partitioned by (group,
order), so a large group spans many slices; what a slice needs from the ones before or after it is
computed from one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.operators.joins import join_small
from boardwalk.session import materialise

SLICE = ["_g", "_slice"]


def sliced(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``_g``, the group as one value, and ``_slice``, which rises with ``order``.

    ``order`` has to be total within a group, so that a slice can end anywhere. The result is
    written once: a second run could draw other slice borders.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order)
    group = F.struct(F.lit(0).alias("_"), *groups)
    return materialise(ranged.withColumn("_slice", F.spark_partition_id()).withColumn("_g", group))


def place(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds the 1-based place of each row in its group, at the cost of one shuffle.

    Rows are sorted inside their slices, where ``monotonically_increasing_id`` numbers them: its
    upper bits are the partition, its lower 33 bits the row. A slice's rows of a group then only
    need a shift, which the few summary rows give.
    """
    keys = [F.col(g) for g in groups]
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    group = F.struct(F.lit(0).alias("_"), *groups)
    rows = materialise(ordered.withColumn("_g", group).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_slice", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    spans = rows.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = F.sum("_n").over(across().rowsBetween(Window.unboundedPreceding, -1))
    shifts = spans.select(*SLICE, (F.coalesce(earlier, F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    return join_small(rows, shifts, SLICE).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(out))


def inside(order: Sequence[Column]):
    """The window of a slice."""
    return Window.partitionBy(*SLICE).orderBy(*order)


def across(backwards: bool = False):
    """The window over the slices of a group, one summary row each."""
    at = F.col("_slice")
    return Window.partitionBy("_g").orderBy(at.desc() if backwards else at.asc())


def weight_before(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], weight: Column, out: str
) -> DataFrame:
    """Adds the total ``weight`` of the rows that come earlier in the same group."""
    rows = sliced(df.withColumn("_w", weight.cast("bigint")), groups, order)
    earlier = across().rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*SLICE)
        .agg(F.sum("_w").alias("_w"))
        .select(*SLICE, F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_earlier"))
    )
    above = F.sum("_w").over(inside(order).rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("_inside", F.coalesce(above, F.lit(0)))
    return numbered.join(offsets, SLICE).select(
        *df.columns, (F.col("_earlier") + F.col("_inside")).alias(out)
    )
