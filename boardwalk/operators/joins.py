"""Joins shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwalk.session import materialise_counted

SMALL_ROWS = 20_000


def join_small(
    rows: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = SMALL_ROWS
) -> DataFrame:
    """Join per-group figures to rows without moving the rows when the figures are few.

    ``small`` is computed once and counted. Up to ``limit`` rows it is broadcast; beyond that the
    join shuffles, and adaptive execution splits the hot keys.
    """
    stored, count = materialise_counted(small)
    return rows.join(F.broadcast(stored) if count <= limit else stored, on, how)


def without(rows: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``taken``, whose keys are reduced to distinct ones before they move."""
    return rows.join(taken.select(*on).distinct(), on, "left_anti")


def having(rows: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``kept``."""
    return rows.join(kept.select(*on).distinct(), on, "left_semi")
