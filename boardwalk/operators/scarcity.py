"""Replacement level, positional scarcity, value over replacement and draft state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators.joins import join_small, without
from boardwalk.operators.ranking import top_per_group

# Roster slots that are no position, and groups without a replacement level.
NOT_A_POSITION = ("FLEX", "BENCH")
POSITION_OF_SLOT = {"DEFENSE": "DEF"}
NO_REPLACEMENT = ("K", "DEF")


def starters_needed(config: DataFrame) -> DataFrame:
    """Rows (position, slots, starters_needed) of a one-document roster configuration."""
    slots = config.select(F.explode("roster_slots").alias("slot", "slots"), "num_teams")
    name = F.upper("slot")
    return (
        slots.select(
            S.lookup(POSITION_OF_SLOT, name).alias("mapped"), name.alias("name"), "slots", "num_teams"
        )
        .select(
            F.coalesce("mapped", "name").alias("position"),
            "slots",
            (F.col("slots") * F.col("num_teams")).alias("starters_needed"),
        )
        .filter(~F.col("position").isin(*NOT_A_POSITION))
    )


def flex_positions(config: DataFrame) -> DataFrame:
    """Rows (position) of the groups that may fill the flex slot."""
    return config.select(F.explode(F.transform("flex_eligible", F.upper)).alias("position"))


def _deepest(starters: DataFrame) -> int:
    return starters.agg(F.max("starters_needed")).first()[0] or 0


def _leaders(df, starters, depth: int, group: str, points: str, key: str) -> DataFrame:
    """The top ``depth`` rows of each configured group, with the group's starter count."""
    needed = starters.withColumnRenamed("position", group)
    order = [S.or_zero(points).desc(), F.col(key)]
    top = top_per_group(df.select(group, points, key), [group], order, depth, "_rn")
    return top.join(needed, group)


def scarcity(
    df: DataFrame,
    starters: DataFrame,
    group: str = "position",
    points: str = "projected_points",
    key: str = "player_id",
    digits: int = 1,
) -> DataFrame:
    """How fast each group falls off: best, replacement, drop and the gap between its tiers.

    A group with fewer rows than starters has no replacement level; one with no rows beyond its
    starters has no tier gap.
    """
    depth = 2 * _deepest(starters)
    top = _leaders(df, starters, depth, group, points, key)
    rn, n = F.col("_rn"), F.col("starters_needed")
    value = S.or_zero(points)
    levels = top.groupBy(group).agg(
        F.max(value).alias("top_pts"),
        F.max(F.when(rn == n, value)).alias("replacement_pts"),
        F.avg(F.when(rn <= n, value)).alias("_first"),
        F.avg(F.when(rn.between(n + 1, 2 * n), value)).alias("_second"),
        F.max("slots").alias("slots"),
        F.max("starters_needed").alias("starters_needed"),
    )
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_players"))
    drop = F.col("top_pts") - F.col("replacement_pts")
    table = levels.join(sizes, group).select(
        group,
        "top_pts",
        "replacement_pts",
        F.round(drop, digits).alias("dropoff"),
        F.round(F.try_divide(drop, F.col("slots")), digits).alias("dropoff_per_slot"),
        F.round(F.col("_first") - F.col("_second"), digits).alias("tier_gap"),
        "n_players",
        "starters_needed",
    )
    # One row per configured position, so this order sorts a handful of rows.
    order = Window.orderBy(F.col("tier_gap").desc_nulls_last(), group)
    return table.withColumn("scarcity_rank", F.row_number().over(order))


def replacement_levels(
    df: DataFrame,
    starters: DataFrame,
    group: str = "position",
    points: str = "projected_points",
    key: str = "player_id",
) -> DataFrame:
    """Points of the last starter of each configured group."""
    top = _leaders(df, starters, _deepest(starters), group, points, key)
    return top.filter(F.col("_rn") == F.col("starters_needed")).select(
        group, S.or_zero(points).alias("replacement_pts")
    )


def value_over_replacement(
    df: DataFrame,
    starters: DataFrame,
    group: str = "position",
    points: str = "projected_points",
    key: str = "player_id",
    without_level: Sequence[str] = NO_REPLACEMENT,
    digits: int = 1,
) -> DataFrame:
    """Adds ``vbd``: points above the group's replacement level, 0 where the group has none."""
    ranked = starters.filter(~F.col("position").isin(*without_level))
    levels = replacement_levels(df, ranked, group, points, key)
    valued = join_small(df, levels, [group])
    gain = F.round(S.or_zero(points) - F.col("replacement_pts"), digits)
    return valued.withColumn("vbd", F.coalesce(gain, F.lit(0.0))).drop("replacement_pts")


def remaining(board: DataFrame, picks: DataFrame, key: str = "player_id") -> DataFrame:
    """The board without the picked entities."""
    return without(board, picks, [key])


def flex_pool(
    df: DataFrame,
    starters: DataFrame,
    eligible: Sequence[str],
    flex_starters: int,
    group: str = "position",
    points: str = "projected_points",
    key: str = "player_id",
) -> DataFrame:
    """The best rows of the flex groups once the dedicated starters are gone.

    Of a group at most its starters plus ``flex_starters`` rows can matter, which bounds the sort.
    """
    depth = _deepest(starters) + flex_starters
    pool = df.filter(F.col(group).isin(*eligible))
    left = _leaders(pool, starters, depth, group, points, key).filter(F.col("_rn") > F.col("starters_needed"))
    order = [S.or_zero(points).desc(), F.col(key)]
    # At most ``depth`` rows of each eligible group are left to order here.
    best = left.withColumn("flex_rank", F.row_number().over(Window.orderBy(*order)))
    return best.filter(F.col("flex_rank") <= flex_starters).select(
        key, group, points, F.col("_rn").alias("group_rank"), "flex_rank"
    )
