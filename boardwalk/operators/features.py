"""Season features that look only at earlier seasons, dimension joins and nearest-in-time joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators.joins import join_small
from boardwalk.operators.slices import SLICE, across, inside, sliced

# Team codes that stand for the same team, and the first season whose depth chart is
# the one nearest to a date.
TEAM_ALIASES = {"LA": "LAR", "JAC": "JAX", "WSH": "WAS"}
NEAREST_DATE_SINCE = 2025


def canonical_team(team: Column | str, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    code = F.col(team) if isinstance(team, str) else team
    return F.coalesce(S.lookup(aliases, code), code)


def add_bye(
    df: DataFrame, byes: DataFrame, team: str = "team", aliases: Mapping[str, str] = TEAM_ALIASES
) -> DataFrame:
    """Bye week of each row's team by its canonical code, 0 for a team without one.

    ``byes`` has the columns (team, bye) and may list a team under several codes.
    """
    weeks = byes.groupBy(canonical_team("team", aliases).alias("_code")).agg(F.max("bye").alias("bye"))
    coded = df.drop("bye").withColumn("_code", canonical_team(team, aliases))
    return (
        join_small(coded, weeks, ["_code"])
        .withColumn("bye", F.coalesce("bye", F.lit(0)))
        .drop("_code")
    )


def season_lag(
    df: DataFrame, columns: Sequence[str], entity: str = "player_id", season: str = "season"
) -> DataFrame:
    """Adds ``<column>_lag1``: the entity's value in the season before, null if it skipped that one.

    ``df`` has one row per entity and season, so the window of an entity is as short as its career.
    """
    before = Window.partitionBy(entity).orderBy(season).rangeBetween(-1, -1)
    return df.withColumns({f"{c}_lag1": F.max(c).over(before) for c in columns})


def team_season_totals(
    df: DataFrame, columns: Sequence[str], team: str = "team", season: str = "season"
) -> DataFrame:
    return df.groupBy(team, season).agg(*[F.sum(c).alias(f"{c}_total") for c in columns])


def teammate_production(
    df: DataFrame,
    columns: Sequence[str],
    team: str = "team",
    season: str = "season",
    entity: str = "player_id",
) -> DataFrame:
    """Adds ``teammate_<column>_prev``: last season's production of the others on today's team.

    Production follows the player to the new team. Totals are aggregated first and then joined, so
    that a large team is never gathered in one window.
    """
    lagged = season_lag(df, columns, entity, season)
    totals = lagged.groupBy(team, season).agg(
        *[F.coalesce(F.sum(f"{c}_lag1"), F.lit(0)).alias(f"_{c}") for c in columns]
    )
    joined = join_small(lagged, totals, [team, season])
    others = {
        f"teammate_{c}_prev": F.col(f"_{c}") - F.coalesce(F.col(f"{c}_lag1"), F.lit(0)) for c in columns
    }
    return joined.withColumns(others).drop(*[f"_{c}" for c in columns])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    right_key: str,
    left_key: str,
    direction: str = "nearest",
) -> DataFrame:
    """For each left row the right row of the same keys that is nearest in time.

    ``direction`` is ``backward`` (at or before), ``forward`` (after) or ``nearest`` of the two; at
    equal distance the earlier one wins, at equal time the lower ``right_key``. Adds ``right_time``
    and ``right_key``, null where there is none; a null key or time finds nothing. ``left_key`` is
    unique among the left rows.

    Both sides are put in one order and searched slice by slice; what an end of a slice lacks is
    carried over from the neighbouring slices of the key. No pair of rows is ever formed, and a key
    with very many rows spans many slices.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    keys = list(by)
    hit = F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))
    points = (
        right.dropna(subset=[*keys, right_time])
        .groupBy(*keys, F.col(right_time).alias("_t"))
        .agg(F.min(right_key).alias("_id"))
        .select(*keys, "_t", hit.alias("_hit"))
    )
    blank = left.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, left_time)]))
    asks = left.dropna(subset=[*keys, left_time]).select(
        *keys, F.col(left_time).alias("_t"), F.col(left_key).alias("_ask"), F.struct(*left.columns).alias("_row")
    )
    # Points come before asks of the same time, so an equal time counts as backward.
    order = [F.col("_t"), F.col("_ask").asc_nulls_first()]
    both = sliced(asks.unionByName(points, allowMissingColumns=True), keys, order)

    # What follows is found in a window of reverse order: a frame that runs to the end of its
    # partition is evaluated anew for every row.
    start = Window.unboundedPreceding
    reverse = [F.col("_t").desc(), F.col("_ask").desc_nulls_last()]
    found = both.withColumn("_back", F.last("_hit", True).over(inside(order).rowsBetween(start, 0))).withColumn(
        "_next", F.last("_hit", True).over(inside(reverse).rowsBetween(start, -1))
    )
    ends = both.groupBy(*SLICE).agg(F.min("_hit").alias("_first"), F.max("_hit").alias("_last"))
    ends = ends.select(
        *SLICE,
        F.last("_last", True).over(across().rowsBetween(start, -1)).alias("_before"),
        F.last("_first", True).over(across(backwards=True).rowsBetween(start, -1)).alias("_after"),
    )
    back, ahead = F.coalesce("_back", "_before"), F.coalesce("_next", "_after")
    placed = (
        found.filter(F.col("_row").isNotNull())
        .join(ends, SLICE)
        .select("_row", "_t", back.alias("_back"), ahead.alias("_next"))
    )
    back, ahead = F.col("_back"), F.col("_next")
    if direction == "backward":
        chosen = back
    elif direction == "forward":
        chosen = ahead
    else:
        nearer = _instant(ahead["t"]) - _instant("_t") < _instant("_t") - _instant(back["t"])
        chosen = F.when(back.isNull() | nearer, ahead).otherwise(back)
    found = placed.select("_row.*", chosen["t"].alias(right_time), chosen["id"].alias(right_key))
    return found.unionByName(blank, allowMissingColumns=True)


def _instant(time: Column | str) -> Column:
    return F.unix_micros(F.to_timestamp(time))


def snapshot_target(season: Column | str, week_one: Column | str) -> Column:
    """The date a season's snapshot should be of: 5 September, in older seasons that of week 1."""
    year = F.col(season) if isinstance(season, str) else season
    opening = F.col(week_one) if isinstance(week_one, str) else week_one
    return F.when(year >= NEAREST_DATE_SINCE, F.make_date(year, F.lit(9), F.lit(5))).otherwise(opening)


def depth_snapshot(
    targets: DataFrame,
    snapshots: DataFrame,
    target_date: str = "target_date",
    snapshot_date: str = "snapshot_date",
    entity: str = "player_id",
    season: str = "season",
    payload: str = "depth_rank",
) -> DataFrame:
    """The snapshot nearest to each entity's target date of the season; the earlier one on a tie.

    ``targets`` has one row per entity and season.
    """
    return asof_join(
        targets, snapshots, [entity, season], target_date, snapshot_date, payload, left_key=entity
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``, kept by aggregation so that hot keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def override_team(
    roster: DataFrame, moves: DataFrame, order: Sequence[str], entity: str = "player_id", team: str = "team"
) -> DataFrame:
    """The roster with the latest known move of each entity in place of its team."""
    latest = latest_per_key(moves.select(entity, team, *order), [entity], order)
    latest = latest.select(entity, F.col(team).alias("_new"))
    return (
        roster.join(latest, entity, "left")
        .withColumn(team, F.coalesce("_new", team))
        .drop("_new")
    )


def merge_features(
    base: DataFrame, dims: Sequence[DataFrame], entity: str = "player_id"
) -> DataFrame:
    """Left joins of dimensions with one row per entity; each adds a 0/1 ``has_<n>`` flag."""
    out = base
    for n, dim in enumerate(dims, 1):
        out = out.join(dim.withColumn(f"has_{n}", F.lit(1)), entity, "left").withColumn(
            f"has_{n}", F.coalesce(f"has_{n}", F.lit(0))
        )
    return out


def zscore_composite(
    df: DataFrame, weights: Mapping[str, float], group: str = "position", out: str = "athletic_score"
) -> DataFrame:
    """Weighted sum of the columns' z-scores within the group; a column without spread counts 0."""
    stats = []
    for c in weights:
        stats += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    joined = join_small(df, df.groupBy(group).agg(*stats), [group])
    total = F.lit(0.0)
    for c, w in weights.items():
        spread = F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), spread)
        total = total + F.lit(float(w)) * F.coalesce(z, F.lit(0.0))
    helpers = [f"_{k}_{c}" for c in weights for k in ("m", "s")]
    return joined.withColumn(out, total).drop(*helpers)


def recency_weight(season: Column | str, newest: int, decay: float | Column) -> Column:
    """Weight 1 for the newest season, times ``decay`` for each season before it."""
    years = F.lit(newest) - (F.col(season) if isinstance(season, str) else season)
    return F.pow(decay if isinstance(decay, Column) else F.lit(decay), years)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def shrink_to_group(
    df: DataFrame, value: str, group: str = "position", keep: float = 0.5, out: str = "projected_points"
) -> DataFrame:
    """History pulled toward the group's mean; an entity without history gets the mean."""
    means = df.groupBy(group).agg(F.avg(value).alias("_mean"))
    own = F.col(value)
    pulled = F.lit(keep) * own + F.lit(1 - keep) * F.col("_mean")
    return (
        join_small(df, means, [group])
        .withColumn(out, F.coalesce(pulled, F.col("_mean")))
        .drop("_mean")
    )
