"""From projections to published boards, and the static export of the data products."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk import schemas
from boardwalk.functions import scalars as S
from boardwalk.operators import ranking, scarcity
from boardwalk.sources import readers, sinks

# Board names, and points per stat of each scoring format.
LABEL_BOARD = {S.SLEEPER: "top-sleepers", S.BUST: "top-busts"}
RECEPTION_POINTS = {"standard": 0.0, "half_ppr": 0.5, "ppr": 1.0}
STAT_POINTS = {
    "passing_yards": 0.04,
    "passing_tds": 4.0,
    "interceptions": -2.0,
    "rushing_yards": 0.1,
    "rushing_tds": 6.0,
    "rec_yards": 0.1,
    "receiving_tds": 6.0,
    "fumbles_lost": -2.0,
}


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """The accuracy map as rows per position; no rows where the file is missing."""
    by_position = T.StructType([T.StructField("position", T.StringType()), *schemas.ACCURACY.fields])
    return readers.optional(
        lambda: readers.read_map(spark, path, schemas.ACCURACY, key="position"), by_position
    )


def ranking_rows(
    players: DataFrame, updated: datetime, limits: Mapping[str, int] = ranking.BOARD_LIMITS
) -> DataFrame:
    """The rows of all position boards, formatted for display after the top-k cut."""
    top = ranking.position_boards(players, limits)
    return top.select(
        F.concat(F.lower("position"), F.lit("-rankings")).alias("board"),
        "rank",
        "rank_label",
        "player_name",
        S.team_or_blank("team").alias("team"),
        S.show_points("projected_points").alias("points"),
        S.show_interval("ci_low", "ci_high").alias("interval"),
        S.show_market_rank("adp").alias("market_rank"),
        S.risk_text("risk").alias("risk"),
        S.risk_class("risk").alias("verdict_class"),
        S.date_stamp(F.lit(updated)).alias("updated"),
    )


def gap_rows(value_gaps: DataFrame, updated: datetime, size: int = ranking.GAP_BOARD_SIZE) -> DataFrame:
    """The rows of both gap boards; their reason is the one stored with the gap."""
    order = [F.abs(S.or_zero("adp_gap")).desc(), F.col("player_name"), F.col("position")]
    sides = value_gaps.filter(F.col("label").isin(S.SLEEPER, S.BUST))
    top = ranking.top_per_group(sides, ["label"], order, size)
    return top.select(
        S.lookup(LABEL_BOARD, "label").alias("board"),
        "rank",
        "player_name",
        "position",
        S.team_or_free_agent("team").alias("team"),
        S.show_points("projected_points").alias("points"),
        S.cut_rank("model_rank").cast("string").alias("model_rank"),
        S.cut_rank("adp").cast("string").alias("market_rank"),
        S.show_gap("adp_gap").alias("gap"),
        F.lower("label").alias("verdict_class"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        S.date_stamp(F.lit(updated)).alias("updated"),
    )


def build_boards(players: DataFrame, value_gaps: DataFrame, updated: datetime) -> DataFrame:
    """All boards of the active players and the value gaps, in one table with the column ``board``."""
    return ranking.union_boards(ranking_rows(players, updated), gap_rows(value_gaps, updated))


def publish(spark: SparkSession, players: str, value_gaps: str, site: str, updated: datetime) -> dict:
    """Reads projections and value gaps, writes the boards, and returns how many rows went in and out."""
    projections = readers.read_records(spark, players, schemas.PROJECTIONS)
    gaps = readers.read_records(spark, value_gaps, schemas.VALUE_GAPS)
    counts = {name: Observation(name) for name in ("n_active", "n_gaps", "n_rows")}

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.observe(counts[name], F.count(F.lit(1)).alias(name))

    active = counted(ranking.active(projections), "n_active")
    boards = build_boards(active, counted(gaps, "n_gaps"), updated)
    owned = [*(f"{position.lower()}-rankings" for position in ranking.BOARD_LIMITS), *LABEL_BOARD.values()]
    sinks.publish_boards(counted(boards, "n_rows"), site, owned)
    return {name: seen.get[name] for name, seen in counts.items()}


def scoring_weights(scoring: str) -> dict[str, float]:
    """Points per stat of a scoring format; they differ in the value of a reception."""
    if scoring not in RECEPTION_POINTS:
        raise ValueError(f"unknown scoring format {scoring!r}")
    return {**STAT_POINTS, "receptions": RECEPTION_POINTS[scoring]}


def season_points(stats: DataFrame, scoring: str = "half_ppr") -> DataFrame:
    """Points of each player and season; stats a table lacks count 0."""
    weights = {s: w for s, w in scoring_weights(scoring).items() if s in stats.columns}
    return (
        stats.withColumn("_points", S.score(weights))
        .groupBy("player_id", "position", "season")
        .agg(F.round(F.sum("_points"), 2).alias("points"))
    )


def export_static(
    stats: DataFrame,
    board: DataFrame,
    config: DataFrame,
    folder: str,
    seasons: int = 5,
    scoring: str = "half_ppr",
) -> None:
    """Writes the points of the last ``seasons`` seasons, value over replacement and scarcity as JSON."""
    newest = stats.agg(F.max("season")).first()[0]
    recent = stats.filter(F.col("season") > F.lit(newest) - seasons)
    sinks.export_json(season_points(recent, scoring), f"{folder}/season_points")
    needed = scarcity.starters_needed(config)
    sinks.export_json(scarcity.value_over_replacement(board, needed), f"{folder}/players")
    ranked = needed.filter(~F.col("position").isin(*scarcity.NO_REPLACEMENT))
    sinks.export_json(scarcity.scarcity(board, ranked), f"{folder}/scarcity")
