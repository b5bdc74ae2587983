"""Accuracy of predictions against outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.operators.ranking import row_rank


def with_actuals(
    predictions: DataFrame, actuals: DataFrame, entity: str = "player_id", season: str = "season"
) -> DataFrame:
    """Predictions of the entities that have an outcome in that season."""
    return predictions.join(actuals, [entity, season], "inner")


def r_squared(actual: Column, error: Column) -> Column:
    """Share of variance explained; negative when worse than the mean, null when nothing varies."""
    return 1 - F.try_divide(F.avg(error * error), F.var_pop(actual))


def accuracy(df: DataFrame, groups: Sequence[str], actual: str = "y", predicted: str = "y_hat") -> DataFrame:
    """Errors over the rows that have both an outcome and a prediction."""
    y = F.col(actual)
    error = y - F.col(predicted)
    return df.filter(error.isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        r_squared(y, error).alias("r2"),
    )


def best_model(metrics: DataFrame, groups: Sequence[str], model: str = "model") -> DataFrame:
    """The model of least MAE per group, the first by name on a tie, with its metrics."""
    row = F.struct(F.col(model).alias("best_model"), "mae", "rmse", "r2")
    return (
        metrics.groupBy(*groups)
        .agg(F.min_by(row, F.struct("mae", model)).alias("_m"))
        .select(*groups, "_m.*")
    )


def edge(model_mae: Column | str, baseline_mae: Column | str) -> Column:
    """Share by which the error is below the baseline's."""
    model = F.col(model_mae) if isinstance(model_mae, str) else model_mae
    base = F.col(baseline_mae) if isinstance(baseline_mae, str) else baseline_mae
    return 1 - F.try_divide(model, base)


def season_metrics(
    df: DataFrame,
    group: str = "position",
    season: str = "season",
    actual: str = "y",
    predicted: str = "y_hat",
    baseline: str = "y_base",
) -> DataFrame:
    """Means over the held-out seasons, overall and per group, against a baseline.

    Model and baseline are held against the same rows: those with an outcome and both predictions. Rows are
    reduced to sums per season and group once; the roll-up runs on those.
    """
    y, p, b = F.col(actual), F.col(predicted), F.col(baseline)
    sums = df.filter(y.isNotNull() & p.isNotNull() & b.isNotNull()).groupBy(season, group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("y"),
        F.sum(y * y).alias("yy"),
        F.sum(F.abs(y - p)).alias("ae"),
        F.sum((y - p) * (y - p)).alias("se"),
        F.sum(F.abs(y - b)).alias("ae_base"),
        F.sum((y - b) * (y - b)).alias("se_base"),
    )
    total = {c: F.sum(c) for c in ("n", "y", "yy", "ae", "se", "ae_base", "se_base")}
    spread = total["yy"] - total["y"] * total["y"] / total["n"]
    # What is left of equal outcomes is rounding noise, not variance.
    spread = F.when(spread > total["yy"] * 1e-12, spread)
    per_season = (
        sums.rollup(season, group)
        .agg(
            F.grouping_id().alias("_level"),
            total["n"].alias("n"),
            (total["ae"] / total["n"]).alias("mae"),
            F.sqrt(total["se"] / total["n"]).alias("rmse"),
            (1 - F.try_divide(total["se"], spread)).alias("r2"),
            (total["ae_base"] / total["n"]).alias("mae_base"),
            (1 - F.try_divide(total["se_base"], spread)).alias("r2_base"),
        )
        .filter("_level < 3")
    )
    scope = F.when(F.col("_level") == 1, "Overall").otherwise(F.col(group))
    means = per_season.groupBy(scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("n_seasons"),
        F.sum("n").alias("n_rows"),
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2", "mae_base", "r2_base")],
    )
    return means.withColumn("edge", edge("mae", "mae_base"))


def hit(actual: str, low: str, high: str) -> Column:
    """1 for an outcome inside its interval, ends included, else 0."""
    return F.col(actual).between(F.col(low), F.col(high)).cast("double")


def coverage(
    df: DataFrame,
    groups: Sequence[str],
    actual: str = "y",
    low: str = "lo",
    high: str = "hi",
    target: float = 0.8,
) -> DataFrame:
    """Share of outcomes inside their interval, and how far that is from the target."""
    share = F.avg(hit(actual, low, high))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        share.alias("coverage"),
        F.abs(share - target).alias("coverage_error"),
    )


def rank_backtest(
    df: DataFrame,
    season: str = "season",
    key: str = "player_id",
    actual: str = "y",
    predicted: str = "y_hat",
) -> DataFrame:
    """Predicted and realised rank of each entity within its season."""
    ranked = row_rank(df, [season], [F.col(predicted).desc(), F.col(key)], "predicted_rank")
    ranked = row_rank(ranked, [season], [F.col(actual).desc(), F.col(key)], "actual_rank")
    return ranked.withColumn("rank_miss", F.abs(F.col("predicted_rank") - F.col("actual_rank")))
