"""One query per operator over the warehouse tables. Each takes the session and the table folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk import schemas
from boardwalk.functions import scalars as S
from boardwalk.operators import (
    conformal,
    features,
    merge,
    metrics,
    moments,
    ranking,
    risk,
    rules,
    scarcity,
    walkforward,
)
from boardwalk.operators.joins import having
from boardwalk.plans import frames
from boardwalk.session import materialise, scratch_path
from boardwalk.sources import readers
from boardwalk.streaming import ingest

LIMITS = {"AUTOMOBILE": 32, "BUILDING": 50, "FURNITURE": 60, "HOUSEHOLD": 24, "MACHINERY": 32}
SEGMENTS = tuple(LIMITS)
ROSTER = {
    "roster_slots": {"automobile": 1, "building": 2, "furniture": 2, "household": 1, "flex": 1, "bench": 6},
    "flex_eligible": ["building", "furniture", "household"],
    "bench_size": 6,
    "num_teams": 12,
    "scoring_format": "half_ppr",
}
FLEX_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD")
EDGE_TEXT = {"AUTOMOBILE": "34%", "BUILDING": "38%", "FURNITURE": "33%", "HOUSEHOLD": "39%"}
MIN_GAP = 42.0
UPDATED = datetime(2026, 4, 20, 12, 0)
ALIASES = {"NATION_22": "NATION_2", "NATION_23": "NATION_3", "NATION_24": "NATION_4"}
STAT_WEIGHTS = {"l_quantity": 0.5, "l_discount": 10.0, "l_tax": -5.0}
PRINCIPAL = 7

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def seasons_of(spark, folder) -> list[int]:
    """The seasons that the orders show and that have one before them, oldest first."""
    return walkforward.tested_seasons(frames.order_cents(spark, folder))


def newest_season(spark, folder) -> int:
    return max(seasons_of(spark, folder), default=0)


def roster_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([ROSTER], schemas.ROSTER_CONFIG)


def money_rank(df: DataFrame) -> DataFrame:
    """Players with the average ranks of their points and of their balance."""
    valued = materialise(df.withColumn("projected_points", S.or_zero("projected_points")))
    ranked = ranking.average_rank(valued, "projected_points", "avg_rank")
    return ranking.average_rank(ranked.drop("adp"), "balance", "adp")


# Boards


@query
def active_filter(spark, folder):
    rows = ranking.active(frames.players(spark, folder))
    return rows.select("player_id", "position", "projected_points")


@query
def group_topk(spark, folder):
    board = ranking.position_boards(ranking.active(frames.players(spark, folder)), LIMITS)
    return board.select(
        "player_id", "position", "rank", "rank_label", S.show_points("projected_points").alias("points")
    )


@query
def avg_rank_gap(spark, folder):
    gaps = ranking.value_gap(money_rank(frames.players(spark, folder)), min_gap=MIN_GAP)
    return gaps.select("player_id", "avg_rank", "adp", "adp_gap", "model_rank", "label")


@query
def gap_board(spark, folder):
    gaps = ranking.value_gap(money_rank(frames.players(spark, folder)), min_gap=MIN_GAP)
    return ranking.gap_boards(gaps).select(
        "label",
        "rank",
        "player_id",
        S.cut_rank("model_rank").alias("model_rank"),
        S.cut_rank("adp").alias("market_rank"),
        S.show_gap("adp_gap").alias("gap"),
        "reason",
    )


@query
def tie_rank_table(spark, folder):
    """Average and lowest rank of each distinct points value within its segment."""
    players = frames.players(spark, folder).withColumn("projected_points", S.or_zero("projected_points"))
    return ranking.tie_ranks(players, "projected_points", ["position"])


@query
def display_columns(spark, folder):
    spread = F.col("projected_points") / (F.col("team") % 6 + 3)
    players = frames.players(spark, folder).withColumn("uncertainty", spread)
    board = risk.spread_risk(risk.add_interval(players))
    code = F.when(F.col("team") % 2 == 0, F.upper("risk")).otherwise(F.col("risk"))
    verdict = S.risk_verdict(code)
    return board.select(
        "player_id",
        S.show_points("projected_points").alias("points"),
        S.show_market_rank("adp").alias("market_rank"),
        S.show_interval("ci_low", "ci_high").alias("interval"),
        S.risk_text(code).alias("risk_text"),
        S.risk_class(code).alias("risk_class"),
        verdict["class"].alias("verdict_class"),
        verdict["text"].alias("verdict_text"),
        S.lookup(EDGE_TEXT, "position", "n/a").alias("edge_text"),
        S.team_or_free_agent(F.when(F.col("team") < 20, F.col("team").cast("string"))).alias("team_shown"),
        S.date_stamp(F.lit(UPDATED)).alias("updated"),
        S.date_stamp(F.lit(UPDATED), S.DATE_MONTH).alias("month"),
        S.date_stamp(F.lit(UPDATED), S.DATE_ISO).alias("iso_date"),
    )


@query
def board_digest(spark, folder):
    """Each board as one text, and whether its segment may fill the flex slot."""
    board = ranking.position_boards(ranking.active(frames.players(spark, folder)), LIMITS)
    line = F.struct("rank", F.concat("rank_label", F.lit(" "), "player_name").alias("text"))
    boards = board.groupBy("position").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    eligible = F.array(*[F.lit(p) for p in ROSTER["flex_eligible"]])
    texts = F.transform("lines", lambda entry: entry["text"])
    return boards.select(
        "position",
        S.join_texts(S.without_nulls(texts), ", ").alias("board"),
        S.may_fill_flex("position", eligible).alias("flex"),
    )


@query
def board_union(spark, folder):
    suppliers = frames.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("player_id"),
        F.col("s_name").alias("player_name"),
        F.lit("SUPPLIER").alias("position"),
        F.col("s_nationkey").alias("team"),
    )
    skill = frames.players(spark, folder).drop("balance")
    return ranking.union_boards(skill, suppliers)


# Scarcity and draft state


@query
def scarcity_table(spark, folder):
    needed = scarcity.starters_needed(roster_config(spark))
    return scarcity.scarcity(materialise(frames.players(spark, folder)), needed, digits=6)


@query
def vbd(spark, folder):
    needed = scarcity.starters_needed(roster_config(spark))
    players = materialise(frames.players(spark, folder))
    valued = scarcity.value_over_replacement(players, needed, without_level=("HOUSEHOLD",))
    return valued.select("player_id", "position", "projected_points", "vbd")


@query
def remaining_board(spark, folder):
    """The replacement levels once the entities that bought something are drafted."""
    bought = frames.events(spark, folder).filter(F.col("event_type") == "purchase")
    picks = bought.select(F.col("user_id").alias("player_id"))
    left = materialise(scarcity.remaining(frames.players(spark, folder), picks))
    needed = scarcity.starters_needed(roster_config(spark))
    levels = scarcity.replacement_levels(left, needed)
    sizes = rules.slice_counts(left, ["position"], "n_left")
    return sizes.join(levels, "position", "left")


@query
def flex_pool(spark, folder):
    config = roster_config(spark)
    pool = scarcity.flex_pool(
        frames.players(spark, folder), scarcity.starters_needed(config), FLEX_SEGMENTS, ROSTER["num_teams"]
    )
    return pool.select("player_id", "position", "projected_points", "group_rank", "flex_rank")


# Intervals and risk


def spread_frame(spark, folder) -> DataFrame:
    """Players with their points and the spread of their order totals, in the same unit."""
    orders = frames.order_cents(spark, folder)
    stats = orders.groupBy("player_id").agg(
        F.sum("cents").alias("cents"), F.stddev_samp(F.col("cents") / 1e6).alias("sd")
    )
    joined = frames.customers(spark, folder).join(stats, "player_id", "left")
    return joined.select(
        "player_id",
        "position",
        (F.col("cents") / 1e6).alias("projected_points"),
        F.coalesce("sd", F.lit(0.0)).alias("uncertainty"),
    )


@query
def interval_risk(spark, folder):
    board = risk.spread_risk(risk.add_interval(spread_frame(spark, folder)))
    return board.select("player_id", "position", "ci_low", "ci_high", "risk")


@query
def risk_quartile(spark, folder):
    board = risk.quartile_risk(materialise(risk.add_interval(spread_frame(spark, folder))))
    return board.select("player_id", "position", "cv", "risk")


# Features


@query
def bye_join(spark, folder):
    nations = frames.table(spark, folder, "nation")
    byes = nations.filter(F.col("n_regionkey") > 0).select(
        F.col("n_name").alias("team"), (F.col("n_regionkey") + 5).alias("bye")
    )
    named = frames.customers(spark, folder).join(
        nations.select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("team_name")), "team", "left"
    )
    roster = named.select("player_id", F.col("team_name").alias("team"))
    return features.add_bye(roster, byes, aliases=ALIASES).select(
        "player_id", features.canonical_team("team", ALIASES).alias("team"), "bye"
    )


@query
def teammate_prev(spark, folder):
    rows = features.teammate_production(frames.player_seasons(spark, folder), ["cents"])
    return rows.select("player_id", "season", "team", "cents_lag1", "teammate_cents_prev")


@query
def season_lag(spark, folder):
    rows = features.season_lag(frames.season_points(spark, folder), ["cents"])
    return rows.select("player_id", "season", "cents", "cents_lag1")


@query
def team_totals(spark, folder):
    return features.team_season_totals(frames.player_seasons(spark, folder), ["cents"])


@query
def asof_nearest(spark, folder):
    events = frames.events(spark, folder)
    asks = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id")
    )
    joined = features.asof_join(asks, views, ["user_id"], "ts", "view_ts", "view_id", "event_id")
    apart = F.abs(F.unix_micros("ts") - F.unix_micros("view_ts"))
    return joined.select("event_id", "user_id", "view_id", apart.alias("micros_apart"))


@query
def asof_null_keys(spark, folder):
    """``asof_nearest`` where some purchases lack the user or the time, and some views the user."""
    events = frames.events(spark, folder)
    k = F.col("k")
    asks = events.filter(F.col("event_type") == "purchase").select(
        "event_id",
        F.when(k >= 5, F.col("user_id")).alias("user_id"),
        F.when((k < 5) | (k >= 10), F.col("ts")).alias("ts"),
    )
    views = events.filter(F.col("event_type") == "view").select(
        F.when(k >= 10, F.col("user_id")).alias("user_id"),
        F.col("ts").alias("view_ts"),
        F.col("event_id").alias("view_id"),
    )
    joined = features.asof_join(asks, views, ["user_id"], "ts", "view_ts", "view_id", "event_id")
    apart = F.abs(F.unix_micros("ts") - F.unix_micros("view_ts"))
    return joined.select("event_id", "user_id", "view_id", apart.alias("micros_apart"))


@query
def depth_snapshot(spark, folder):
    """Of each customer and season the order nearest to 5 September."""
    orders = frames.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("player_id"),
        F.year("o_orderdate").alias("season"),
        F.to_date("o_orderdate").alias("snapshot_date"),
        F.col("o_orderkey").alias("depth_rank"),
    )
    day = F.make_date("season", F.lit(9), F.lit(5))
    targets = orders.select("player_id", "season").distinct().withColumn("target_date", day)
    nearest = features.depth_snapshot(targets, orders)
    apart = F.abs(F.date_diff("snapshot_date", "target_date"))
    return nearest.select("player_id", "season", F.col("depth_rank").alias("order_id"), apart.alias("days_apart"))


@query
def latest_assignment(spark, folder):
    moves = frames.events(spark, folder).select(
        F.col("user_id").alias("player_id"), (F.col("k") % 25).alias("team"), "ts", "event_id"
    )
    roster = frames.customers(spark, folder).select("player_id", "team", F.col("team").alias("old_team"))
    return features.override_team(roster, moves, ["ts", "event_id"]).select("player_id", "old_team", "team")


@query
def feature_merge(spark, folder):
    base = frames.customers(spark, folder).select("player_id", "position", "team", "balance")
    orders = frames.order_cents(spark, folder)
    draft = orders.groupBy("player_id").agg(
        F.min("season").alias("first_season"), F.count(F.lit(1)).alias("n_orders")
    )
    college = (
        frames.events(spark, folder)
        .groupBy(F.col("user_id").alias("player_id"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    depth = ranking.top_per_group(
        base, ["team"], [F.col("balance").desc(), F.col("player_id")], 2, "depth_rank"
    ).select("player_id", "depth_rank")
    merged = features.merge_features(base, [draft, college, depth])
    rookie = F.coalesce((F.col("first_season") == newest_season(spark, folder)).cast("int"), F.lit(0))
    merged = merged.withColumn("is_rookie", rookie).withColumns(S.starter_flags("depth_rank"))
    return merged.select(
        "player_id",
        "first_season",
        "n_orders",
        "n_events",
        "has_1",
        "has_2",
        "has_3",
        "is_rookie",
        "is_starter",
        "is_backup",
        S.interaction("n_events", "is_rookie").alias("college_x_rookie"),
    )


@query
def zscore_composite(spark, folder):
    counts = frames.order_cents(spark, folder).groupBy("player_id").agg(F.count(F.lit(1)).alias("n_orders"))
    base = frames.customers(spark, folder).join(counts, "player_id", "left")
    base = base.withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    scored = features.zscore_composite(base, {"balance": 0.6, "n_orders": 0.4})
    return scored.select("player_id", "position", F.round("athletic_score", 6).alias("athletic_score"))


@query
def temporal_weight(spark, folder):
    weight = features.recency_weight("season", newest_season(spark, folder), 0.8)
    mean = features.weighted_mean(F.col("y"), weight)
    return (
        frames.season_points(spark, folder)
        .groupBy("player_id")
        .agg(F.round(mean, 8).alias("weighted_points"), F.count(F.lit(1)).alias("n_seasons"))
    )


@query
def shrink_mean(spark, folder):
    last = frames.season_points(spark, folder).filter(F.col("season") == newest_season(spark, folder))
    base = frames.customers(spark, folder).join(last.select("player_id", "cents"), "player_id", "left")
    pulled = features.shrink_to_group(base, "cents", keep=0.6)
    return pulled.select("player_id", "position", "projected_points")


@query
def scoring_profile(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    return (
        lines.select("l_orderkey", S.score(STAT_WEIGHTS).alias("points"))
        .groupBy("l_orderkey")
        .agg(F.round(F.sum("points"), 4).alias("points"))
    )


# Models and their accuracy


def naive_predictions(spark, folder) -> DataFrame:
    """Player seasons predicted by the season before."""
    return by_last_season(frames.player_seasons(spark, folder))


def by_last_season(seasons: DataFrame) -> DataFrame:
    lagged = features.season_lag(seasons, ["y"]).filter(F.col("y_lag1").isNotNull())
    return lagged.select("player_id", "season", "position", "adp", "y", F.col("y_lag1").alias("y_hat"))


def market_seasons(spark, folder) -> DataFrame:
    """Player seasons with a market price of at least 1, as its logarithm is taken."""
    return frames.player_seasons(spark, folder).withColumn("adp", F.greatest("adp", F.lit(1.0)))


def with_baseline(spark, folder) -> DataFrame:
    """The test seasons' predictions by last season, and by the market as ``y_base``."""
    seasons = materialise(market_seasons(spark, folder))
    folds = walkforward.tested_seasons(seasons)
    tested = by_last_season(seasons).filter(F.col("season").isin(*folds))
    return walkforward.predict_baseline(tested, walkforward.log_market_baseline(seasons, folds))


@query
def walk_forward(spark, folder):
    return walkforward.fold_sizes(frames.season_points(spark, folder), seasons_of(spark, folder))


@query
def log_baseline(spark, folder):
    fitted = walkforward.log_market_baseline(market_seasons(spark, folder), seasons_of(spark, folder))
    rounded = [F.round(b, 4).alias(b) for b in ("b0", "b1", "b2")]
    return fitted.select("test_season", "position", "n_train", *rounded)


@query
def metrics_rollup(spark, folder):
    table = metrics.season_metrics(with_baseline(spark, folder))
    figures = ("mae", "rmse", "r2", "mae_base", "r2_base", "edge")
    return table.select("scope", "n_seasons", "n_rows", *[F.round(c, 6).alias(c) for c in figures])


def by_model(spark, folder) -> DataFrame:
    """The predictions by last season and by the market as rows of two models."""
    models = F.array(
        F.struct(F.lit("last_season").alias("model"), F.col("y_hat").alias("y_hat")),
        F.struct(F.lit("market").alias("model"), F.col("y_base").alias("y_hat")),
    )
    rows = with_baseline(spark, folder).select("player_id", "season", "position", "y", F.explode(models).alias("m"))
    return rows.select("player_id", "season", "position", "y", "m.*")


@query
def ensemble_average(spark, folder):
    """Mean and spread of the predictions by last season and by the market."""
    averaged = walkforward.ensemble(by_model(spark, folder), ["player_id", "season"])
    figures = [F.round(c, 4).alias(c) for c in ("y_hat", "uncertainty")]
    return averaged.select("player_id", "season", *figures, "n_models")


@query
def model_choice(spark, folder):
    """The better of last season and the market baseline per segment, on pooled errors."""
    both = by_model(spark, folder)
    best = metrics.best_model(metrics.accuracy(both, ["position", "model"]), ["position"])
    return best.select("position", "best_model", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query
def rank_backtest(spark, folder):
    points = frames.season_points(spark, folder).select("player_id", "season", "y")
    predictions = points.select("player_id", (F.col("season") + 1).alias("season"), F.col("y").alias("y_hat"))
    ranks = metrics.rank_backtest(metrics.with_actuals(predictions, points))
    return ranks.select("player_id", "season", "predicted_rank", "actual_rank", "rank_miss")


@query
def coverage(spark, folder):
    """How many orders fall inside their customer's interval of order totals."""
    orders = frames.order_cents(spark, folder).select("player_id", (F.col("cents") / 1e5).alias("y"))
    stats = orders.groupBy("player_id").agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    spread = F.coalesce("_s", F.lit(0.0))
    bounds = stats.select(
        "player_id", S.interval_low("_m", spread).alias("lo"), S.interval_high("_m", spread).alias("hi")
    )
    who = frames.customers(spark, folder).select("player_id", "position").join(bounds, "player_id")
    return metrics.coverage(orders.join(who, "player_id"), ["position"])


def residual_interval(spark, folder, before: int) -> tuple[DataFrame, DataFrame]:
    """Naive predictions, and their residual quantiles over the seasons before ``before``."""
    predictions = materialise(naive_predictions(spark, folder))
    train = predictions.filter(F.col("season") < before)
    return predictions, conformal.residual_quantiles(train, ["position"])


@query
def quantile_base(spark, folder):
    newest = newest_season(spark, folder)
    predictions, quantiles = residual_interval(spark, folder, newest)
    test = predictions.filter(F.col("season") == newest)
    bounds = conformal.raw_interval(test, quantiles, ["position"])
    return bounds.select("player_id", "position", *[F.round(c, 8).alias(c) for c in ("lo", "hi")])


@query
def conformal_interval(spark, folder):
    """Margin and test coverage, raw and calibrated, per segment: the newest season is tested, the one before it calibrates."""
    calibrating, newest = seasons_of(spark, folder)[-2:]
    predictions, quantiles = residual_interval(spark, folder, calibrating)
    recent = predictions.filter(F.col("season") >= calibrating)
    bounded = conformal.raw_interval(recent, quantiles, ["position"])
    margins = conformal.conformal_margin(
        bounded.filter(F.col("season") == calibrating), ["position"]
    )
    test = conformal.widen(bounded.filter(F.col("season") == newest), margins, ["position"])
    hits = {"raw_coverage": metrics.hit("y", "lo", "hi"), "coverage": metrics.hit("y", "cal_lo", "cal_hi")}
    return (
        test.groupBy("position")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(h).alias(name) for name, h in hits.items()])
        .join(margins.select("position", F.round("margin", 8).alias("margin")), "position")
    )


ENSEMBLE_FEATURES = ["y_lag1", "teammate_y_prev", "adp"]
ENSEMBLE_DECAY = 0.8


@query
def ensemble_ml(spark, folder):
    """Ridge, forest and boosted trees of every season that has one before it, averaged.

    Ridge comes from the moments of the seasons, for all folds in one pass; the trees are fitted fold by fold.
    """
    lagged = features.teammate_production(frames.player_seasons(spark, folder), ["y"])
    rows = materialise(lagged.select("player_id", "season", "position", "y", *ENSEMBLE_FEATURES))
    seasons = walkforward.tested_seasons(rows)
    weighted = rows.withColumn("recency", features.recency_weight("season", max(seasons, default=0), ENSEMBLE_DECAY))
    trees = walkforward.predict_folds(weighted, seasons, ENSEMBLE_FEATURES, SEGMENTS, weight="recency")
    filled = rows.fillna(0.0, ENSEMBLE_FEATURES)
    figures = materialise(moments.season_moments(filled, [*ENSEMBLE_FEATURES, "y"]))
    folds = moments.fold_moments(figures, seasons, [*ENSEMBLE_FEATURES, "y"], [ENSEMBLE_DECAY])
    tested = filled.filter(F.col("season").isin(*seasons))
    ridge = moments.predict(tested, moments.ridge(folds, ENSEMBLE_FEATURES), ENSEMBLE_FEATURES)
    keys = ["player_id", "season", "position", "y"]
    both = trees.select(*keys, "y_hat").unionByName(ridge.select(*keys, "y_hat"))
    return walkforward.ensemble(both, keys)


# Subscriber tables


def event_rows(spark, folder, kind: str) -> DataFrame:
    """Events of a type as list rows keyed by user."""
    return (
        frames.events(spark, folder)
        .filter(F.col("event_type") == kind)
        .select("user_id", frames.source_of("k").alias("source"), "ts", "event_id")
    )


def user_list(spark, folder) -> DataFrame:
    """The list before the events: the customers of the first nations, signed up at the start."""
    return (
        frames.customers(spark, folder)
        .filter(F.col("team") < 12)
        .select(
            F.col("player_id").alias("user_id"),
            F.lit("landing").alias("source"),
            F.lit("2023-12-31 00:00:00").cast("timestamp").alias("ts"),
            F.lit(-1).cast("bigint").alias("event_id"),
        )
    )


@query
def upsert_latest(spark, folder):
    rows = event_rows(spark, folder, "signup")
    merged = merge.upsert(user_list(spark, folder), rows, ["user_id"], ["ts", "event_id"])
    return merged.select("user_id", "source", "event_id")


@query
def insert_ignore(spark, folder):
    rows = event_rows(spark, folder, "signup")
    merged = merge.insert_ignore(user_list(spark, folder), rows, ["user_id"], ["ts", "event_id"])
    return merged.select("user_id", "source", "event_id")


def accepted_signups(spark, folder) -> DataFrame:
    filled = rules.signup_sources(frames.signups(frames.events(spark, folder)))
    return rules.split(filled, rules.EMAIL_RULES)[0]


@query
def register_flow(spark, folder):
    """The profiles and the list, by address, after sign-ups and registrations; some users had a profile."""
    accepted = accepted_signups(spark, folder)
    known = frames.customers(spark, folder).filter(F.col("team") < 12)
    stored = having(
        frames.profiles(spark, folder), known.select(F.col("player_id").cast("string").alias("id")), ["id"]
    )
    profiles = merge.registered_profiles(accepted, stored).select(
        "email", "id", "plan", F.unix_micros("created_at").alias("opened_us")
    )
    listed = merge.email_list(accepted).select("email", "source", F.unix_micros("created_at").alias("created_us"))
    return profiles.join(listed, "email", "full")


@query
def email_list(spark, folder):
    """Both sign-up paths in one list: captures overwrite, registrations only add."""
    accepted = accepted_signups(spark, folder)
    return merge.email_list(accepted).select("email", "source", F.unix_micros("created_at").alias("created_us"))


def paid_profiles(spark, folder) -> DataFrame:
    payments = merge.completed_payments(frames.payment_events(frames.events(spark, folder)))
    return merge.apply_payments(frames.profiles(spark, folder), payments, F.lit(UPDATED).cast("timestamp"))


def profile_columns() -> list[Column]:
    times = [F.unix_micros(c).alias(f"{c}_us") for c in ("paid_at", "updated_at")]
    return [F.col("id"), F.col("plan"), F.col("plan_type"), F.col("season_paid"), *times]


@query
def payment_merge(spark, folder):
    """Every event's user with the plan after all payments; users without a profile are free."""
    users = frames.events(spark, folder).select(F.col("user_id").cast("string").alias("id"))
    everyone = users.unionByName(frames.profiles(spark, folder).select("id")).distinct()
    planned = merge.with_profile(everyone, paid_profiles(spark, folder))
    return planned.select(*profile_columns())


@query
def quarantine(spark, folder):
    filled = rules.signup_sources(frames.signups(frames.events(spark, folder)))
    checked = rules.check(filled, rules.EMAIL_RULES)
    return rules.slice_counts(
        checked.withColumn("outcome", F.coalesce("reject_reason", F.lit("accepted"))), ["outcome", "source"]
    )


@query
def key_checks(spark, folder):
    lines = frames.table(spark, folder, "lineitem")
    orders = frames.table(spark, folder, "orders")
    customer = frames.table(spark, folder, "customer")
    users = frames.events(spark, folder).select("user_id", "event_id")

    def tally(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")

    found = [
        tally("duplicate_lines", rules.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])),
        tally("lines_without_order", rules.orphans(lines, orders, "l_orderkey", "o_orderkey")),
        tally("lines_with_order", rules.cascade(lines, orders, "l_orderkey", "o_orderkey")),
        tally("customers_without_orders", rules.orphans(customer, orders, "c_custkey", "o_custkey")),
        tally("events_of_customers", rules.cascade(users, customer, "user_id", "c_custkey")),
    ]
    return ranking.union_boards(*found)


@query
def subscriber_slices(spark, folder):
    return rules.slice_counts(paid_profiles(spark, folder), ["plan", "plan_type", "season_paid"])


@query
def own_rows(spark, folder):
    rows = rules.visible_to(frames.table(spark, folder, "events"), PRINCIPAL, "user_id")
    return rows.select("event_id", "user_id", "event_type", "value")


@query
def distinct_keys(spark, folder):
    return rules.distinct_keys(frames.events(spark, folder), "user_id", ["event_type"])


@query
def signup_conversion(spark, folder):
    events = frames.events(spark, folder)
    signups = events.filter(F.col("event_type") == "signup").select(
        "event_id", "user_id", "ts", frames.source_of("k").alias("source")
    )
    paid = events.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("paid_ts"), F.col("event_id").alias("paid_id")
    )
    joined = features.asof_join(
        signups, paid, ["user_id"], "ts", "paid_ts", "paid_id", "event_id", direction="forward"
    )
    return merge.signup_conversion(joined, 7, ["source"])


@query
def stream_payment(spark, folder):
    """The profiles after the event files went through the payment stream."""
    events = frames.event_stream(spark, folder)
    target = scratch_path(spark, "payments")
    run = ingest.payment_stream(frames.payment_events(events), f"{target}/log", f"{target}/progress")
    run.awaitTermination()
    profiles = frames.profiles(spark, folder)
    paid = ingest.profiles_after_payments(profiles, f"{target}/log", F.lit(UPDATED).cast("timestamp"))
    return paid.select(*profile_columns())


@query
def payment_quarantine(spark, folder):
    """The profiles after a payment stream that also brings plan types no profile can hold, and how many of those."""
    events = frames.payment_events(frames.event_stream(spark, folder), unlisted_from=90)
    target = scratch_path(spark, "quarantine")
    ingest.payment_stream(
        events, f"{target}/log", f"{target}/progress", rejected_path=f"{target}/rejected"
    ).awaitTermination()
    rejected = ingest.read_batches(spark, f"{target}/rejected", ingest.REJECTED_PAYMENTS)
    counts = rules.slice_counts(rejected.withColumnRenamed("user_id", "id"), ["id"], "n_rejected")
    paid = ingest.profiles_after_payments(frames.profiles(spark, folder), f"{target}/log")
    return paid.join(counts, "id", "left").select(
        "id",
        "plan",
        "plan_type",
        F.unix_micros("paid_at").alias("paid_at_us"),
        F.coalesce("n_rejected", F.lit(0).cast("bigint")).alias("n_rejected"),
    )


@query
def stream_compacted(spark, folder):
    """The profiles after a payment stream, whose log is compacted, and a new stream that reads everything again."""
    target = scratch_path(spark, "compacted")
    for log, progress in (("log", "first"), ("base", "second")):
        events = frames.payment_events(frames.event_stream(spark, folder))
        ingest.payment_stream(events, f"{target}/{log}", f"{target}/{progress}").awaitTermination()
        if log == "log":
            ingest.compact(spark, f"{target}/log", f"{target}/base", schemas.PAYMENTS, ingest.fold_payments)
    at = F.lit(UPDATED).cast("timestamp")
    paid = ingest.profiles_after_payments(frames.profiles(spark, folder), f"{target}/base", at)
    return paid.select(*profile_columns())


@query
def stream_repeats(spark, folder):
    """Payments per user, from JSON bodies in several files, out of order and half of them sent twice."""
    target = scratch_path(spark, "repeats")
    sent = frames.payment_events(frames.events(spark, folder))
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    bodies = sent.select(F.to_json(F.struct("*"), exact).alias("value"), F.col("ts"))
    bodies.select("value").repartition(3).write.text(f"{target}/bodies")
    again = bodies.filter(F.second("ts") < 30).select("value")
    again.repartition(1).write.mode("append").text(f"{target}/bodies")
    stream = readers.events_of(
        readers.read_bodies(spark, f"{target}/bodies", maxFilesPerTrigger=1), schemas.PAYMENT_EVENTS
    )
    once = ingest.without_repeats(merge.completed_payments(stream), delay="3650 days")
    ingest.start(
        once, lambda rows, batch: ingest.write_batch(rows, f"{target}/log", batch), f"{target}/progress"
    ).awaitTermination()
    payments = ingest.read_batches(spark, f"{target}/log", schemas.PAYMENTS)
    return payments.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_payments"), F.max(F.unix_micros("ts")).alias("last_us")
    )


@query
def stream_conversion(spark, folder):
    """``signup_conversion`` from a join of two streams."""
    target = scratch_path(spark, "conversion")
    events = frames.event_stream(spark, folder)
    signups = events.filter(F.col("event_type") == "signup").select(
        "event_id", "user_id", "ts", frames.source_of("k").alias("source")
    )
    payments = events.filter(F.col("event_type") == "purchase").select("user_id", "ts")
    for rows, name in ((signups, "signups"), (ingest.conversions(signups, payments), "matches")):
        ingest.start(
            rows, lambda r, batch, name=name: ingest.write_batch(r, f"{target}/{name}", batch), f"{target}/{name}-progress"
        ).awaitTermination()
    came = ingest.read_batches(
        spark, f"{target}/signups", T.StructType.fromDDL("event_id bigint, ts timestamp, source string")
    )
    matches = ingest.read_batches(
        spark, f"{target}/matches", T.StructType.fromDDL("event_id bigint, paid_ts timestamp")
    )
    return merge.signup_conversion(ingest.first_conversions(came, matches), 7, ["source"])


@query
def stream_signup(spark, folder):
    """The e-mail list after the event files went through the sign-up stream."""
    target = scratch_path(spark, "signups")
    run = ingest.signup_stream(
        frames.signups(frames.event_stream(spark, folder)), f"{target}/log", f"{target}/rejected", f"{target}/progress"
    )
    run.awaitTermination()
    listed = ingest.email_list(spark, f"{target}/log")
    return listed.select("email", "source", F.unix_micros("created_at").alias("created_us"))
