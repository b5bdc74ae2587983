import random
from datetime import date, datetime, timedelta

import pytest
from frames_help import values
from pyspark.sql import functions as F

from boardwalk.operators import features as X


def test_bye_by_alias_and_default(rows):
    players = rows([("a", "LA"), ("b", "LAR"), ("c", "JAC"), ("d", "ZZ"), ("e", None)], "player_id string, team string")
    byes = rows([("LAR", 8), ("LA", 8), ("JAX", 8), ("GB", 5)], "team string, bye int")
    assert values(X.add_bye(players, byes), "player_id", "team", "bye") == [
        ("a", "LA", 8),
        ("b", "LAR", 8),
        ("c", "JAC", 8),
        ("d", "ZZ", 0),
        ("e", None, 0),
    ]


STATS = [
    ("a", 2020, "X", 10),
    ("a", 2021, "X", 20),
    ("a", 2023, "Y", 40),
    ("b", 2020, "Y", 5),
    ("b", 2021, "X", 7),
    ("c", 2021, "Z", 9),
    ("d", 2020, "X", 3),
    ("d", 2021, "X", None),
]


@pytest.fixture
def stats(rows):
    return rows(STATS, "player_id string, season int, team string, targets int")


def test_lag_is_null_after_a_skipped_season(stats):
    lagged = X.season_lag(stats, ["targets"])
    assert values(lagged, "player_id", "season", "targets_lag1") == [
        ("a", 2020, None),
        ("a", 2021, 10),
        ("a", 2023, None),
        ("b", 2020, None),
        ("b", 2021, 5),
        ("c", 2021, None),
        ("d", 2020, None),
        ("d", 2021, 3),
    ]


def test_teammates_follow_the_new_team(stats):
    found = X.teammate_production(stats, ["targets"])
    by_row = {(p, s): v for p, s, v in values(found, "player_id", "season", "teammate_targets_prev")}
    assert by_row[("a", 2021)] == 8  # b brings its 5 of the old team, d its 3
    assert by_row[("b", 2021)] == 13
    assert by_row[("c", 2021)] == 0 and by_row[("a", 2023)] == 0


def test_team_totals(stats):
    assert ("X", 2021, 27) in values(X.team_season_totals(stats, ["targets"]), "team", "season", "targets_total")


def brute_asof(asks, points, direction):
    out = []
    for aid, user, at in asks:
        best = None
        for t, pid in points.get(user, []):
            if direction == "backward" and t > at or direction == "forward" and t <= at:
                continue
            order = (abs(t - at), t, pid)
            if best is None or order < best[0]:
                best = (order, pid)
        out.append((aid, best and best[1]))
    return sorted(out)


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("seconds", [3600, 86400 * 40])
def test_asof_against_brute_force(rows, many_slices, direction, seconds):
    random.seed(5)
    start = datetime(2024, 1, 1)
    users = ["hot"] * 5 + ["b", "c"]
    asks, points, table = [], {}, []
    for i in range(400):
        at = start + timedelta(seconds=random.randrange(seconds) // 600 * 600)
        asks.append((i, random.choice(users + ["none"]), at))
    for i in range(150):
        user, at = random.choice(users), start + timedelta(seconds=random.randrange(seconds) // 600 * 600)
        points.setdefault(user, []).append((at, i))
        table.append((user, at, i))
    found = X.asof_join(
        rows(asks, "aid int, user string, ts timestamp"),
        rows(table, "user string, pts timestamp, pid int"),
        ["user"],
        "ts",
        "pts",
        "pid",
        "aid",
        direction=direction,
    )
    assert values(found, "aid", "pid") == brute_asof(asks, points, direction)
    assert found.columns == ["aid", "user", "ts", "pts", "pid"]


def test_asof_forms_no_pairs(rows):
    left = rows([(1, "a", datetime(2024, 1, 1))], "aid int, user string, ts timestamp")
    right = rows([("a", datetime(2024, 1, 2), 1)], "user string, pts timestamp, pid int")
    plan = X.asof_join(left, right, ["user"], "ts", "pts", "pid", "aid")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        X.asof_join(left, right, ["user"], "ts", "pts", "pid", "aid", direction="sideways")


def test_depth_snapshot_earlier_on_a_tie_and_null_without_one(rows):
    targets = rows([("a", 2025, date(2025, 9, 5)), ("b", 2025, date(2025, 9, 5))], "player_id string, season int, target_date date")
    snaps = rows(
        [("a", 2025, date(2025, 9, 1), 2), ("a", 2025, date(2025, 9, 9), 1), ("a", 2025, date(2025, 6, 1), 3), ("b", 2024, date(2024, 9, 5), 1)],
        "player_id string, season int, snapshot_date date, depth_rank int",
    )
    assert values(X.depth_snapshot(targets, snaps), "player_id", "depth_rank") == [("a", 2), ("b", None)]


def test_snapshot_target(rows):
    df = rows([(2024, date(2024, 9, 8)), (2025, date(2025, 9, 7))], "season int, opening date")
    found = df.select(X.snapshot_target("season", "opening").alias("d"))
    assert values(found, "d") == [(date(2024, 9, 8),), (date(2025, 9, 5),)]


def test_latest_and_earliest(rows):
    df = rows([("a", 1, 5, "x"), ("a", 2, 5, None), ("b", 1, 1, "z")], "k string, id int, t int, v string")
    assert values(X.latest_per_key(df, ["k"], ["t", "id"]), "k", "id", "v") == [("a", 2, None), ("b", 1, "z")]
    assert values(X.earliest_per_key(df, ["k"], ["t", "id"]), "k", "id") == [("a", 1), ("b", 1)]


def test_override_team(rows):
    roster = rows([("a", "X"), ("b", "Y")], "player_id string, team string")
    moves = rows([("a", "Q", 1), ("a", "R", 2), ("c", "S", 1)], "player_id string, team string, at int")
    assert values(X.override_team(roster, moves, ["at"]), "player_id", "team") == [("a", "R"), ("b", "Y")]


def test_merge_features_flags_missing(rows):
    base = rows([("a",), ("b",)], "player_id string")
    merged = X.merge_features(base, [rows([("a", 1)], "player_id string, draft int"), rows([("b", 2)], "player_id string, combine int")])
    assert values(merged, "player_id", "draft", "has_1", "combine", "has_2") == [("a", 1, 1, None, 0), ("b", None, 0, 2, 1)]


def test_zscore_composite(rows):
    df = rows([("a", "QB", 1.0, 5.0), ("b", "QB", 3.0, 5.0), ("c", "QB", 2.0, None), ("d", "TE", 9.0, 1.0)], "id string, position string, x double, y double")
    assert values(X.zscore_composite(df, {"x": 2.0, "y": 1.0}), "id", "athletic_score") == [("a", -2.0), ("b", 2.0), ("c", 0.0), ("d", 0.0)]


def test_recency_and_shrinkage(rows):
    df = rows([("a", 2021, 10.0), ("a", 2020, 20.0), ("b", 2021, None)], "id string, season int, v double")
    mean = X.weighted_mean(F.col("v"), X.recency_weight("season", 2021, 0.5))
    assert values(df.groupBy("id").agg(mean.alias("m")), "id", "m") == [("a", pytest.approx(20 / 1.5)), ("b", None)]
    hist = rows([("a", "K", 100.0), ("b", "K", 50.0), ("c", "K", None)], "id string, position string, h double")
    assert values(X.shrink_to_group(hist, "h", keep=0.6), "id", "projected_points") == [("a", 90.0), ("b", 60.0), ("c", 75.0)]


def test_null_keys_and_times_find_nothing(rows):
    asks = rows([(1, "a", 5), (2, None, 5), (3, "a", None)], "ask int, k string, t int")
    points = rows([(7, "a", 4), (8, None, 5), (9, "a", None)], "id int, k string, at int")
    found = {r.ask: r.id for r in X.asof_join(asks, points, ["k"], "t", "at", "id", "ask", direction="backward").collect()}
    assert found == {1: 7, 2: None, 3: None}
