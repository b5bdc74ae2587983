import pytest
from frames_help import values

from boardwalk import schemas
from boardwalk.operators import risk, scarcity

CONFIG = {
    "roster_slots": {"qb": 1, "rb": 2, "flex": 1, "k": 1, "defense": 1, "bench": 6},
    "flex_eligible": ["rb", "te"],
    "bench_size": 6,
    "num_teams": 2,
    "scoring_format": "half_ppr",
}


@pytest.fixture
def config(spark):
    return spark.createDataFrame([CONFIG], schemas.ROSTER_CONFIG)


@pytest.fixture
def players(rows):
    data = [(f"q{i}", "QB", p) for i, p in enumerate([30.0, 24.0, 20.0, 10.0, None])]
    data += [(f"r{i}", "RB", p) for i, p in enumerate([50.0, 40.0, 40.0, 22.0, 12.0, 9.0])]
    data += [("k0", "K", 90.0), ("x0", "XX", 5.0)]
    return rows(data, "player_id string, position string, projected_points double")


def test_starters_come_from_slots_and_teams(config):
    assert values(scarcity.starters_needed(config), "position", "slots", "starters_needed") == [
        ("DEF", 1, 2),
        ("K", 1, 2),
        ("QB", 1, 2),
        ("RB", 2, 4),
    ]
    assert values(scarcity.flex_positions(config), "position") == [("RB",), ("TE",)]


def test_scarcity(players, config):
    table = scarcity.scarcity(players, scarcity.starters_needed(config))
    columns = ("position", "top_pts", "replacement_pts", "dropoff", "dropoff_per_slot", "tier_gap", "n_players", "scarcity_rank")
    assert values(table, *columns) == [
        ("K", 90.0, None, None, None, None, 1, 3),
        ("QB", 30.0, 24.0, 6.0, 6.0, 12.0, 5, 2),
        ("RB", 50.0, 22.0, 28.0, 14.0, 27.5, 6, 1),
    ]


def test_published_identities(rows, spark):
    """Published figures: drop per slot rounds half up, and the order is that of the tier gap."""
    tops = {"RB": (221.1, 94.9, 2, 63.1), "WR": (192.8, 103.1, 2, 44.9), "QB": (198.8, 143.2, 1, 55.6), "TE": (136.1, 71.7, 1, 64.4)}
    data = [(f"{p}{i}", p, t if i == 0 else r) for p, (t, r, s, _) in tops.items() for i in range(s * 12)]
    needed = spark.createDataFrame([(p, s, s * 12) for p, (_, _, s, _) in tops.items()], "position string, slots int, starters_needed int")
    table = scarcity.scarcity(rows(data, "player_id string, position string, projected_points double"), needed)
    assert values(table, "position", "dropoff_per_slot") == [(p, v[3]) for p, v in sorted(tops.items())]


def test_value_over_replacement(players, config):
    valued = scarcity.value_over_replacement(players, scarcity.starters_needed(config))
    found = {r.player_id: r.vbd for r in valued.collect()}
    assert found["q0"] == 6.0 and found["q4"] == -24.0 and found["r4"] == -10.0
    assert found["k0"] == 0.0 and found["x0"] == 0.0
    assert len(found) == 13


def test_draft_state(players, config, rows):
    left = scarcity.remaining(players, rows([("q0",), ("q0",), ("zz",)], "player_id string"))
    assert left.count() == 12
    levels = scarcity.replacement_levels(left, scarcity.starters_needed(config))
    assert values(levels, "position", "replacement_pts") == [("QB", 20.0), ("RB", 22.0)]


def test_flex_pool_takes_what_starters_leave(players, config):
    pool = scarcity.flex_pool(players, scarcity.starters_needed(config), ["RB", "QB"], 3)
    assert values(pool, "flex_rank", "player_id", "group_rank") == [(1, "q2", 3), (2, "r4", 5), (3, "q3", 4)]


def test_interval_and_fixed_risk(rows):
    df = rows([("a", 98.3, 45.0), ("b", 10.0, 20.0)], "player_id string, projected_points double, uncertainty double")
    board = risk.spread_risk(risk.add_interval(df))
    assert values(board, "player_id", "ci_low", "ci_high", "risk") == [("a", 41.0, 156.0, "high"), ("b", 0.0, 36.0, "high")]


def test_quartile_risk(rows):
    data = [(i, "QB", 10.0, 0.0, float(i)) for i in range(1, 9)] + [(9, "RB", 0.0, 0.0, 4.0), (10, "RB", 5.0, 1.0, 2.0)]
    df = rows(data, "id int, position string, projected_points double, ci_low double, ci_high double")
    found = dict(values(risk.quartile_risk(df), "id", "risk"))
    assert [found[i] for i in range(1, 9)] == ["low", "low"] + ["medium"] * 4 + ["high", "high"]
    assert found[9] == "medium" and found[10] == "low"
