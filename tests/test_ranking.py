import random

import pytest
from frames_help import values
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators import ranking as R
from boardwalk.operators.slices import sliced


@pytest.fixture
def players(rows):
    return rows(
        [
            ("a", "QB", 154.8, 139.5),
            ("b", "QB", 154.8, 131.0),
            ("c", "QB", None, 5.0),
            ("d", "RB", 20.0, 199.5),
            ("e", "RB", 19.9, 30.0),
            ("f", "RB", 0.0, None),
            ("g", "K", 90.0, 150.0),
        ],
        "player_id string, position string, projected_points double, adp double",
    )


def test_active_keeps_the_least_projection(players):
    assert values(R.active(players), "player_id") == [("a",), ("b",), ("d",), ("g",)]


def test_boards_have_a_limit_per_group_and_break_ties_by_id(players):
    board = R.position_boards(players, {"QB": 2, "RB": 5})
    assert values(board, "position", "rank", "player_id", "rank_label") == [
        ("QB", 1, "a", "QB1"),
        ("QB", 2, "b", "QB2"),
        ("RB", 1, "d", "RB1"),
        ("RB", 2, "e", "RB2"),
        ("RB", 3, "f", "RB3"),
    ]


def test_boards_limit_rows_before_the_shuffle(players):
    plan = R.position_boards(players, {"QB": 2})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_top_beyond_the_map_side_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 5000).alias("v"), "id")
    top = R.top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 1500)
    assert top.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("m")).select("n", "m").distinct().collect() == [(1500, 1500)]


def skewed(rows, seed=3):
    """Random rows where one group, one value and one (group, value) hold a third or more."""
    random.seed(seed)
    data = []
    for i in range(3000):
        group = "hot" if random.random() < 0.5 else random.choice(["x", "y", None])
        value = 7.0 if random.random() < 0.4 else float(random.randint(0, 50))
        data.append((i, group, None if random.random() < 0.05 else value))
    random.shuffle(data)
    return data, rows(data, "id int, g string, v double")


def test_a_hot_group_spans_slices(rows, many_slices):
    _, df = skewed(rows)
    found = sliced(df.filter("g = 'hot'"), ["g"], [F.col("v").desc(), F.col("id")])
    sizes = [r["count"] for r in found.groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_row_rank_is_a_permutation_in_order(rows, many_slices):
    data, df = skewed(rows)
    ranked = R.row_rank(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")])
    expected = []
    for group in ("hot", "x", "y", None):
        members = sorted((r for r in data if r[1] == group), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        expected += [(r[0], place) for place, r in enumerate(members, 1)]
    assert values(ranked, "id", "rank") == sorted(expected)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_average_ranks(rows, many_slices, groups):
    data, df = skewed(rows)
    df = df.filter(F.col("g").isNotNull() & F.col("v").isNotNull())
    ranked = R.average_rank(df, "v", "avg_rank", groups)
    kept = [r for r in data if r[1] is not None and r[2] is not None]
    expected = []
    for r in kept:
        peers = [o[2] for o in kept if not groups or o[1] == r[1]]
        expected.append((r[0], sum(v > r[2] for v in peers) + (peers.count(r[2]) + 1) / 2))
    assert values(ranked, "id", "avg_rank") == sorted(expected)
    n = len(kept)
    if not groups:
        assert sum(v for _, v in expected) == n * (n + 1) / 2


def test_a_row_without_a_value_is_kept_without_a_rank(rows):
    df = rows([("a", 2.0), ("b", None), ("c", 2.0)], "id string, v double")
    assert values(R.average_rank(df, "v", "r"), "id", "r") == [("a", 1.5), ("b", None), ("c", 1.5)]


def test_gap_uses_the_uncut_rank_and_labels_by_sign(rows):
    df = rows(
        [("a", 19.5, 139.5), ("b", 19.5, 131.0), ("c", 142.0, 30.0), ("d", 50.0, 92.0), ("e", 50.0, 50.0), ("f", 1.0, None)],
        "player_id string, avg_rank double, adp double",
    )
    gaps = R.value_gap(df)
    assert values(gaps, "player_id", "model_rank", "adp_gap", "label") == [
        ("a", 19, 120.0, "SLEEPER"),
        ("b", 19, 111.5, "SLEEPER"),
        ("c", 142, -112.0, "BUST"),
        ("d", 50, 42.0, "SLEEPER"),
        ("e", 50, 0.0, None),
        ("f", 1, None, None),
    ]
    assert values(R.value_gap(df, min_gap=42.0), "player_id") == [("a",), ("b",), ("c",), ("d",)]
    boards = R.gap_boards(gaps, size=2)
    assert values(boards, "label", "rank", "player_id") == [("BUST", 1, "c"), ("SLEEPER", 1, "a"), ("SLEEPER", 2, "b")]
    assert values(R.of_label(gaps, S.BUST), "player_id") == [("c",)]
    with pytest.raises(ValueError):
        R.of_label(gaps, "OTHER")


def test_union_fills_missing_columns(rows):
    board = R.union_boards(rows([("a", 1.0)], "id string, x double"), rows([("k", "K")], "id string, p string"))
    assert values(board, "id", "x", "p") == [("a", 1.0, None), ("k", None, "K")]
