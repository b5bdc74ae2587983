import json
from datetime import datetime

import pytest
from frames_help import values
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk import schemas
from boardwalk.__main__ import main as command_line
from boardwalk.plans import boards
from boardwalk.sources import readers, sinks

UPDATED = datetime(2026, 4, 20)


def player(key, position, points, **more):
    return {"player_id": key, "player_name": key.upper(), "position": position, "team": "GB", "projected_points": points, **more}


@pytest.fixture
def data(tmp_path):
    """A small data folder in the shapes of the products: arrays, maps and one document."""
    players = [
        player("q1", "QB", 154.8, adp=106.5, ci_low=61, ci_high=118.0, risk="low"),
        player("q2", "QB", 154.8, adp=127.5, uncertainty=15, risk="HIGH"),
        player("q3", "QB", 20.0, adp=0),
        player("q4", "QB", 19.9, adp=5.0),
        player("r1", "RB", 90.0, adp=250.0, team=None),
        player("k1", "K", 95.0),
    ]
    gaps = [
        {"player_name": "A", "position": "QB", "projected_points": 172.4, "model_rank": 13, "adp": 169.0, "adp_gap": 156.0, "label": "SLEEPER", "reason": "why"},
        {"player_name": "B", "position": "WR", "team": "MIA", "projected_points": 59.0, "model_rank": 142, "adp": 30.5, "adp_gap": -111.5, "label": "BUST"},
        {"player_name": "C", "position": "QB", "team": "GB", "projected_points": 154.8, "model_rank": 19, "adp": 131.0, "adp_gap": 111.5, "label": "SLEEPER"},
    ]
    config = {"roster_slots": {"qb": 1, "rb": 1, "k": 1}, "flex_eligible": ["rb"], "bench_size": 6, "num_teams": 1, "scoring_format": "half_ppr"}
    (tmp_path / "projections.json").write_text(json.dumps(players, indent=2))
    (tmp_path / "gaps.json").write_text(json.dumps(gaps))
    (tmp_path / "byes.json").write_text(json.dumps({"LA": 8, "LAR": 8, "GB": 5}))
    (tmp_path / "roster.json").write_text(json.dumps(config))
    return tmp_path


def test_arrays_on_one_line_or_many(spark, data):
    players = readers.read_records(spark, str(data / "projections.json"), schemas.PROJECTIONS)
    assert players.schema == schemas.PROJECTIONS
    assert values(players.filter("position = 'QB'"), "player_id", "ci_low", "uncertainty") == [
        ("q1", 61.0, None),
        ("q2", None, 15.0),
        ("q3", None, None),
        ("q4", None, None),
    ]
    assert readers.read_records(spark, str(data / "gaps.json"), schemas.VALUE_GAPS).count() == 3


def test_malformed_input_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"player_id": "a"}, {"player_id": ')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_records(spark, str(tmp_path / "bad.json"), schemas.PROJECTIONS).collect()


def test_optional_source_is_empty_when_missing(spark, data):
    path = data / "errors.json"
    assert boards.read_accuracy(spark, str(path)).count() == 0
    path.write_text(json.dumps({"QB": {"best_model": "boosted", "mae": 62, "rmse": 80.19, "r2": 0.63}}))
    found = boards.read_accuracy(spark, str(path))
    assert values(found, "position", "best_model", "mae") == [("QB", "boosted", 62.0)]
    path.write_text("{")
    with pytest.raises(Exception, match="MALFORMED"):
        boards.read_accuracy(spark, str(path)).collect()
    with pytest.raises(AnalysisException):
        readers.read_records(spark, str(data / "none.json"), schemas.PROJECTIONS)


def test_maps_become_rows(spark, data):
    byes = readers.read_map(spark, str(data / "byes.json"), T.IntegerType(), key="team", out="bye")
    assert values(byes, "team", "bye") == [("GB", 5), ("LA", 8), ("LAR", 8)]


def test_payloads(rows):
    bodies = ['{"email": "a@x", "ts": "2026-01-01T00:00:00Z"}', "not json", '{"email": "b@x"}', ""]
    df = rows([(b,) for b in bodies], "value string")
    events = readers.events_of(df, schemas.SIGNUP_EVENTS)
    assert events.schema == schemas.SIGNUP_EVENTS
    assert values(events, "email", "ts") == [("a@x", datetime(2026, 1, 1))]
    assert values(readers.malformed_of(df, schemas.SIGNUP_EVENTS), "value") == [("",), ("not json",), (bodies[2],)]


def test_find_by_key(rows):
    found = readers.find_by_key(rows([("a",), ("z",)], "id string"), rows([("a", 1), ("b", 2)], "id string, v int"))
    assert values(found, "id", "v") == [("a", 1), ("z", None)]


def test_publishing_replaces_only_the_boards_written(spark, data, tmp_path):
    site = str(tmp_path / "site")
    assert boards.publish(spark, str(data / "projections.json"), str(data / "gaps.json"), site, UPDATED) == {"n_active": 5, "n_gaps": 3, "n_rows": 7}
    published = spark.read.parquet(site)
    ranks = published.filter("board = 'qb-rankings'")
    assert values(ranks, "rank_label", "player_name", "points", "interval", "market_rank", "risk", "updated") == [
        ("QB1", "Q1", "154.8", "61–118", "106", "LOW", "April 20, 2026"),
        ("QB2", "Q2", "154.8", "0–0", "128", "HIGH", "April 20, 2026"),
        ("QB3", "Q3", "20.0", "0–0", "0", "MED", "April 20, 2026"),
    ]
    assert values(published.filter("board = 'rb-rankings'"), "team", "market_rank") == [("", "—")]
    assert values(published.filter("board like 'top-%'"), "board", "rank", "player_name", "team", "market_rank", "gap", "reason") == [
        ("top-busts", 1, "B", "MIA", "30", "-111", ""),
        ("top-sleepers", 1, "A", "FA", "169", "+156", "why"),
        ("top-sleepers", 2, "C", "GB", "131", "+111", ""),
    ]
    sinks.publish_boards(spark.createDataFrame([("qb-rankings", 1)], "board string, rank int"), site)
    counts = spark.read.schema("rank int, board string").parquet(site).groupBy("board").count()
    assert values(counts, "board", "count") == [("qb-rankings", 1), ("rb-rankings", 1), ("top-busts", 1), ("top-sleepers", 2)]
    (data / "gaps.json").write_text("[]")
    boards.publish(spark, str(data / "projections.json"), str(data / "gaps.json"), site, UPDATED)
    assert values(spark.read.parquet(site).select("board").distinct(), "board") == [("qb-rankings",), ("rb-rankings",)]


def test_export_and_read_back(spark, data, rows, tmp_path):
    stats = rows(
        [("q1", "QB", 2019, 4000.0, 0), ("q1", "QB", 2025, 5000.0, 2), ("r1", "RB", 2025, None, 40)],
        "player_id string, position string, season int, passing_yards double, receptions int",
    )
    players = readers.read_records(spark, str(data / "projections.json"), schemas.PROJECTIONS)
    config = readers.read_roster_config(spark, str(data / "roster.json"))
    boards.export_static(stats, players, config, str(tmp_path / "out"), seasons=5)
    points = spark.read.json(str(tmp_path / "out" / "season_points"))
    assert values(points, "player_id", "season", "points") == [("q1", 2025, 201.0), ("r1", 2025, 20.0)]
    exported = readers.read_records(spark, str(tmp_path / "out" / "players"), schemas.PROJECTIONS)
    assert values(exported, "player_id", "vbd")[0] == ("k1", 0.0) and exported.count() == 6
    table = readers.read_records(spark, str(tmp_path / "out" / "scarcity"), schemas.SCARCITY, lines=True)
    assert values(table, "position", "top_pts", "replacement_pts") == [("QB", 154.8, 154.8), ("RB", 90.0, 90.0)]
    with pytest.raises(ValueError):
        boards.season_points(stats, "unknown")


def test_command_line(spark, data, rows, tmp_path, capsys):
    players, gaps, roster = (str(data / f"{n}.json") for n in ("projections", "gaps", "roster"))
    command_line(["boards", players, gaps, str(tmp_path / "site")])
    assert "wrote 7 board rows" in capsys.readouterr().out
    stats = rows([("q1", "QB", 2025, 100.0, 4)], "player_id string, position string, season int, rec_yards double, receptions int")
    stats.write.parquet(str(tmp_path / "stats"))
    command_line(["export", str(tmp_path / "stats"), players, roster, str(tmp_path / "out"), "--scoring", "ppr"])
    assert values(spark.read.json(str(tmp_path / "out" / "season_points")), "points") == [(14.0,)]


def test_append_new_keeps_the_first(spark, rows, tmp_path):
    path = str(tmp_path / "profiles")
    schema = "id string, at int"
    rows([("a", 1)], schema).write.parquet(path)
    for _ in range(2):
        sinks.append_new(spark.read.parquet(path), rows([("a", 9), ("b", 3), ("b", 2)], schema), path, ["id"], ["at"])
    assert values(spark.read.parquet(path), "id", "at") == [("a", 1), ("b", 2)]


def test_partition_filter_reaches_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "slices")
    rows([("a", "free"), ("b", "paid")], "id string, plan string").write.partitionBy("plan").parquet(path)
    plan = spark.read.parquet(path).filter(F.col("plan") == "paid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(plan" in plan
