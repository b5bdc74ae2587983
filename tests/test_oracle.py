"""Every query against its SQL, on the given tables."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from boardwalk.plans import frames
from boardwalk.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.01"
WITHOUT_SQL = {"ensemble_ml"}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    assert differences(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) == []


def test_every_query_but_the_fits_has_sql():
    assert set(REGISTRY) - set(entry.oracle_sql()) == WITHOUT_SQL


def test_entry_has_rows(spark):
    board = entry.entry(spark)
    assert board.columns == ["player_id", "position", "rank", "rank_label", "points"]
    assert board.count() > 0


def test_ensemble_covers_every_season_but_the_oldest(spark):
    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["ensemble_ml"](spark, folder).collect()
    seasons = {r.season for r in frames.season_points(spark, folder).select("season").distinct().collect()}
    assert {r.season for r in rows} == seasons - {min(seasons)}
    assert all(r.n_models == 3 and r.uncertainty >= 0 for r in rows)
    assert len({(r.player_id, r.season) for r in rows}) == len(rows) > 0


def test_ensemble_beats_the_mean_of_each_segment(spark):
    """The figures of the trees have no SQL: held against the plain mean of earlier seasons on held-out ones."""
    folder = "/root/testdata/sf0.01"
    rows = entry.queries()["ensemble_ml"](spark, folder)
    points = frames.player_seasons(spark, folder).select("season", "position", "y")
    means = rows.select("season", "position").distinct().alias("t").join(points.alias("p"), (points.season < rows.season) & (points.position == rows.position))
    means = means.groupBy("t.season", "t.position").agg({"y": "avg"}).withColumnRenamed("avg(y)", "mean")
    errors = rows.join(means, ["season", "position"]).selectExpr("avg(power(y - y_hat, 2)) as own", "avg(power(y - mean, 2)) as plain").first()
    assert errors.own < errors.plain
