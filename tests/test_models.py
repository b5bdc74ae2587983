import math
import random

import numpy as np
import pytest
from frames_help import values

from boardwalk.operators import conformal, metrics, walkforward


def test_folds_never_train_on_the_future(rows):
    df = rows([(i, s) for i in range(3) for s in (2019, 2020, 2021, 2022)], "id int, season int")
    folds = walkforward.walk_forward(df, [2021, 2022])
    assert values(folds.filter("role = 'train'").select("season", "test_season").distinct(), "season", "test_season") == [
        (2019, 2021),
        (2019, 2022),
        (2020, 2021),
        (2020, 2022),
        (2021, 2022),
    ]
    assert folds.filter("role = 'train' and season >= test_season").isEmpty()
    assert values(walkforward.fold_sizes(df, [2021, 2022]), "test_season", "n_train", "n_test", "last_train_season") == [
        (2021, 6, 3, 2020),
        (2022, 9, 3, 2021),
    ]


def test_baseline_is_the_least_squares_fit(rows):
    random.seed(2)
    data = [(i, "QB" if i % 3 else "RB", 2019 + i % 4, random.uniform(1, 200)) for i in range(300)]
    data = [(*d, 300 - 20 * math.log(d[3]) - 4 * math.log(d[3]) ** 2 + random.gauss(0, 5)) for d in data]
    df = rows(data, "player_id int, position string, season int, adp double, y double")
    fitted = walkforward.log_market_baseline(df, [2021, 2022])
    for r in fitted.collect():
        train = [d for d in data if d[1] == r.position and d[2] < r.test_season]
        x = np.log([d[3] for d in train])
        b2, b1, b0 = np.polyfit(x, [d[4] for d in train], 2)
        assert r.n_train == len(train)
        assert [r.b0, r.b1, r.b2] == pytest.approx([b0, b1, b2], rel=1e-6)
    predicted = walkforward.predict_baseline(df, fitted)
    assert predicted.count() == 300
    tested = predicted.filter("y_base is not null")
    assert {r.season for r in tested.select("season").distinct().collect()} == {2021, 2022}
    row, c = tested.first(), {(r.test_season, r.position): r for r in fitted.collect()}
    b, x = c[(row.season, row.position)], math.log(row.adp)
    assert row.y_base == pytest.approx(b.b0 + b.b1 * x + b.b2 * x * x)


def test_baseline_of_near_prices(rows):
    data = [("QB", 2019, 170.0 + i, 300 - 20 * math.log(170 + i)) for i in range(31)]
    fitted = walkforward.log_market_baseline(rows(data, "position string, season int, adp double, y double"), [2020]).first()
    x = math.log(180)
    assert fitted.b0 + fitted.b1 * x + fitted.b2 * x * x == pytest.approx(300 - 20 * x)


def test_degenerate_baseline_is_null(rows):
    df = rows([(1, "QB", 2019, 5.0, 1.0)], "player_id int, position string, season int, adp double, y double")
    assert values(walkforward.log_market_baseline(df, [2020]), "n_train", "b0") == [(1, None)]


def test_accuracy_and_best_model(rows):
    data = [("QB", "m", 10.0, 12.0), ("QB", "m", 20.0, 16.0), ("QB", "a", 10.0, 13.0), ("QB", "a", 20.0, 17.0), ("TE", "z", 5.0, 6.0)]
    table = metrics.accuracy(rows(data, "position string, model string, y double, y_hat double"), ["position", "model"])
    found = {(r.position, r.model): r for r in table.collect()}
    assert found["QB", "m"].mae == 3.0 and found["QB", "m"].rmse == pytest.approx(math.sqrt(10)) and found["QB", "m"].r2 == pytest.approx(0.6)
    assert found["TE", "z"].r2 is None
    assert values(metrics.best_model(table, ["position"]), "position", "best_model", "mae") == [("QB", "a", 3.0), ("TE", "z", 1.0)]


def test_r2_is_negative_when_worse_than_the_mean(rows):
    df = rows([("a", 0.0, 10.0), ("a", 1.0, -10.0)], "g string, y double, y_hat double")
    assert metrics.accuracy(df, ["g"]).first().r2 < 0


def test_season_metrics_average_seasons_not_rows(rows):
    data = [(2021, "QB", 10.0, 11.0, 14.0)] * 3 + [(2021, "TE", 4.0, 4.0, 8.0), (2022, "QB", 10.0, 15.0, 14.0), (2022, "QB", 20.0, 25.0, 14.0)]
    table = metrics.season_metrics(rows(data, "season int, position string, y double, y_hat double, y_base double"))
    found = {r.scope: r for r in table.collect()}
    assert found["QB"].mae == pytest.approx((1 + 5) / 2) and found["QB"].n_rows == 5 and found["QB"].n_seasons == 2
    assert found["Overall"].mae == pytest.approx((3 / 4 + 5) / 2)
    assert found["QB"].edge == pytest.approx(1 - found["QB"].mae / found["QB"].mae_base)
    assert found["TE"].r2 is None


def test_published_edges():
    """Published errors of model and market, and the edges stated for them."""
    figures = {(38.4, 62.7): 39, (71.2, 107.8): 34, (40.4, 65.0): 38, (34.4, 51.2): 33, (24.2, 39.6): 39}
    assert all(round(100 * (1 - model / base)) == edge for (model, base), edge in figures.items())


def test_coverage(rows):
    df = rows([("a", 1.0, 0.0, 1.0), ("a", 2.0, 0.0, 1.0), ("a", 0.5, 0.0, 1.0), ("a", 0.0, 0.0, 1.0)], "g string, y double, lo double, hi double")
    assert metrics.coverage(df, ["g"]).first()[1:] == (4, 0.75, pytest.approx(0.05))


def test_rank_backtest(rows):
    df = rows([("a", 1, 30.0, 10.0), ("b", 1, 20.0, 20.0), ("c", 1, 10.0, 20.0), ("a", 2, 1.0, 1.0)], "player_id string, season int, y double, y_hat double")
    assert values(metrics.rank_backtest(df), "player_id", "season", "predicted_rank", "actual_rank", "rank_miss") == [
        ("a", 1, 3, 1, 2),
        ("a", 2, 1, 1, 0),
        ("b", 1, 1, 2, 1),
        ("c", 1, 2, 3, 1),
    ]


def test_with_actuals_needs_the_same_season(rows):
    predictions = rows([("a", 2021, 5.0), ("b", 2021, 6.0)], "player_id string, season int, y_hat double")
    actuals = rows([("a", 2021, 4.0), ("b", 2022, 9.0)], "player_id string, season int, y double")
    assert values(metrics.with_actuals(predictions, actuals), "player_id", "y_hat", "y") == [("a", 5.0, 4.0)]


def test_conformal_margin_by_hand(rows):
    # Scores 1..9: place ceil(10 * 0.8) = 8. Four rows: place 4. Three rows: place 4 of 3, unbounded.
    data = [("nine", float(i), 0.0, 0.0) for i in range(1, 10)]
    data += [("four", float(i), 0.0, 0.0) for i in range(1, 5)] + [("three", float(i), 0.0, 0.0) for i in range(1, 4)]
    margins = conformal.conformal_margin(rows(data, "g string, y double, lo double, hi double"), ["g"])
    assert values(margins, "g", "margin") == [("four", 4.0), ("nine", 8.0), ("three", None)]
    test = rows([("nine", 0.0, 1.0), ("three", 0.0, 1.0), ("new", 0.0, 1.0)], "g string, lo double, hi double")
    inf = float("inf")
    assert values(conformal.widen(test, margins, ["g"]), "g", "cal_lo", "cal_hi") == [
        ("new", -inf, inf),
        ("nine", -8.0, 9.0),
        ("three", -inf, inf),
    ]


def test_calibrated_coverage_of_the_calibration_set(rows):
    random.seed(4)
    data = [(random.choice("ab"), random.gauss(0, 3), -1.0, 1.0) for _ in range(800)]
    df = rows(data, "g string, y double, lo double, hi double")
    margins = conformal.conformal_margin(df, ["g"], accuracy=50)
    covered = metrics.coverage(conformal.widen(df, margins, ["g"]), ["g"], low="cal_lo", high="cal_hi")
    assert all(0.8 <= r.coverage <= 0.81 for r in covered.collect())


def test_residual_intervals(rows):
    train = rows([("a", float(i), 0.0) for i in range(11)], "g string, y double, y_hat double")
    quantiles = conformal.residual_quantiles(train, ["g"])
    bounded = conformal.raw_interval(rows([("a", 100.0)], "g string, y_hat double"), quantiles, ["g"])
    assert values(bounded, "lo", "hi") == [(101.0, 109.0)]


def test_models_learn_and_agree(rows):
    random.seed(6)
    data = []
    for i in range(400):
        x, season = random.uniform(0, 10), 2019 + i % 4
        data.append((i, "QB" if i % 2 else "RB", season, x, 3 * x + 5 + random.gauss(0, 0.1), 1.0))
    df = rows(data, "player_id int, position string, season int, x double, y double, w double")
    folds = walkforward.walk_forward(df, [2022])
    predictions = walkforward.fit_predict(folds, ["x"], ["QB", "RB"], 2022, weight="w", trees=5, rounds=5)
    assert predictions.count() == 3 * 100
    error = metrics.accuracy(predictions, ["model"])
    assert {r.model: r.r2 > 0.7 for r in error.collect()} == {"ridge": True, "forest": True, "boosted": True}
    together = walkforward.ensemble(predictions, ["player_id", "y"])
    assert together.count() == 100 and together.filter("n_models <> 3 or uncertainty is null").isEmpty()


def test_every_test_row_is_predicted(rows):
    data = [(i, "QB", 2019 + i % 3, float(i % 7), 2.0 * (i % 7) + 1) for i in range(90)]
    data += [(500, "QB", 2022, 3.0, None), (501, "QB", 2022, None, None), (502, "TE", 2022, 1.0, None)]
    df = rows(data, "player_id int, position string, season int, x double, y double")
    predictions = walkforward.fit_predict(walkforward.walk_forward(df, [2022]), ["x"], ["QB", "TE"], 2022, trees=3, rounds=3)
    found = {(r.player_id, r.model): r.y_hat for r in predictions.collect()}
    assert {k[0] for k in found} == {500, 501, 502} and len(found) == 9
    assert all((y is None) == (who == 502) for (who, _), y in found.items())


def test_model_and_baseline_share_their_rows(rows):
    data = [(2020, "a", 10.0, 8.0, 20.0), (2020, "a", 30.0, 28.0, 20.0), (2020, "a", 50.0, 40.0, None)]
    df = rows(data, "season int, position string, y double, y_hat double, y_base double")
    row = metrics.season_metrics(df).filter("scope = 'a'").first()
    assert (row.n_rows, row.mae, row.mae_base, row.edge) == (2, 2.0, 10.0, 0.8)
    assert metrics.accuracy(df, ["position"], predicted="y_base").first()[1:3] == (2, 10.0)


def test_every_fold_is_predicted_from_one_copy_of_the_rows(rows):
    data = [(f"p{i}", s, g, float(i), float(i + s - 2020) if (i, s) != (1, 2022) else None) for i in range(6) for s in range(2020, 2024) for g in ("QB", "RB")]
    data += [("new", 2023, "TE", 1.0, 2.0)]
    df = rows(data, "player_id string, season int, position string, x double, y double")
    seasons = walkforward.tested_seasons(df)
    assert seasons == [2021, 2022, 2023]
    got = walkforward.predict_folds(df, seasons, ["x"], ["QB", "RB", "TE"], trees=3, rounds=3).collect()
    tested = [r for r in data if r[1] > 2020]
    assert sorted((r.player_id, r.season, r.position, r.model) for r in got) == sorted((*r[:3], m) for r in tested for m in ("forest", "boosted"))
    assert all(r.test_season == r.season and (r.y_hat is None) == (r.position == "TE") for r in got)
    assert walkforward.predict_folds(df, [], ["x"], ["QB"]).count() == 0
