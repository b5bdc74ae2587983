import itertools

import numpy as np
import pytest
from boardwalk.operators import moments

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.RandomState(4)
    rows = []
    for season, group in itertools.product(range(2015, 2020), ("QB", "RB")):
        for _ in range(40):
            a, b, c = draw.normal(1000, 5), draw.normal(), draw.normal()
            y = 3 - 0.5 * a + (2 if group == "QB" else -1) * b + 0.3 * season + draw.normal()
            rows.append((season, group, float(a), float(b), float(c), float(y)))
    rows += [(2016, "QB", None, 1.0, 1.0, 1.0), (2016, "QB", float("nan"), 1.0, 1.0, 1.0), (None, "QB", 1.0, 1.0, 1.0, 1.0), (2019, "TE", 1.0, 2.0, 3.0, 4.0)]
    rows += [(s, "K", 5.0, 2.0, float(i), float(i + s)) for s in (2015, 2016) for i in range(3)]
    return spark.createDataFrame(rows, "season int, position string, a double, b double, c double, y double"), rows


def train(rows, group, test, decay):
    own = [r for r in rows if r[0] is not None and r[1] == group and r[0] < test and all(v is not None and v == v for v in r[2:])]
    x, y = np.array([r[2:5] for r in own]), np.array([r[5] for r in own])
    w = np.array([decay ** (test - 1 - r[0]) for r in own])
    return x, y, w / w.sum()


def solved(x, y, w, penalty):
    mean, middle = w @ x, w @ y
    spread = np.sqrt(w @ (x - mean) ** 2)
    spread[spread < 1e-12] = 1
    z = (x - mean) / spread
    g = np.linalg.solve((z * w[:, None]).T @ z + penalty * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - middle))
    return g, z, w, middle, mean, spread


SEASONS = [2016, 2017, 2018, 2019]


def test_ridge_equals_normal_equations_of_the_rows(data):
    df, rows = data
    stored = moments.season_moments(df, [*FEATURES, "y"])
    folds = moments.fold_moments(stored, SEASONS, [*FEATURES, "y"], (1.0, 0.6))
    found = moments.ridge(folds, FEATURES, penalty=0.2).collect()
    assert len(found) == 2 * (4 + 4 + 4)  # the tight ends have no season before 2019, the kickers train all four folds
    for r in found:
        x, y, w = train(rows, r.position, r.test_season, r.decay)
        g, _, _, middle, mean, spread = solved(x, y, w, 0.2)
        assert r.n_train == len(y)
        assert np.allclose([r.b_a, r.b_b, r.b_c], g / spread, rtol=1e-8, atol=1e-10)
        assert np.isclose(r.b0, middle - g / spread @ mean, rtol=1e-8)


def test_one_shuffle_of_the_rows(data):
    df, _ = data
    plan = moments.season_moments(df, [*FEATURES, "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_" in plan


def test_rising_coefficients_fit_best_among_the_feasible(data):
    df, rows = data
    stored = moments.season_moments(df, [*FEATURES, "y"])
    folds = moments.fold_moments(stored, SEASONS, [*FEATURES, "y"])
    for r in moments.rising(folds, FEATURES, ["a", "b"], penalty=0.2).collect():
        x, y, w = train(rows, r.position, r.test_season, 1.0)
        _, z, w, middle, _, spread = solved(x, y, w, 0.2)
        best = None
        for kept in itertools.product((0, 1), (0, 1), (1,)):
            at = np.flatnonzero(kept)
            g = np.zeros(3)
            g[at] = np.linalg.solve((z[:, at] * w[:, None]).T @ z[:, at] + 0.2 * np.eye(len(at)), (z[:, at] * w[:, None]).T @ (y - middle))
            loss = w @ (y - middle - z @ g) ** 2 + 0.2 * g @ g
            if (g[:2] >= 0).all() and (best is None or loss < best[0]):
                best = loss, g
        assert r.kkt < 1e-9 and min(r.b_a, r.b_b) >= 0
        assert np.allclose([r.b_a, r.b_b, r.b_c], best[1] / spread, rtol=1e-7, atol=1e-9)


def test_errors_and_decay_from_moments(data):
    df, rows = data
    stored = moments.season_moments(df, [*FEATURES, "y"])
    folds = moments.fold_moments(stored, SEASONS, [*FEATURES, "y"], moments.DECAYS)
    errors = moments.squared_error(moments.ridge(folds, FEATURES), stored, FEATURES).collect()
    by_hand = {}
    for r in errors:
        own = [x for x in rows if x[0] == r.test_season and x[1] == r.position and all(v is not None and v == v for v in x[2:])]
        misses = [x[5] - r.b0 - r.b_a * x[2] - r.b_b * x[3] - r.b_c * x[4] for x in own]
        by_hand[r.test_season, r.position, r.decay] = np.mean(np.square(misses))
        assert np.isclose(r.mse, by_hand[r.test_season, r.position, r.decay], rtol=1e-7, atol=1e-9) and r.n_test == len(own)
    chosen = {(r.test_season, r.position): r.decay for r in moments.choose_decay(moments.squared_error(moments.ridge(folds, FEATURES), stored, FEATURES)).collect()}
    assert chosen[2016, "QB"] == 1.0
    for (season, group), decay in chosen.items():
        if season > 2016:
            past = {d: sum(v for (s, p, x), v in by_hand.items() if s < season and p == group and x == d) for d in moments.DECAYS}
            assert np.isclose(past[decay], min(past.values()))


def test_empty_and_missing_folds(spark, data):
    df, _ = data
    none = moments.season_moments(df.limit(0), [*FEATURES, "y"])
    assert moments.ridge(moments.fold_moments(none, SEASONS, [*FEATURES, "y"]), FEATURES).count() == 0
    stored = moments.season_moments(df, [*FEATURES, "y"])
    fitted = moments.ridge(moments.fold_moments(stored, SEASONS, [*FEATURES, "y"]), FEATURES)
    got = moments.predict(df, fitted, FEATURES).collect()
    assert all((r.y_hat is None) == (r.season is None or r.season == 2015 or r.position == "TE" or r.a is None) for r in got)
