import itertools

import numpy as np
import pytest
from boardwalk.operators import agreement


def by_hand(pairs):
    signs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for a, b in itertools.combinations(pairs, 2)]
    scale = np.sqrt(sum(s * s for s, _ in signs) * sum(t * t for _, t in signs))
    return len(pairs), sum(s * t < 0 for s, t in signs), sum(s * t for s, t in signs) / scale if scale else None


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_tau_equals_all_pairs(spark, slices):
    draw = np.random.RandomState(slices)
    rows = [("big", float(a), float(a * 0.5 + b)) for a, b in zip(draw.randint(0, 40, 300), draw.randint(0, 20, 300), strict=True)]
    rows += [("same", 1.0, float(i)) for i in range(5)] + [("one", 1.0, 2.0), (None, 1.0, 2.0), (None, 2.0, 1.0), (None, 3.0, 0.0)]
    rows += [("up", float(i), float(i)) for i in range(90)] + [("big", None, 1.0), ("big", float("nan"), 1.0), ("big", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.n, r.discordant, r.tau_b) for r in agreement.kendall(df, "x", "y", ["g"], slices).collect()}
    for group in ("big", "same", "one", "up", None):
        n, discordant, tau = by_hand([(x, y) for g, x, y in rows if g == group and x is not None and y is not None and x == x])
        assert got[group][:2] == (n, discordant) and got[group][2] == (pytest.approx(tau) if tau is not None else None)
    assert agreement.kendall(df.limit(0), "x", "y", ["g"], slices).count() == 0


def test_inversions_and_crossings():
    draw = np.random.RandomState(1)
    for n in (0, 1, 63, 65, 500):
        y = draw.randint(0, 50, n)
        assert agreement.inversions(y) == sum(a > b for a, b in itertools.combinations(y.tolist(), 2))
    cells = draw.randint(0, 4, (5, 7))
    want = sum(cells[a, c] * cells[b, d] for a in range(5) for b in range(a + 1, 5) for c in range(7) for d in range(c))
    assert agreement.crossings(cells) == want


def test_spearman_is_the_correlation_of_average_ranks(spark):
    rows = [("a", x, y) for x, y in ((1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (4.0, 1.0))] + [("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    got = {r.g: r.spearman for r in agreement.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [2, 3.5, 3.5, 1])[0, 1]) and got["b"] is None
