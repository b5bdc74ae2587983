import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardwalk.operators import quantiles as Q


def build(rows, n, seed=1):
    random.seed(seed)
    data = []
    for i in range(n):
        group = "hot" if random.random() < 0.6 else random.choice("xyz")
        value = 5.0 if random.random() < 0.3 else random.gauss(0, 10)
        data.append((group, None if random.random() < 0.02 else value))
    return data, rows(data, "g string, v double")


@pytest.mark.parametrize("accuracy", [Q.ACCURACY, 200, 20])
def test_percentiles_are_exact_whatever_the_bracket(rows, accuracy):
    data, df = build(rows, 4000)
    found = {r.g: r for r in Q.percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.25, "c": 0.9}, accuracy).collect()}
    for group in {g for g, _ in data}:
        members = [v for g, v in data if g == group and v is not None]
        assert found[group].n == len(members)
        for name, share in (("a", 0.1), ("b", 0.25), ("c", 0.9)):
            assert found[group][name] == pytest.approx(np.quantile(members, share), abs=1e-12)


def test_places_without_groups_and_outside(rows):
    _, df = build(rows, 500)
    values = sorted(r.v for r in df.filter("v is not null").collect())
    found = Q.order_statistics(
        df, [], "v", {"last": (1.0, F.col("n")), "third": (0.0, F.lit(3)), "beyond": (1.0, F.col("n") + 1)}
    ).first()
    assert (found.last, found.third, found.beyond) == (values[-1], values[2], None)


def test_a_place_far_from_its_share_widens_the_bracket(rows):
    _, df = build(rows, 3000)
    values = sorted(r.v for r in df.filter("v is not null").collect())
    found = Q.order_statistics(df, [], "v", {"p": (0.9, F.lit(10))}, accuracy=100).first()
    assert found.p == values[9]


def test_single_value_group(rows):
    found = Q.percentiles(rows([("a", 4.0)], "g string, v double"), ["g"], "v", {"m": 0.5}).first()
    assert (found.n, found.m) == (1, 4.0)


def test_nan_is_no_value(rows):
    df = rows([("a", float("nan")), ("a", 1.0), ("a", 3.0), ("b", float("nan"))], "g string, v double")
    table = Q.percentiles(df, ["g"], "v", {"half": 0.5})
    assert [tuple(r) for r in table.collect() if r.g == "a"] == [("a", 2, 2.0)]
