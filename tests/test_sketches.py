from datetime import datetime, timedelta

from boardwalk.operators import sketches
from pyspark.sql import functions as F


def test_days_merge_without_counting_a_key_twice(spark):
    day = datetime(2026, 1, 1)
    rows = [("a", day + timedelta(days=d), u) for d in range(4) for u in range(d * 500, d * 500 + 1000)]
    rows += [("b", day, 1), ("b", day, 1), ("b", day, None)]
    stored = sketches.daily_sketches(spark.createDataFrame(rows, "kind string, ts timestamp, user bigint"), "user", ["kind"])
    got = {r.kind: r.n_estimated for r in sketches.distinct_between(stored, ["kind"]).collect()}
    assert abs(got["a"] - 2500) <= 4 * sketches.relative_error() * 2500 and got["b"] == 1
    some = sketches.distinct_between(stored, ["kind"], F.lit("2026-01-02").cast("date"), F.lit("2026-01-03").cast("date")).collect()
    assert [r.kind for r in some] == ["a"] and abs(some[0].n_estimated - 1500) <= 4 * sketches.relative_error() * 1500
    assert sketches.distinct_between(stored.limit(0), ["kind"]).count() == 0
