"""What keeps large groups, hot keys and large tables apart."""

import re

import pytest
from frames_help import values
from pyspark.sql import functions as F

from boardwalk.operators import features, ranking
from boardwalk.operators.joins import join_small
from boardwalk.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    """Lets the few kilobytes of a test count as a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranks_join_back_splits_a_value_many_rows_share(spark, small_partitions):
    value = F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") + 0.5)
    df = spark.range(0, 66_000, 1, 16).select("id", value.alias("v"))
    ranked = ranking.average_rank(df, "v", "r")
    total = ranked.agg(F.sum("r").alias("s"), F.count("*").alias("n")).first()
    assert (total.n, total.s) == (66_000, 66_000 * 66_001 / 2)
    counted = ranked.groupBy("r").agg(F.sum(F.xxhash64("id") % 1000))
    counted.collect()
    assert "skew=true" in plan(counted)


def test_ranks_of_few_values_are_broadcast(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    ranked = ranking.average_rank(df, "v", "r")
    assert "strategy=broadcast" in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.agg(F.sum("r")).first()[0] == 3000 * 3001 / 2


def test_few_group_figures_are_broadcast_many_are_not(rows):
    left = rows([("a", 1), ("b", 2), ("c", 3)], "g string, v int")
    small = rows([("a", 10), ("b", 20)], "g string, m int")
    expected = [("a", 1, 10), ("b", 2, 20), ("c", 3, None)]
    for limit, broadcast in ((2, True), (1, False)):
        joined = join_small(left, small, ["g"], limit=limit)
        assert values(joined, "g", "v", "m") == expected
        assert ("rightHint=(strategy=broadcast)" in joined._jdf.queryExecution().optimizedPlan().toString()) is broadcast


def test_places_need_one_shuffle_of_the_rows(rows):
    df = rows([("a", 1), ("a", 2), ("b", 3)], "g string, id int")
    ranked = ranking.row_rank(df, ["g"], [F.col("id")])
    assert "Exchange hashpartitioning" not in plan(ranked) and values(ranked, "id", "rank") == [(1, 1), (2, 2), (3, 1)]


def test_latest_rows_combine_before_the_shuffle(rows):
    text = plan(features.latest_per_key(rows([("a", 1)], "k string, t int"), ["k"], ["t"]))
    assert text.index("partial_max_by") > text.index("Exchange hashpartitioning")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"ensemble_ml"}))
def test_no_query_pairs_rows_or_runs_python(spark, name):
    text = plan(REGISTRY[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", text)
    # A frame from a row to the end of its partition costs the square of the partition.
    assert not re.search(r"(currentrow\$\(\)|-?\d+), unboundedfollowing", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(REGISTRY["own_rows"](spark, FOLDER))
    assert "EqualTo(user_id,7)" in text and "props" not in text
    text = plan(REGISTRY["walk_forward"](spark, FOLDER))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
