import re

import pytest
from boardwalk.sources import buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(str(i), f"user{i}", i % 3) for i in range(3000)]
    return buckets.store(spark.createDataFrame(rows, "id string, email string, plan int"), f"{tmp_path}/profiles", 16)


def test_reads_by_key_do_not_move_the_table(spark, stored):
    keys = spark.createDataFrame([("5",), ("17",), ("nobody",), (None,), ("5",)], "id string")
    found = buckets.find(keys, stored)
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    scan = text[text.index("FileScan") :]
    assert "Exchange" not in scan
    got = sorted((r.id or "", r.email or "") for r in found.collect())
    assert got == [("", ""), ("17", "user17"), ("5", "user5"), ("5", "user5"), ("nobody", "")]


def test_a_few_keys_read_their_buckets_only(spark, stored):
    # The plan names the buckets only while the scan is by bucket; files are pruned either way.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    found = buckets.find_few(["5", "17"], stored)
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of 16", plan(found))[1]) <= 2
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert sorted(r.id for r in found.collect()) == ["17", "5"]
    assert buckets.find_few([], stored).count() == 0
    with pytest.raises(ValueError):
        buckets.find_few(range(buckets.FEW + 1), stored)
