from datetime import datetime, timedelta

from boardwalk import schemas
from boardwalk.plans import streams
from boardwalk.streaming import keyed, windows
from boardwalk.streaming.ingest import read_batches
from pyspark.sql import functions as F

DAY = datetime(2026, 1, 1)


def payment(event_id, day, user, plan="season"):
    return (event_id, DAY + timedelta(days=day), "checkout.session.completed", (((user, "2026", plan),),))


def files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def profiles_of(spark):
    rows = [(u, f"{u}@x", "paid" if day is not None else "free", "season", "2025", None if day is None else DAY + timedelta(days=day), DAY, DAY) for u, day in (("a", None), ("b", 5), ("c", None))]
    return spark.createDataFrame(rows, schemas.PROFILES)


def test_only_changed_users_are_emitted(spark, tmp_path):
    batches = [
        [payment("1", 1, "a"), payment("2", 2, "a", "draft"), payment("3", 4, "b"), payment("4", 1, None), payment("5", 1, "c", "lifetime")],
        [payment("2", 2, "a", "draft"), payment("0", 2, "a"), payment("6", 5, "b")],
        [payment("7", 2, "a", "season"), payment("8", 6, "b"), payment("9", 0, "zz")],
    ]
    events = files(spark, f"{tmp_path}/events", batches, schemas.PAYMENT_EVENTS)
    profiles = profiles_of(spark)
    keyed.plan_stream(events, profiles, f"{tmp_path}/changes", f"{tmp_path}/progress").awaitTermination()
    changes = keyed.changes_of(spark, f"{tmp_path}/changes")
    # The second batch changes nobody: a repeat, an older event of the same time, and the stored payment's own time.
    assert sorted((r.user_id, r.event_id) for r in changes.collect()) == [("a", "2"), ("a", "7"), ("b", "8"), ("zz", "9")]
    after = {r.id: r for r in keyed.profiles_after_changes(profiles, changes).collect()}
    assert [(after[u].plan, after[u].plan_type, after[u].paid_at) for u in "abc"] == [
        ("paid", "season", DAY + timedelta(days=2)),
        ("paid", "season", DAY + timedelta(days=6)),
        ("free", "season", None),
    ]


def test_a_plan_ends_when_event_time_passes_it(spark, tmp_path):
    batches = [[payment("1", 1, "a"), payment("2", 3, "c")], [payment("3", 8, "c")], [payment("4", 14, "d")], [payment("5", 60, "e")], [payment("6", 61, "e")]]
    events = files(spark, f"{tmp_path}/events", batches, schemas.PAYMENT_EVENTS)
    profiles = profiles_of(spark)
    keyed.plan_stream(events, profiles, f"{tmp_path}/changes", f"{tmp_path}/progress", expire=timedelta(days=10), delay="1 day").awaitTermination()
    changes = keyed.changes_of(spark, f"{tmp_path}/changes").collect()
    ended = {r.user_id: r.paid_us for r in changes if r.plan == "free"}
    day = lambda n: int((DAY + timedelta(days=n)).timestamp()) * 1_000_000
    assert ended == {"a": day(11), "b": day(15), "c": day(18), "d": day(24)}
    after = {r.id: r.plan for r in keyed.profiles_after_changes(profiles, keyed.changes_of(spark, f"{tmp_path}/changes")).collect()}
    assert after == {"a": "free", "b": "free", "c": "free"}


def test_users_of_one_group_keep_their_own_state(spark, tmp_path):
    batches = [
        [payment("1", 1, "a"), payment("2", 3, "c"), payment("3", 3, "c", "draft"), payment(None, 2, "n"), ("x", None, *payment("x", 1, "a")[2:])],
        [payment("4", 8, "c"), payment(None, 2, "n"), payment("5", 2, "n", "draft")],
        [payment("6", 14, "d")], [payment("7", 60, "e")], [payment("8", 61, "e")],
    ]
    got = {}
    for groups in (1, 7, keyed.GROUPS):
        events, target = files(spark, f"{tmp_path}/{groups}/events", batches, schemas.PAYMENT_EVENTS), f"{tmp_path}/{groups}"
        keyed.plan_stream(events, profiles_of(spark), f"{target}/changes", f"{target}/progress", expire=timedelta(days=10), delay="1 day", groups=groups).awaitTermination()
        got[groups] = sorted((r.user_id, r.paid_us, r.plan, r.plan_type, r.event_id) for r in keyed.changes_of(spark, f"{target}/changes").collect() if r.event_id != keyed.STORED)
    at = lambda n: int((DAY + timedelta(days=n)).timestamp()) * 1_000_000
    assert got[1] == got[7] == got[keyed.GROUPS] == [
        ("a", at(1), "paid", "season", "1"), ("a", at(11), "free", None, "1"),
        ("c", at(3), "paid", "draft", "3"), ("c", at(8), "paid", "season", "4"), ("c", at(18), "free", None, "4"),
        ("d", at(14), "paid", "season", "6"), ("d", at(24), "free", None, "6"),
        ("e", at(60), "paid", "season", "7"), ("e", at(61), "paid", "season", "8"),
        ("n", at(2), "paid", "draft", "5"), ("n", at(2), "paid", "season", None), ("n", at(12), "free", None, "5"),
    ]


def test_the_store_holds_groups_however_many_users(spark, tmp_path):
    """A user of its own in the store costs calls of its own in every batch."""
    events = files(spark, f"{tmp_path}/events", [[payment(str(i), 1, f"u{i}") for i in range(3000)]], schemas.PAYMENT_EVENTS)
    query = keyed.plan_stream(events, profiles_of(spark), f"{tmp_path}/changes", f"{tmp_path}/progress")
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= keyed.GROUPS
    assert keyed.changes_of(spark, f"{tmp_path}/changes").count() == 3000


def test_parts_of_a_stream_are_micro_batches_of_several_files(spark, tmp_path):
    rows = spark.range(4000).select((F.lit(DAY) + F.make_dt_interval(F.col("id") % 60)).alias("ts"), "id")
    late, more = F.col("id") == 7, rows.filter(F.col("id") < 2)
    n = streams.in_files(rows, f"{tmp_path}/events", late, (more,), file_rows=300)
    assert n == 3
    stream, seen = streams.as_stream(spark, rows, f"{tmp_path}/events", n), {}
    stream.writeStream.foreachBatch(lambda b, i: seen.update({i: sorted(r.id for r in b.collect())})).option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    part = lambda i: min(i % 60 * 6 // 59, 5)
    assert seen == {k: [i for i in range(4000) if i != 7 and part(i) == k] for k in range(6)} | {6: [7], 7: [0, 1]}


def test_late_events_go_to_the_side_log(spark, tmp_path):
    schema = "ts timestamp, source string"
    at = lambda *days: [(DAY + timedelta(days=d), "s") for d in days]
    stream = files(spark, f"{tmp_path}/events", [at(0.1, 0.2), at(5.5), at(0.3, 5.1), at(0.4, 4.9), at(30.0)], schema)
    counted = windows.window_counts(stream, ["source"], "1 day")
    windows.window_stream(counted, f"{tmp_path}/windows", f"{tmp_path}/p1").awaitTermination()
    windows.late_stream(stream, f"{tmp_path}/late", f"{tmp_path}/p2", "1 day").awaitTermination()
    got = {(r.begin, r.n) for r in windows.read_windows(spark, f"{tmp_path}/windows", "source string").collect()}
    assert got == {(DAY, 3), (DAY + timedelta(days=5), 2), (DAY + timedelta(days=4), 1)}
    late = read_batches(spark, f"{tmp_path}/late", stream.schema).select(F.unix_micros("ts").alias("t")).collect()
    assert [r.t for r in late] == [int((DAY + timedelta(days=0.4)).timestamp() * 1_000_000)]
