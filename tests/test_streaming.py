import json
from datetime import datetime, timedelta

import pytest
from frames_help import values
from pyspark.sql import functions as F

from boardwalk import schemas
from boardwalk.operators import merge
from boardwalk.sources import readers
from boardwalk.streaming import ingest

T0 = datetime(2026, 1, 1)
NOW = datetime(2026, 2, 1)


def stamp(hours):
    return (T0 + timedelta(hours=hours)).isoformat() + "Z"


def drop(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def payment(event, hours, user, plan_type=None, kind=merge.PAYMENT_TYPE):
    metadata = {"user_id": user, "season": "2026", "plan_type": plan_type}
    return {"event_id": event, "ts": stamp(hours), "type": kind, "data": {"object": {"metadata": metadata}}}


def signup(event, hours, email, source="", path="capture"):
    return {"event_id": event, "ts": stamp(hours), "email": email, "source": source, "path": path}


@pytest.fixture
def profiles(spark):
    row = {"plan": "free", "plan_type": "season", "created_at": T0, "updated_at": T0}
    data = [tuple({**row, "id": k, "email": f"{k}@x"}.get(f) for f in schemas.PROFILES.fieldNames()) for k in ("u1", "u2", "u3")]
    return spark.createDataFrame(data, schemas.PROFILES)


def stream_of(spark, folder, schema):
    return readers.events_of(readers.read_bodies(spark, str(folder), maxFilesPerTrigger=1), schema)


def run_payments(spark, folder, out, delay):
    stream = stream_of(spark, folder, schemas.PAYMENT_EVENTS)
    run = ingest.payment_stream(stream, str(out / "log"), str(out / "progress"), delay)
    run.awaitTermination()
    return [p["observedMetrics"]["payment_events"] for p in run.recentProgress if p["numInputRows"]]


@pytest.mark.parametrize("delay", [None, "7 days"])
def test_payments_with_repeats_and_late_events(spark, profiles, tmp_path, delay):
    events, out = tmp_path / "events", tmp_path / "out"
    first = [payment("e2", 20, "u1", "draft"), payment("e3", 3, "u2"), payment("e4", 4, "u3", kind="other")]
    later = [payment("e1", 10, "u1"), payment("e2", 20, "u1", "draft"), payment("e9", 9, "ghost")]
    drop(events, "a.json", first)
    assert [(m["n_events"], m["n_ignored"]) for m in run_payments(spark, events, out, delay)] == [(3, 1)]
    drop(events, "b.json", later)
    run_payments(spark, events, out, delay)
    state = ingest.profiles_after_payments(profiles, str(out / "log"), F.lit(NOW))
    columns = ("id", "plan", "plan_type", "paid_at", "updated_at")
    assert values(state, *columns) == [
        ("u1", "paid", "draft", T0 + timedelta(hours=20), NOW),
        ("u2", "paid", "season", T0 + timedelta(hours=3), NOW),
        ("u3", "free", "season", None, T0),
    ]
    together = spark.createDataFrame(
        [(e["event_id"], datetime.fromisoformat(e["ts"]), e["type"], (((tuple(e["data"]["object"]["metadata"].values())),),)) for e in first + later],
        schemas.PAYMENT_EVENTS,
    )
    batch = merge.apply_payments(profiles, merge.completed_payments(together), F.lit(NOW))
    assert values(batch, *columns) == values(state, *columns)


def test_payments_of_unknown_plan_types_are_kept_apart(spark, profiles, tmp_path):
    drop(tmp_path / "events", "a.json", [payment("e1", 1, "u1", "lifetime"), payment("e2", 2, "u2", "draft")])
    run_payments(spark, tmp_path / "events", tmp_path / "out", None)
    rejected = ingest.read_batches(spark, str(tmp_path / "out" / "log-rejected"), ingest.REJECTED_PAYMENTS)
    assert values(rejected, "user_id", "reject_reason") == [("u1", "plan_type not allowed")]
    state = ingest.profiles_after_payments(profiles, str(tmp_path / "out" / "log"), F.lit(NOW))
    assert values(state, "id", "plan", "plan_type") == [("u1", "free", "season"), ("u2", "paid", "draft"), ("u3", "free", "season")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("e1", T0, "u1", "2026", "draft")], schemas.PAYMENTS)
    for _ in range(2):
        ingest.write_batch(rows, str(tmp_path / "log"), 3)
    assert ingest.read_batches(spark, str(tmp_path / "log"), schemas.PAYMENTS).count() == 1


def test_signups_rejects_and_compaction(spark, tmp_path):
    events, out = tmp_path / "events", tmp_path / "out"
    drop(
        events,
        "a.json",
        [signup("1", 1, "a@x", "manual"), signup("2", 2, "", "manual"), signup("3", 3, "b@x", "nowhere"), signup("4", 4, "c@x", "register", "register")],
    )
    drop(events, "b.json", [signup("5", 5, "a@x"), signup("6", 2, "c@x", "landing", "register"), signup("7", 7, "d@x", path="other"), signup("5", 5, "a@x")])
    stream = stream_of(spark, events, schemas.SIGNUP_EVENTS)
    paths = [str(out / p) for p in ("log", "rejected", "progress")]
    ingest.signup_stream(stream, *paths).awaitTermination()
    expected = [("a@x", "landing", T0 + timedelta(hours=5)), ("c@x", "register", T0 + timedelta(hours=2))]
    assert values(ingest.email_list(spark, paths[0]), "email", "source", "created_at") == expected
    rejected = ingest.read_batches(spark, paths[1], ingest.REJECTED_SIGNUPS)
    assert values(rejected, "event_id", "reject_reason") == [("2", "email required"), ("3", "source not allowed"), ("7", "path not allowed")]
    ingest.compact(spark, paths[0], str(out / "small"), schemas.SIGNUP_EVENTS, ingest.fold_signups)
    assert values(ingest.email_list(spark, str(out / "small")), "email", "source", "created_at") == expected


def test_repeats_are_dropped_by_id_or_content(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [signup("1", 1, "a@x"), signup("1", 2, "a@x"), signup(None, 3, "b@x")])
    drop(tmp_path / "in", "b.json", [signup("1", 1, "a@x"), signup(None, 3, "b@x"), signup(None, 4, "b@x")])
    stream = ingest.without_repeats(stream_of(spark, tmp_path / "in", schemas.SIGNUP_EVENTS))
    run = ingest.start(stream, lambda r, b: ingest.write_batch(r, str(tmp_path / "log"), b), str(tmp_path / "progress"))
    run.awaitTermination()
    kept = ingest.read_batches(spark, str(tmp_path / "log"), schemas.SIGNUP_EVENTS)
    assert values(kept, "email") == [("a@x",), ("b@x",), ("b@x",)]


def test_malformed_bodies_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id": "1"\nplain text\n' + json.dumps(signup("2", 1, "a@x")))
    bodies = readers.read_bodies(spark, str(tmp_path / "in"))
    malformed = readers.malformed_of(bodies, schemas.SIGNUP_EVENTS)
    ingest.malformed_stream(malformed, str(tmp_path / "bad"), str(tmp_path / "progress")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "bad")), "value") == [("plain text",), ('{"event_id": "1"',)]


def test_two_streams_join_within_the_window(spark, tmp_path):
    for name, data in {
        "signups": [("u1", stamp(0)), ("u2", stamp(0)), ("u3", stamp(5))],
        "payments": [("u1", stamp(24)), ("u2", stamp(24 * 8)), ("u3", stamp(4))],
    }.items():
        drop(tmp_path / name, "a.json", [{"user_id": u, "ts": t} for u, t in data])
    schema = spark.createDataFrame([], "user_id string, ts timestamp").schema
    sides = [stream_of(spark, tmp_path / n, schema) for n in ("signups", "payments")]

    def each_batch(rows, batch):
        ingest.write_batch(rows, str(tmp_path / "out"), batch)

    ingest.start(ingest.conversions(*sides), each_batch, str(tmp_path / "progress")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert values(found, "user_id", "paid_ts") == [("u1", T0 + timedelta(hours=24))]
