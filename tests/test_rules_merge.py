from datetime import datetime, timedelta

import pytest
from frames_help import values
from pyspark.sql import functions as F

from boardwalk import schemas
from boardwalk.operators import merge, rules

T0 = datetime(2026, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_rules_name_the_first_broken_one(rows):
    df = rows(
        [("1", "a@x", "free", "season"), ("2", " ", "free", "season"), (None, "", "odd", "season"), ("4", "d@x", "odd", "draft"), ("5", "e@x", None, None)],
        "id string, email string, plan string, plan_type string",
    )
    accepted, rejected = rules.split(df, rules.PROFILE_RULES)
    assert values(accepted, "id") == [("1",), ("5",)]
    assert values(rejected, "id", "reject_reason") == [("2", "email required"), ("4", "plan not allowed"), (None, "id required")]


def test_defaults_fill_null_and_empty(rows):
    df = rows([("a", None), ("b", ""), ("c", "manual")], "email string, source string")
    assert values(rules.fill_defaults(df, rules.EMAIL_DEFAULTS), "email", "source") == [("a", "landing"), ("b", "landing"), ("c", "manual")]


def test_keys_and_references(rows):
    child = rows([(1, "a"), (2, "b"), (2, "c"), (3, "a")], "id int, parent string")
    parent = rows([("a",), ("c",)], "name string")
    assert values(rules.duplicate_keys(child, ["id"]), "id", "n_rows") == [(2, 2)]
    assert values(rules.orphans(child, parent, "parent", "name"), "id", "parent") == [(2, "b")]
    assert values(rules.cascade(child, parent, "parent", "name"), "id", "parent") == [(1, "a"), (2, "c"), (3, "a")]
    assert values(rules.visible_to(child, 2), "parent") == [("b",), ("c",)]
    assert values(rules.distinct_keys(child, "id"), "n_keys") == [(3,)]
    assert values(rules.distinct_keys(child, "id", approximate=True), "n_keys") == [(3,)]


@pytest.fixture
def listed(rows):
    return rows([("a@x", "landing", T0), ("b@x", "manual", T0)], "email string, source string, created_at timestamp")


@pytest.fixture
def offered(rows):
    data = [("a@x", "register", at(2), 2), ("a@x", "manual", at(3), 3), ("c@x", "manual", at(5), 5), ("c@x", "landing", at(4), 4)]
    return rows(data, "email string, source string, created_at timestamp, event int")


def test_upsert_last_wins(listed, offered):
    merged = merge.upsert(listed, offered, ["email"], ["created_at", "event"])
    assert values(merged, "email", "source") == [("a@x", "manual"), ("b@x", "manual"), ("c@x", "manual")]
    again = merge.upsert(merged, offered, ["email"], ["created_at", "event"])
    assert values(again, "email", "source", "created_at") == values(merged, "email", "source", "created_at")


def test_insert_ignore_first_wins(listed, offered):
    merged = merge.insert_ignore(listed, offered, ["email"], ["created_at", "event"])
    assert values(merged, "email", "source") == [("a@x", "landing"), ("b@x", "manual"), ("c@x", "landing")]


def test_email_list_paths(spark, listed):
    events = spark.createDataFrame(
        [
            ("1", at(1), "a@x", "register", "register"),
            ("2", at(2), "c@x", "register", "register"),
            ("3", at(3), "c@x", "landing", "register"),
            ("4", at(1), "d@x", "manual", "capture"),
            ("5", at(2), "d@x", "register", "register"),
            ("6", at(0), "b@x", "landing", "capture"),
        ],
        "event_id string, ts timestamp, email string, source string, path string",
    )
    assert values(merge.email_list(events, listed), "email", "source", "created_at") == [
        ("a@x", "landing", T0),
        ("b@x", "landing", at(0)),
        ("c@x", "register", at(2)),
        ("d@x", "manual", at(1)),
    ]
    assert values(merge.email_list(events), "email") == [("a@x",), ("b@x",), ("c@x",), ("d@x",)]


def profile(key, **changes):
    base = {"id": key, "email": f"{key}@x", "plan": "free", "plan_type": "season", "created_at": T0, "updated_at": T0}
    return tuple({**base, **changes}.get(f) for f in schemas.PROFILES.fieldNames())


def payment(event, hours, user, plan_type, kind=merge.PAYMENT_TYPE):
    return (event, at(hours), kind, (((user, "2026", plan_type),),))


def test_payments_update_known_users_once(spark):
    profiles = spark.createDataFrame([profile("u1"), profile("u2"), profile("u3", plan="paid", paid_at=at(9), season_paid="2025")], schemas.PROFILES)
    events = spark.createDataFrame(
        [
            payment("e2", 2, "u1", "draft"),
            payment("e1", 1, "u1", None),
            payment("e2", 2, "u1", "draft"),
            payment("e3", 3, "u2", "draft", kind="invoice.created"),
            payment("e4", 4, "u3", "draft"),
            payment("e5", 5, "nobody", ""),
        ],
        schemas.PAYMENT_EVENTS,
    )
    payments = merge.completed_payments(events)
    assert sorted(r.plan_type for r in payments.collect()) == ["draft", "draft", "draft", "season", "season"]
    now = F.lit(at(100))
    merged = merge.apply_payments(profiles, payments, now)
    columns = ("id", "plan", "plan_type", "season_paid", "paid_at", "updated_at")
    expected = [
        ("u1", "paid", "draft", "2026", at(2), at(100)),
        ("u2", "free", "season", None, None, T0),
        ("u3", "paid", "season", "2025", at(9), T0),
    ]
    assert values(merged, *columns) == expected
    assert values(merge.apply_payments(merged, payments, F.lit(at(200))), *columns) == expected


def test_missing_profile_is_free(rows, spark):
    profiles = spark.createDataFrame([profile("u1", plan="paid", plan_type="draft")], schemas.PROFILES)
    users = rows([("u1",), ("u9",)], "id string")
    assert values(merge.with_profile(users, profiles), "id", "plan", "plan_type") == [("u1", "paid", "draft"), ("u9", "free", "season")]
