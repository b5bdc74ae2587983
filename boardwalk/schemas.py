"""Schemas of the tables. All fields are nullable: any of them may be missing in a source record."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _NUMBER, _INT, _TIME = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
_LONG, _LOCAL_TIME = T.LongType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


PROJECTIONS = _table(
    player_id=_TEXT,
    player_name=_TEXT,
    position=_TEXT,
    team=_TEXT,
    projected_points=_NUMBER,
    pts_lag1=_NUMBER,
    ci_low=_NUMBER,
    ci_high=_NUMBER,
    uncertainty=_NUMBER,
    risk=_TEXT,
    adp=_NUMBER,
    model_used=_TEXT,
    bye=_INT,
    vbd=_NUMBER,
    projected_receptions=_NUMBER,
    ktc_rank=_INT,
)
VALUE_GAPS = _table(
    player_name=_TEXT,
    position=_TEXT,
    team=_TEXT,
    projected_points=_NUMBER,
    model_rank=_INT,
    adp=_NUMBER,
    adp_gap=_NUMBER,
    label=_TEXT,
    reason=_TEXT,
)
SCARCITY = _table(
    position=_TEXT,
    top_pts=_NUMBER,
    replacement_pts=_NUMBER,
    dropoff=_NUMBER,
    dropoff_per_slot=_NUMBER,
    tier_gap=_NUMBER,
    n_players=_INT,
    starters_needed=_INT,
    scarcity_rank=_INT,
)
ACCURACY = _table(best_model=_TEXT, mae=_NUMBER, rmse=_NUMBER, r2=_NUMBER)
ROSTER_CONFIG = _table(
    roster_slots=T.MapType(_TEXT, _INT),
    flex_eligible=T.ArrayType(_TEXT),
    bench_size=_INT,
    num_teams=_INT,
    scoring_format=_TEXT,
)
PROFILES = _table(
    id=_TEXT,
    email=_TEXT,
    plan=_TEXT,
    plan_type=_TEXT,
    season_paid=_TEXT,
    paid_at=_TIME,
    created_at=_TIME,
    updated_at=_TIME,
)
EMAIL_LIST = _table(email=_TEXT, source=_TEXT, created_at=_TIME)
SIGNUP_EVENTS = _table(event_id=_TEXT, ts=_TIME, email=_TEXT, source=_TEXT, path=_TEXT, user_id=_TEXT)
PAYMENT_EVENTS = _table(
    event_id=_TEXT,
    ts=_TIME,
    type=_TEXT,
    data=_table(object=_table(metadata=_table(user_id=_TEXT, season=_TEXT, plan_type=_TEXT))),
)
PAYMENTS = _table(event_id=_TEXT, ts=_TIME, user_id=_TEXT, season=_TEXT, plan_type=_TEXT)

# The warehouse tables, as far as the queries read them.
WAREHOUSE = {
    "nation": _table(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
    "customer": _table(c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_NUMBER, c_mktsegment=_TEXT),
    "supplier": _table(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT, s_acctbal=_NUMBER),
    "orders": _table(o_orderkey=_LONG, o_custkey=_LONG, o_totalprice=_NUMBER, o_orderdate=_LOCAL_TIME),
    "lineitem": _table(
        l_orderkey=_LONG, l_linenumber=_INT, l_quantity=_NUMBER, l_discount=_NUMBER, l_tax=_NUMBER
    ),
    "events": _table(
        event_id=_LONG, ts=_LOCAL_TIME, user_id=_LONG, event_type=_TEXT, value=_NUMBER, props=_TEXT
    ),
}
