"""Keyed merges of the subscriber tables. Each takes the table and the changes, and gives the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions import scalars as S
from boardwalk.operators import rules
from boardwalk.operators.features import earliest_per_key, latest_per_key
from boardwalk.operators.joins import without

# Fixed values.
PAYMENT_TYPE = "checkout.session.completed"
PAID = "paid"
FREE = "free"
SEASON_PLAN = "season"


def _merged(existing: DataFrame, rows: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Both tables, one row per key, in one join; of a key in both, the row of the ``first`` side."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    new = rows.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, list(keys), "full").select(*keys, F.coalesce(first, second).alias("_r"))
    return both.select(*keys, "_r.*").select(*existing.columns)


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the latest change of a key replaces its row, other rows stay."""
    return _merged(existing, latest_per_key(changes, keys, order), keys, "_new", "_old")


def insert_ignore(
    existing: DataFrame, offered: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First write wins: known keys keep their row, new ones get the earliest offered."""
    return _merged(existing, earliest_per_key(offered, keys, order), keys, "_old", "_new")


def new_rows(existing: DataFrame, offered: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Only the earliest offered row of each key that the table lacks."""
    first = earliest_per_key(offered, keys, order).select(*existing.columns)
    return without(first, existing, list(keys))


def completed_payments(events: DataFrame) -> DataFrame:
    """Payments (event_id, ts, user_id, season, plan_type) of the event envelope; other types drop out."""
    meta = F.col("data.object.metadata")
    return events.filter(F.col("type") == PAYMENT_TYPE).select(
        "event_id",
        "ts",
        meta["user_id"].alias("user_id"),
        meta["season"].alias("season"),
        S.or_default(meta["plan_type"], SEASON_PLAN).alias("plan_type"),
    )


def apply_payments(profiles: DataFrame, payments: DataFrame, at: Column | None = None) -> DataFrame:
    """Profiles with the latest payment of each user; unknown users change nothing.

    A payment counts when it is later than the stored one, so repeats and late arrivals leave the
    profile, and its ``updated_at``, alone. One of a plan type that profiles cannot hold counts for
    nothing; ``rules.PAYMENT_RULES`` finds those.
    """
    at = F.current_timestamp() if at is None else at
    payments = payments.filter(F.col("plan_type").isin(*rules.PLAN_TYPES))
    latest = latest_per_key(payments, ["user_id"], ["ts", "event_id"]).select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("_ts"),
        F.col("season").alias("_season"),
        F.col("plan_type").alias("_type"),
    )
    newer = F.col("_ts").isNotNull() & (F.col("paid_at").isNull() | (F.col("_ts") > F.col("paid_at")))

    def merged(value: Column, column: str) -> Column:
        return F.when(newer, value).otherwise(F.col(column)).alias(column)

    changes = {
        "plan": F.lit(PAID),
        "plan_type": F.col("_type"),
        "season_paid": F.col("_season"),
        "paid_at": F.col("_ts"),
        "updated_at": at,
    }
    joined = profiles.join(latest, "id", "left")
    return joined.select(*[merged(changes[c], c) if c in changes else F.col(c) for c in profiles.columns])


def with_profile(users: DataFrame, profiles: DataFrame, key: str = "id") -> DataFrame:
    """Users with their profile; a user without one is on the free season plan."""
    return users.join(profiles, key, "left").withColumns(
        {"plan": F.coalesce("plan", F.lit(FREE)), "plan_type": F.coalesce("plan_type", F.lit(SEASON_PLAN))}
    )


def email_list(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The list (email, source, created_at) after sign-up events (email, source, ts, event_id, path).

    ``capture`` overwrites the row of its address, ``register`` only adds one. So an address has
    its latest capture, else the row it had, else its earliest registration.
    """
    row = F.struct(F.col("source"), F.col("ts").alias("created_at"))
    place = F.struct("ts", "event_id")
    by_path = events.groupBy("email").agg(
        F.max_by(row, F.when(F.col("path") == "capture", place)).alias("_capture"),
        F.min_by(row, F.when(F.col("path") == "register", place)).alias("_register"),
    )
    if existing is None:
        chosen = F.coalesce("_capture", "_register")
        return by_path.select("email", chosen.alias("_r")).select("email", "_r.*")
    stored = existing.select("email", F.struct("source", "created_at").alias("_stored"))
    return (
        stored.join(by_path, "email", "full")
        .select("email", F.coalesce("_capture", "_stored", "_register").alias("_r"))
        .select("email", "_r.*")
    )


def registered_profiles(events: DataFrame, existing: DataFrame) -> DataFrame:
    """The profiles after sign-up events: a registration opens a free one, unless its user has one.

    Of an address only the earliest registration counts; one without a user id opens none.
    """
    registrations = events.filter((F.col("path") == rules.REGISTER) & F.col("user_id").isNotNull())
    first = earliest_per_key(registrations, ["email"], ["ts", "event_id"])
    values = {
        "id": F.col("user_id"),
        "email": F.col("email"),
        "plan": F.lit(rules.PROFILE_DEFAULTS["plan"]),
        "plan_type": F.lit(rules.PROFILE_DEFAULTS["plan_type"]),
        "created_at": F.col("ts"),
        "updated_at": F.col("ts"),
    }
    columns = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in existing.schema.fields
    ]
    offered = first.select(*columns, F.col("event_id").alias("_event"))
    return insert_ignore(existing, offered, ["id"], ["created_at", "_event"])


def signup_conversion(signups_with_next: DataFrame, within_days: int, by: Sequence[str]) -> DataFrame:
    """Share of sign-ups whose next payment follows within some days.

    Input rows carry the sign-up time ``ts`` and the time ``paid_ts`` of the payment after it.
    """
    days = F.expr(f"INTERVAL {int(within_days)} DAYS")
    paid = F.coalesce(F.col("paid_ts") <= F.col("ts") + days, F.lit(False))
    return signups_with_next.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_signups"),
        F.count_if(paid).alias("n_converted"),
        F.avg(paid.cast("double")).alias("conversion"),
    )
