"""Payments into plan state kept per user: each micro-batch emits only the users whose plan it changes.

The latest payment of a user stays in keyed state, filled at the start from the stored profiles. A repeated event, or one
older than what the state holds, changes nothing. With ``expire`` a plan ends that long after its payment in event time,
by a timer; the state then goes too. Every call of a key to the store costs the same whatever the key holds, so users are
dealt by hash to groups, and a key of the store holds the state of a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from boardwalk.operators import merge, rules
from boardwalk.operators.features import latest_per_key
from boardwalk.streaming.ingest import read_batches, start, write_batch

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT = T.StringType()
CHANGES = T.StructType(
    [T.StructField(c, T.LongType() if c == "paid_us" else _TEXT) for c in ("user_id", "plan", "plan_type", "season", "paid_us", "event_id")]
)
KEPT = "users array<string>, paid_us array<bigint>, event_ids array<string>, timer bigint"
STORED = "\U0010ffff"  # sorts after every event: of equal times the stored payment stays
GROUPS = 256


def _place(paid_us: int, event_id: str | None) -> tuple:
    """Sorts payments by time, then by id; one without an id comes first."""
    return paid_us, event_id is not None, event_id


class PlanState(StatefulProcessor):
    """The state of a group of users. ``expire`` in microseconds, or None."""

    def __init__(self, expire: int | None):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", KEPT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held, timer = self._held()
        rows = initialState[initialState["paid_us"].notna()]
        for user, paid_us in zip(rows["user_id"], rows["paid_us"], strict=True):
            if user not in held or int(paid_us) > held[user][0]:
                held[user] = (int(paid_us), STORED)
        if len(rows):
            self._keep(held, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for part in rows:
            for user, *own in zip(*(part[c].tolist() for c in ("user_id", "paid_us", "event_id", "plan_type", "season")), strict=True):
                if user not in best or _place(*own[:2]) > _place(*best[user][:2]):
                    best[user] = own
        held, timer = self._held()
        changed = {u: own for u, own in best.items() if u not in held or _place(*own[:2]) > _place(*held[u])}
        if changed:
            self._keep(held | {u: (int(paid_us), event_id) for u, (paid_us, event_id, _, _) in changed.items()}, timer)
            yield self._rows((u, merge.PAID, kind, season, int(paid_us), event_id) for u, (paid_us, event_id, kind, season) in changed.items())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ended = {u: own for u, own in held.items() if self._due(own[0]) <= now}
        left = {u: own for u, own in held.items() if u not in ended}
        if left:
            self._keep(left, None if timer is None or timer <= now else timer)
        else:
            self.latest.clear()
        if ended:
            yield self._rows((u, merge.FREE, None, None, self._due(paid_us) * 1000, event_id) for u, (paid_us, event_id) in ended.items())

    def close(self) -> None:
        pass

    def _held(self) -> tuple[dict, int | None]:
        """The latest payment of each user of the group, and when its next timer is due."""
        if not self.latest.exists():
            return {}, None
        users, paid_us, event_ids, timer = self.latest.get()
        return dict(zip(users, zip(paid_us, event_ids, strict=True), strict=True)), timer

    def _due(self, paid_us: int) -> int:
        return -(-(paid_us + self.expire) // 1000)

    def _keep(self, held: dict, timer: int | None) -> None:
        """A group waits for the first of its plans to end; when the timer fires, it waits for the next."""
        if self.expire is not None:
            first = min(self._due(paid_us) for paid_us, _ in held.values())
            if timer is None or first < timer:
                self.handle.registerTimer(first)
                timer = first
        self.latest.update((list(held), [p for p, _ in held.values()], [e for _, e in held.values()], timer))

    @staticmethod
    def _rows(values) -> pd.DataFrame:
        return pd.DataFrame(list(values), columns=CHANGES.names)


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state of this kind needs the store on disk; the session's own choice comes back after the start."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def plan_stream(
    events: DataFrame,
    profiles: DataFrame,
    path: str,
    checkpoint: str,
    expire: timedelta | None = None,
    delay: str = "7 days",
    once: bool = True,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Writes the changes of plans that the completed payments of an event stream make, batch by batch.

    Payments of an unknown plan type are passed over. Without ``expire`` no payment is too late to count; with it, events
    later than ``delay`` are dropped, as their timers may have fired. Without a user id a payment belongs to nobody, and
    without a time it is later than none. A batch reads and writes the state of the groups its payments fall in, so tables
    of many millions of users call for more ``groups``; a checkpoint holds for one number of them.
    """
    payments = rules.check(merge.completed_payments(events), rules.PAYMENT_RULES)
    payments = payments.filter(F.col("reject_reason").isNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    if expire is not None:
        payments = payments.withWatermark("ts", delay)
    place = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("place")
    keyed = payments.select(place, "user_id", "ts", F.unix_micros("ts").alias("paid_us"), "event_id", "season", "plan_type").groupBy("place")
    stored = profiles.select(F.col("id").alias("user_id"), F.unix_micros("paid_at").alias("paid_us")).filter(F.col("paid_us").isNotNull())
    span = None if expire is None else int(expire.total_seconds() * 1_000_000)
    stored = stored.select(place, "user_id", "paid_us").groupBy("place")
    changes = keyed.transformWithStateInPandas(PlanState(span), CHANGES, "Append", "None" if span is None else "EventTime", stored)
    with _rocks(events.sparkSession):
        return start(changes, lambda rows, batch: write_batch(rows, path, batch), checkpoint, once)


def changes_of(spark: SparkSession, path: str) -> DataFrame:
    """All changes written so far."""
    return read_batches(spark, path, CHANGES)


def profiles_after_changes(profiles: DataFrame, changes: DataFrame, at=None) -> DataFrame:
    """The profiles with the latest change of each user; an expired plan is free again."""
    latest = latest_per_key(changes, ["user_id"], ["paid_us", "event_id"])
    paid = latest.filter(F.col("plan") == merge.PAID)
    merged = merge.apply_payments(profiles, paid.select("event_id", F.timestamp_micros("paid_us").alias("ts"), "user_id", "season", "plan_type"), at)
    ended = latest.filter(F.col("plan") == merge.FREE).select(F.col("user_id").alias("id"), F.lit(True).alias("_ended"))
    return merged.join(ended, "id", "left").withColumn("plan", F.when(F.col("_ended"), merge.FREE).otherwise(F.col("plan"))).drop("_ended")
