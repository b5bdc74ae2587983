"""Sign-up and payment streams into keyed tables.

Every micro-batch is folded to its latest rows per key and written to a folder of its own,
``batch=<n>``, which a replay of the batch overwrites. The table is the fold of all batches over
its base. So a batch costs only its own rows, no file that is being read is replaced, and a lost
executor or a restart repeats a batch without changing the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from boardwalk import schemas
from boardwalk.operators import merge, rules
from boardwalk.operators.features import earliest_per_key, latest_per_key

SIGNUP_RULES = (*rules.EMAIL_RULES, rules.one_of("path", ("capture", "register")))
REASON = T.StructField("reject_reason", T.StringType())
REJECTED_SIGNUPS = T.StructType([*schemas.SIGNUP_EVENTS.fields, REASON])
REJECTED_PAYMENTS = T.StructType([*schemas.PAYMENTS.fields, REASON])


def without_repeats(
    events: DataFrame, event_id: str = "event_id", time: str = "ts", delay: str = "7 days"
) -> DataFrame:
    """Drops events seen before within the delay, and events later than the delay.

    The tables do not need this, as their folds ignore repeats; it saves writing them. An event
    without an id is known by its content.
    """
    content = F.sha2(F.to_json(F.struct("*")), 256)
    known = events.withColumn("_id", F.coalesce(F.col(event_id).cast("string"), content))
    return known.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_id"]).drop("_id")


# The batch of the compacted rows; those of streams count from 0.
BASE = -1


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_checked(
    rows: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, rejected_path: str, batch: int
) -> None:
    """Writes the fold of a batch's accepted rows, and its rejected rows as they are."""
    rows = rows.persist()
    try:
        write_batch(fold(rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")), path, batch)
        write_batch(rows.filter(F.col("reject_reason").isNotNull()), rejected_path, batch)
    finally:
        rows.unpersist()


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of all batches written so far, or of those ``before`` one; none before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.select(*schema.fieldNames())


def start(
    stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Runs ``each_batch`` on the stream; ``once`` stops when the present input is used up."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def fold_payments(payments: DataFrame) -> DataFrame:
    return latest_per_key(payments, ["user_id"], ["ts", "event_id"])


def payment_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    delay: str | None = None,
    once: bool = True,
    rejected_path: str | None = None,
) -> StreamingQuery:
    """Writes the completed payments of an event stream; with ``delay``, ``without_repeats``.

    Payments of an unknown plan type go to ``rejected_path``, with the reason; by default that is
    ``path`` with ``-rejected``. Other event types are passed over, and counted per batch as
    ``n_ignored`` of the progress report's ``payment_events``.
    """
    rejected_path = rejected_path or f"{path}-rejected"
    ignored = F.count_if(~F.col("type").eqNullSafe(merge.PAYMENT_TYPE))
    events = events.observe("payment_events", F.count(F.lit(1)).alias("n_events"), ignored.alias("n_ignored"))
    payments = merge.completed_payments(events)
    if delay:
        payments = without_repeats(payments, delay=delay)

    def each_batch(rows: DataFrame, batch: int) -> None:
        write_checked(rows, fold_payments, path, rejected_path, batch)

    return start(rules.check(payments, rules.PAYMENT_RULES), each_batch, checkpoint, once)


def profiles_after_payments(profiles: DataFrame, path: str, at=None) -> DataFrame:
    """The profiles with all payments written so far."""
    payments = read_batches(profiles.sparkSession, path, schemas.PAYMENTS)
    return merge.apply_payments(profiles, payments, at)


def fold_signups(events: DataFrame) -> DataFrame:
    """What can still matter of sign-up events: per address the latest capture, the earliest registration."""
    captures = events.filter(F.col("path") == "capture")
    registers = events.filter(F.col("path") == "register")
    order = ["ts", "event_id"]
    return latest_per_key(captures, ["email"], order).unionByName(earliest_per_key(registers, ["email"], order))


def signup_stream(
    events: DataFrame,
    path: str,
    rejected_path: str,
    checkpoint: str,
    delay: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Writes valid sign-ups to ``path`` and the rest, with the reason, to ``rejected_path``."""
    if delay:
        events = without_repeats(events, delay=delay)
    checked = rules.check(rules.signup_sources(events), SIGNUP_RULES)

    def each_batch(rows: DataFrame, batch: int) -> None:
        write_checked(rows, fold_signups, path, rejected_path, batch)

    return start(checked, each_batch, checkpoint, once)


def malformed_stream(malformed: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the bodies that are no events, see ``readers.malformed_of``."""
    return start(malformed, lambda rows, batch: write_batch(rows, path, batch), checkpoint, once)


def email_list(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """The e-mail list with all sign-ups written so far."""
    return merge.email_list(read_batches(spark, path, schemas.SIGNUP_EVENTS), existing)


def compact(
    spark: SparkSession, path: str, target: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]
) -> None:
    """Writes the fold of all batches as the base of a new folder; no stream ever numbers a batch so."""
    write_batch(fold(read_batches(spark, path, schema)), target, BASE)


def conversions(
    signups: DataFrame, payments: DataFrame, within: str = "7 days", delay: str = "1 day", user: str = "user_id"
) -> DataFrame:
    """Joins two streams: each sign-up (``user``, ``ts``) with the user's payments up to ``within`` later."""
    left = signups.withColumnRenamed("ts", "signup_ts").withWatermark("signup_ts", delay)
    right = payments.select(F.col(user).alias("_user"), F.col("ts").alias("paid_ts")).withWatermark(
        "paid_ts", delay
    )
    later = (F.col("paid_ts") > F.col("signup_ts")) & (
        F.col("paid_ts") <= F.col("signup_ts") + F.expr(f"INTERVAL {within}")
    )
    return left.join(right, (F.col(user) == F.col("_user")) & later).drop("_user")


def first_conversions(signups: DataFrame, matches: DataFrame, key: str = "event_id") -> DataFrame:
    """Every sign-up with ``paid_ts`` of its earliest match in the log of ``conversions``, null where none came.

    An outer join of the streams would hold the last sign-ups back until later events pass the
    watermark; read from the logs, none is missing.
    """
    return signups.join(matches.groupBy(key).agg(F.min("paid_ts").alias("paid_ts")), key, "left")
