"""Queries over streams of many micro-batches, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.plans import frames
from boardwalk.plans.oracle import EMAIL_LIST, EVENTS, PROFILES
from boardwalk.plans.queries import UPDATED, profile_columns, query
from boardwalk.session import scratch_path
from boardwalk.streaming import ingest, keyed, windows

FILES = 6
FILE_ROWS = 1 << 19
DELAY = "1 day"


def in_files(rows: DataFrame, path: str, late=None, more: tuple[DataFrame, ...] = (), file_rows: int = FILE_ROWS) -> int:
    """The rows as ``FILES`` parts of rising time, written one after the other, those of ``late`` in a last one, then ``more``.

    Gives the number of files a part, the same for all: as many as keep a file at about ``file_rows`` rows.
    """
    spark, schema = rows.sparkSession, rows.schema
    late = F.lit(False) if late is None else late
    bounds = rows.agg(F.min("ts"), F.max("ts")).first()
    share = F.try_divide(F.unix_micros("ts") - F.unix_micros(F.lit(bounds[0])), F.unix_micros(F.lit(bounds[1])) - F.unix_micros(F.lit(bounds[0])))
    part = F.when(late, FILES).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * FILES), F.lit(FILES - 1)))
    parts = [rows.withColumn("part", part.cast("int")), *(m.withColumn("part", F.lit(FILES + 1 + i)) for i, m in enumerate(more))]
    reduce(DataFrame.unionByName, parts).write.partitionBy("part").parquet(f"{path}-parts")
    staged = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{path}-parts")
    largest = staged.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-largest // file_rows))
    for i in range(FILES + 1 + len(more)):
        staged.filter(F.col("part") == i).drop("part").repartition(files).write.mode("append").parquet(path)
        # Parts of few rows leave files out; without them a micro-batch would reach into the next part.
        while len(spark.read.schema(schema).parquet(path).inputFiles()) < files * (i + 1):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    return files


def as_stream(spark, rows: DataFrame, path: str, files: int) -> DataFrame:
    """The files as a stream that takes one part of them a micro-batch, in the order in which they were written."""
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def interrupted(run) -> None:
    """Runs a stream for a few micro-batches, stops it in the middle, and runs it again from its checkpoint to the end."""
    first = run(False)
    while first.isActive and (first.lastProgress is None or first.lastProgress["batchId"] < 2):
        first.awaitTermination(0.2)
    first.stop()
    run(True).awaitTermination()


@query
def stream_windows(spark, folder):
    """Sign-ups per source in days and in overlapping three-day windows, sessions of views per user, and late sign-ups."""
    target = scratch_path(spark, "windows")
    events = frames.events(spark, folder).select("ts", "user_id", "event_type", "k", frames.source_of("k").alias("source"))
    newest = events.agg(F.max("ts")).first()[0]
    late = (F.col("event_type") == "signup") & (F.col("k") < 5) & (F.col("ts") < F.lit(newest) - F.expr("INTERVAL 10 DAYS"))
    # An event far ahead lets the last windows close; it belongs to no kind that is counted.
    ahead = events.limit(1).withColumns({"ts": F.lit(newest) + F.expr("INTERVAL 900 DAYS"), "event_type": F.lit("end")})
    files = in_files(events, f"{target}/events", late, (ahead,))

    def stream(*kinds: str) -> DataFrame:
        return as_stream(spark, events, f"{target}/events", files).withColumn("kind", F.when(F.col("event_type").isin(*kinds), "counted").otherwise("other"))

    views = stream("view").withColumn("source", F.col("user_id").cast("string"))
    made = {
        "day": windows.window_counts(stream("signup"), ["kind", "source"], "1 day", delay=DELAY),
        "three_days": windows.window_counts(stream("signup"), ["kind", "source"], "3 days", "1 day", delay=DELAY),
        "session": windows.session_counts(views, ["kind", "source"], "2 days", delay=DELAY),
    }
    found = []
    for name, rows in made.items():
        windows.window_stream(rows, f"{target}/{name}", f"{target}/{name}-progress").awaitTermination()
        written = windows.read_windows(spark, f"{target}/{name}", "kind string, source string")
        found.append(written.filter(F.col("kind") == "counted").select(F.lit(name).alias("window"), "source", F.unix_micros("begin").alias("begin_us"), "n"))
    came = stream("signup")
    windows.late_stream(came, f"{target}/late", f"{target}/late-progress", "1 day", delay=DELAY).awaitTermination()
    days = F.unix_micros(F.window("ts", "1 day").getField("start")).alias("begin_us")
    lost = ingest.read_batches(spark, f"{target}/late", came.schema).filter(F.col("kind") == "counted")
    lost = lost.groupBy(F.lit("late").alias("window"), "source", days).agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [*found, lost])


@query
def stream_payment_batches(spark, folder):
    """``stream_payment`` over many micro-batches, stopped in the middle and taken up again; a part of the payments comes
    twice, at the end."""
    target = scratch_path(spark, "payment-batches")
    sent = frames.payment_events(frames.events(spark, folder))
    files = in_files(sent, f"{target}/events", more=(sent.filter(F.second("ts") < 20),))
    interrupted(lambda once: ingest.payment_stream(as_stream(spark, sent, f"{target}/events", files), f"{target}/log", f"{target}/progress", once=once))
    paid = ingest.profiles_after_payments(frames.profiles(spark, folder), f"{target}/log", F.lit(UPDATED).cast("timestamp"))
    return paid.select(*profile_columns())


@query
def stream_signup_batches(spark, folder):
    """``stream_signup`` over many micro-batches, the newest first, stopped in the middle and taken up again."""
    target = scratch_path(spark, "signup-batches")
    sent = frames.signups(frames.events(spark, folder))
    backwards = F.col("ts").isNotNull() & (F.dayofmonth("ts") <= 10)
    files = in_files(sent, f"{target}/events", backwards)
    interrupted(lambda once: ingest.signup_stream(as_stream(spark, sent, f"{target}/events", files), f"{target}/log", f"{target}/rejected", f"{target}/progress", once=once))
    listed = ingest.email_list(spark, f"{target}/log")
    return listed.select("email", "source", F.unix_micros("created_at").alias("created_us"))


SQL = {
    "stream_payment_batches": PROFILES,
    "stream_signup_batches": EMAIL_LIST,
    "stream_windows": f"""with {EVENTS},
        s as (
          select *, event_type = 'signup' and k < 5 and ts < (select max(ts) from ev) - interval 10 days as late,
            date_trunc('day', ts) as day
          from src),
        good as (select * from s where event_type = 'signup' and not late),
        days as (select source, day, count(*) as n from good group by 1, 2),
        spans as (select source, day - to_days(cast(back as integer)) as begin, n from days, range(3) r(back)),
        marks as (
          select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 days then 1 else 0 end as new
          from s where event_type = 'view'),
        runs as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as run from marks)
        select 'day' as window, source, epoch_us(day) as begin_us, n from days
        union all select 'three_days', source, epoch_us(begin), cast(sum(n) as bigint) from spans group by 1, 2, 3
        union all select 'session', cast(user_id as varchar), epoch_us(min(ts)), count(*) from runs group by user_id, run
        union all select 'late', source, epoch_us(day), count(*) from s where late group by 2, 3""",
}


@query
def stream_plan_state(spark, folder):
    """``stream_payment`` by state kept per user, over many micro-batches with late and repeated events and a restart, and the
    number of times each user's plan changed."""
    target = scratch_path(spark, "plan-state")
    sent = frames.payment_events(frames.events(spark, folder))
    files = in_files(sent, f"{target}/events", F.second("ts") < 10, (sent.filter(F.second("ts") < 20),))
    profiles = frames.profiles(spark, folder)
    interrupted(lambda once: keyed.plan_stream(as_stream(spark, sent, f"{target}/events", files), profiles, f"{target}/changes", f"{target}/progress", once=once))
    changes = keyed.changes_of(spark, f"{target}/changes")
    paid = keyed.profiles_after_changes(profiles, changes, F.lit(UPDATED).cast("timestamp"))
    known = changes.groupBy(F.col("user_id").alias("id")).agg((F.count(F.lit(1)) <= FILES + 2).alias("few_changes"))
    return paid.join(known, "id", "left").select(*profile_columns(), F.coalesce("few_changes", F.lit(True)).alias("few_changes"))


SQL["stream_plan_state"] = f"select *, true as few_changes from ({PROFILES})"
