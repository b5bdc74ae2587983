"""Event-time windows over streams, and what comes too late for them.

Windows are kept in state until the watermark passes them and are then written once, each micro-batch to a folder of its
own, so that a replay changes nothing. Events that can no longer count in a window go to a side log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from boardwalk.streaming.ingest import read_batches, start, write_batch

SEEN = T.StructType([T.StructField("newest", T.TimestampType())])


def window_counts(events: DataFrame, by: Sequence[str], width: str, slide: str | None = None, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events per key and window (``begin``, ``n``); windows overlap if ``slide`` is shorter than ``width``."""
    return _counted(events, F.window(time, width, slide), by, time, delay)


def session_counts(events: DataFrame, by: Sequence[str], gap: str, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events per key and session: a run of events less than ``gap`` apart."""
    return _counted(events, F.session_window(time, gap), by, time, delay)


def _counted(events: DataFrame, window: Column, by: Sequence[str], time: str, delay: str) -> DataFrame:
    counted = events.withWatermark(time, delay).groupBy(window.alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("_w.start").alias("begin"), "n")


def window_stream(windows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each window once the watermark has passed it."""
    return start(windows, lambda rows, batch: write_batch(rows, path, batch), checkpoint, once)


def late_stream(events: DataFrame, path: str, checkpoint: str, width: str, time: str = "ts", delay: str = "1 day", once: bool = True) -> StreamingQuery:
    """Writes the events whose window of ``width`` had closed before their micro-batch came, as they are.

    As in the windows' own stream, an event of a batch is late by the watermark that the batch before it worked with: the
    newest time of all batches up to the last but one, less the delay. So both streams have to cut their input alike, as
    one file a batch does. Each batch logs its newest time next to the late events, so a replay judges by the same batches.
    """

    def each_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            seen = read_batches(spark, f"{path}-seen", SEEN, before=batch - 1)
            newest = seen.agg(F.max("newest")).first()[0]
            closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            write_batch(rows.filter(F.window(time, width).getField("end") <= closed), path, batch)
            write_batch(rows.agg(F.max(time).alias("newest")), f"{path}-seen", batch)
        finally:
            rows.unpersist()

    return start(events, each_batch, checkpoint, once)


def read_windows(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The windows written so far; ``keys`` are the DDL of their key columns."""
    return read_batches(spark, path, T.StructType.fromDDL(f"{keys}, begin timestamp, n bigint"))
