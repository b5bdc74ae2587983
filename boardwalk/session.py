"""Session defaults, and the shared folder that long jobs cut their lineage to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "boardwalk", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators rely on; ``settings`` use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one when it is unset."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="boardwalk-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one run's tables, next to the checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later reads neither recompute nor lose it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialise`` plus the number of rows written."""
    stored = materialise(df)
    return stored, stored.agg(F.count(F.lit(1))).first()[0]
