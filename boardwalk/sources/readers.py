"""Readers of the JSON products and of event payloads. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.schemas import ROSTER_CONFIG

CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool | None = None) -> DataFrame:
    """A JSON array of objects, on one line or many, or JSON lines; malformed input fails.

    One file of an array is one task, as it cannot be split; JSON lines are read in parallel.
    Unless ``lines`` says which it is, input whose first line is a whole object is taken as lines.
    """
    if lines is None:
        line = F.trim("value")
        ends = spark.read.text(path).filter(line != "").select(F.left(line, F.lit(1)), F.right(line, F.lit(1)))
        first = ends.first()
        lines = first is not None and tuple(first) == ("{", "}")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", not lines).json(path)


def optional(read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """What ``read`` gives, or no rows where its path is missing. Malformed input still fails."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return SparkSession.active().createDataFrame([], schema)


def read_map(
    spark: SparkSession, path: str, value: T.DataType, key: str = "key", out: str = "value"
) -> DataFrame:
    """A JSON object as one row per key; a struct value is spread into its fields."""
    kind = T.MapType(T.StringType(), value)
    document = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", kind, {"mode": "FAILFAST"})
    rows = document.select(F.explode(entries).alias(key, out))
    return rows.select(key, f"{out}.*") if isinstance(value, T.StructType) else rows


def read_roster_config(spark: SparkSession, path: str) -> DataFrame:
    """The one-document roster configuration."""
    return read_records(spark, path, ROSTER_CONFIG)


def payload(schema: T.StructType, column: str = "value") -> Column:
    """A JSON body as a struct, with the whole body in ``_corrupt_record`` where it does not parse."""
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(F.col(column).cast("string"), fields, {"columnNameOfCorruptRecord": CORRUPT})


def events_of(bodies: DataFrame, schema: T.StructType, time: str = "ts") -> DataFrame:
    """The fields of the bodies (``value``) that parse and have a time."""
    parsed = bodies.select(payload(schema).alias("e")).filter(F.col(f"e.{CORRUPT}").isNull())
    return parsed.select("e.*").drop(CORRUPT).filter(F.col(time).isNotNull())


def malformed_of(bodies: DataFrame, schema: T.StructType, time: str = "ts") -> DataFrame:
    """The bodies that ``events_of`` leaves out, as they came."""
    parsed = bodies.select("value", payload(schema).alias("e"))
    return parsed.filter(F.col(f"e.{CORRUPT}").isNotNull() | F.col(f"e.{time}").isNull()).select("value")


def read_bodies(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of event files, one JSON body per line, as ``value``."""
    return spark.readStream.options(**options).text(path)


def find_by_key(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """The table's row of each requested key, nulls where there is none."""
    return keys.select(key).join(table, key, "left")
