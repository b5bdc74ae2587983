"""What the operators share: scratch tables, Arrow loops, id filters of bounded size, labelled samples."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.session import checkpoint_root

_LEFT: list[tuple[SparkSession, str]] = []


class Scratch:
    """Tables of one run, written as Parquet next to the checkpoints, which every executor can read.

    ``drop`` removes a table that no later step reads. What a returned DataFrame still reads stays until the
    driver ends, as results are lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _LEFT.append((spark, self.path))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Only the columns an operator works on, under its own names."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text, so that arrays over their bytes stay small."""
    for batch in batches:
        lengths = np.diff(offsets_of(batch.column(column))) if batch.num_rows else np.zeros(0, np.int64)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What runs meanwhile hands Arrow batches of about ``size`` bytes to Python workers, instead of 10,000 rows of any
    length, which the executor holds besides its heap. A setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) is not None
    if not own:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(name)


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets_of(column)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def giving_back(loop: Callable) -> Callable:
    """``loop``, which at the end of its partition gives freed memory back to the system.

    Workers are reused; what the allocators of Arrow and C hold back would add up from one stage to the next.
    """

    def run(batches):
        yield from loop(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def over_texts(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str, size: int = 1 << 18) -> DataFrame:
    """``work`` on small runs of rows, as Arrow batches; it returns the columns of its result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def loop(batches):
        for piece in pieces(batches, size=size):
            found = work(piece)
            if found is not None:
                yield pa.RecordBatch.from_arrays([_as(found[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(giving_back(loop), schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of ``counts`` values a row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# A set of 64-bit keys as bits of their hash. It may hold other keys too, so use it where that only costs work.

BITS = (20, 30)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(keys: DataFrame):
    """Broadcast of the bits of a stored column of longs: 16 bits a key, but at most 2**30 bits (128 MB).

    Beyond that many keys more others look like members. Tasks and a map-side aggregate put the bits together, 64
    at a time; the driver gets a long for each 64 bits.
    """
    bits = min(BITS[1], max(BITS[0], int(keys.count()).bit_length() + 4))
    spark, (name,) = keys.sparkSession, keys.columns

    def spots(batches):
        for batch in batches:
            found = np.unique(slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            if len(found):
                place, first = np.unique(found >> 6, return_index=True)
                ones = np.bitwise_or.reduceat(np.uint64(1) << (found & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ones.view(np.int64))], ["place", "ones"])

    spread = keys.select(F.col(name).cast("long")).mapInArrow(giving_back(spots), "place long, ones long")
    table = spread.groupBy("place").agg(F.bit_or("ones").alias("ones")).toArrow()
    whole = np.zeros(1 << (bits - 6), np.uint64)
    whole[table.column("place").to_numpy()] = table.column("ones").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(whole)


def within(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slots(keys, len(whole).bit_length() + 5)
    return (whole[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def rows_maybe_in(df: DataFrame, key: str, marks, inside: bool = True) -> DataFrame:
    """Rows of ``df``, all columns, whose key is (or is not) in the bitmap; nulls are not in it."""
    place = df.columns.index(key)

    def loop(batches):
        for batch in batches:
            column = batch.column(place)
            keys = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            mask = within(marks.value, keys) & ~column.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(mask if inside else ~mask))

    return df.mapInArrow(giving_back(loop), df.schema)


def labelled_sample(labels: DataFrame, label: str, bound: int, seen: Column) -> DataFrame:
    """At most ``bound`` labelled ids for a fit, spread by hash; one label an id (the largest, if they differ)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & seen)
    one = usable.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
