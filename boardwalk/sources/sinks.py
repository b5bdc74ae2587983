"""Writers of the data products."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from boardwalk.operators.merge import new_rows


def publish_boards(boards: DataFrame, path: str, owned: Iterable[str] = ()) -> None:
    """One output folder per board; a published board is replaced, the others stay.

    An ``owned`` board that has no rows now is removed.
    """
    owned = set(owned)
    present = {row[0] for row in boards.select("board").distinct().collect()} if owned else owned
    (
        boards.repartition("board")
        .sortWithinPartitions("board", "rank")
        .write.partitionBy("board")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    spark = boards.sparkSession
    for name in sorted(owned - present):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/board={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_json(product: DataFrame, path: str) -> None:
    """A data product as JSON lines, nulls written out so that every record has every field."""
    product.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(existing: DataFrame, offered: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Appends the offered rows whose key the table at ``path`` lacks."""
    new_rows(existing, offered, keys, order).write.mode("append").parquet(path)
