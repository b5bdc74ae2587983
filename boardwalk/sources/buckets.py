"""Tables stored in buckets of their key, for reads by key that do not move the table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 1_000


def store(table: DataFrame, path: str, buckets: int, key: str = "id") -> DataFrame:
    """Writes the table in sorted buckets of ``key`` and reads it from there; the catalog gets a name of its own for it."""
    name = f"boardwalk_{uuid.uuid4().hex}"
    dealt = table.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return table.sparkSession.table(name)


def find(keys: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The stored row of each requested key, nulls where there is none; only the requests are shuffled, to the buckets."""
    return keys.select(key).hint("shuffle_merge").join(stored.hint("shuffle_merge"), key, "left")


def find_few(wanted: Sequence, stored: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows of a few keys; no other bucket than theirs is read."""
    if len(wanted) > FEW:
        raise ValueError(f"more than {FEW} keys: use find")
    return stored.filter(F.col(key).isin(list(wanted)))
