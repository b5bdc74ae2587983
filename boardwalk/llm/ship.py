"""Makes the package importable in Python workers that were started without it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once a Spark application; Spark hands them to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="boardwalk-ship-")) / "boardwalk_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
