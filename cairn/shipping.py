"""Makes the package importable in Python workers wherever they run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of a session, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn.zip")  # on the driver, which serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with the package sent to the workers before it is planned."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, folder, *args, **kwargs)

    return run
