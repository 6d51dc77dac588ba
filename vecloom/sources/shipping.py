"""The package on the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package as a zip, so that they need no shared installation."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="vecloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "vecloom_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def spread(df):
    """df in as many partitions as there are task slots, if it has fewer: small files are cut by size, and a row group then lies in one of the cuts.

    Large tables have more partitions than slots and stay as they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df._jdf.queryExecution().toRdd().getNumPartitions() < slots else df
