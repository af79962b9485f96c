"""Sends this package to the executors, for sessions that were not started with it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: add the package's sources as an archive of Python files."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _sent or not root.is_dir():
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sitegraph-")), "sitegraph-sources.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)
