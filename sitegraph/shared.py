"""The folder that driver and executors share, read from the session, and tables kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "spark.checkpoint.dir"
#: Fixed value: tables of so many short rows may be broadcast.
BROADCAST_ROWS = 200_000


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of this machine, set for local masters alone."""
    base = spark.conf.get(NAME, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{NAME} is not set: driver and executors need a folder that they share")
        base = f"file://{tempfile.gettempdir()}/sitegraph-shared"
        spark.conf.set(NAME, base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def small(df: DataFrame) -> DataFrame:
    """Checkpointed, and for a broadcast if it has few rows."""
    df = df.checkpoint()
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
