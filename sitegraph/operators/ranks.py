"""Positions in a global order, over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positioned(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the position of each row, from 1, in an order that tells all rows apart.

    Rows are range-partitioned by the order; each partition counts its own, and what the partitions
    before it hold is added. Partitions are cut by a checkpoint, so a lost executor changes nothing.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = df.repartitionByRange(parts, *order).withColumn("part__", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = lined.groupBy("part__").agg(F.count("*").alias("n__")).select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    local = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return lined.withColumn(name, local).join(F.broadcast(counts), "part__").withColumn(name, F.col(name) + F.col("before__")).drop("part__", "before__")
