"""Writes with keys, as pure functions from the old table and the new rows to the next table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_wins(rows: DataFrame, keys: list[str], order: list[str], blank_passes: bool = False) -> DataFrame:
    """The first row of a key; with blank_passes rows whose key is null or empty all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    keep = F.col("_r") == 1
    if blank_passes:
        for k in keys:
            keep = keep | (F.coalesce(F.col(k).cast("string"), F.lit("")) == "")
    return rows.withColumn("_r", F.row_number().over(w)).where(keep).drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return old.unionByName(first_wins(new, keys, order).join(old, keys, "left_anti"), allowMissingColumns=True)


def merge_operator_stores(arrivals: DataFrame) -> DataFrame:
    """One row for each operator and store: the first brand, type and way stay, confidence and number are the greatest."""
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", c))).alias(c)
    return arrivals.groupBy("operator_name", "place_id").agg(filled("brand"), filled("operator_type"), filled("discovered_via"), F.max("confidence").alias("confidence"), F.max("verification_score").alias("verification_score"), F.max("corporate_number").alias("corporate_number"))


def links_of(arrivals: DataFrame) -> DataFrame:
    out = arrivals.groupBy("brand", "operator_name").agg(F.max("corporate_number").alias("corporate_number"), F.count_distinct("place_id").alias("estimated_store_count"), F.min("operator_type").alias("operator_type"))
    return out.withColumn("source", F.when(F.col("estimated_store_count") % 2 == 0, "official").otherwise("pipeline"))


def seed_rows(links: DataFrame) -> DataFrame:
    """A placeholder store for each store that a registered link counts, one at least."""
    n = F.greatest(F.col("estimated_store_count"), F.lit(1))
    rows = links.where("corporate_number <> ''").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return rows.select("operator_name", "brand", F.concat_ws(":", F.lit("REG"), "corporate_number", "brand", "i").alias("place_id"), F.lit(0.95).alias("confidence"))


def fill_blank(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    fresh = new.select(F.col(key), F.col(column).alias("_new"))
    return old.join(fresh, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), "_new", F.lit(""))).drop("_new")


def remap(links: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rows of an old id go to its new id; rows that then are alike are one, with the greatest count."""
    moved = links.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")
    keys = [c for c in moved.columns if c != "estimated_store_count"]
    return moved.groupBy(*keys).agg(F.max("estimated_store_count").alias("estimated_store_count"))
