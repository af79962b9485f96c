"""Consolidation of operators that share a key, as connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp) of a bipartite table (node, key): nodes that share a key, however indirectly, get their least node.

    The least label goes from nodes to keys and back, and each node then takes its label's label, so
    the rounds grow with the logarithm of the longest chain. Labels are checkpointed in the shared
    folder; both steps are grouped minima, so a key of many nodes is pre-aggregated.
    """
    pairs = pairs.where("node is not null and key is not null").select("node", "key").distinct().checkpoint()
    labels = pairs.select("node").distinct().withColumn("comp", F.col("node"))
    for _ in range(rounds):
        keys = pairs.join(labels, "node").groupBy("key").agg(F.min("comp").alias("comp"))
        near = pairs.join(keys, "key").groupBy("node").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = labels.join(near, "node").join(jump, "near", "left").select("node", F.least("comp", "near", "far").alias("comp"), F.col("comp").alias("was")).checkpoint()
        changed = new.where("comp <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def consolidate(links: DataFrame) -> DataFrame:
    """Operators merged by corporate number or by name without blanks: names, greatest count by brand, totals."""
    name_key = F.concat(F.lit("n:"), F.regexp_replace("operator_name", r"[\s　]+", ""))
    number_key = F.concat(F.lit("c:"), F.nullif(F.col("corporate_number"), F.lit("")))
    pairs = links.select(F.col("operator_name").alias("node"), F.explode(F.array(name_key, number_key)).alias("key"))
    merged = links.join(components(pairs).withColumnRenamed("node", "operator_name"), "operator_name")
    per = merged.groupBy("comp", "brand").agg(F.max("estimated_store_count").alias("n"))
    names = merged.groupBy("comp").agg(F.array_join(F.array_sort(F.collect_set("operator_name")), " / ").alias("names"), F.max("corporate_number").alias("corporate_number"))
    return per.groupBy("comp").agg(F.sum("n").alias("total_stores"), F.count("*").alias("brand_count")).join(names, "comp")
