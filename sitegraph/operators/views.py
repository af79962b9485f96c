"""Aggregates over operator evidence: mega, medium and small operators, brands, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nz
from .ranks import positioned

MEGA, MEDIUM = 20, 5


def distinct_list(c: str, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def mean(c: str) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), 8)


def named(os: DataFrame, headquarters: bool = False) -> DataFrame:
    """Rows with an operator; those of headquarters only if asked for. A null type is none of a headquarters."""
    rows = os.where(nz("operator_name") != "")
    return rows if headquarters else rows.where(nz("operator_type") != "franchisor")


def _view() -> list[Column]:
    return [F.count_distinct("place_id").alias("store_count"), mean("confidence").alias("avg_confidence"), distinct_list("brand").alias("brands"), distinct_list("discovered_via").alias("discovered_via_methods"), F.min("operator_type").alias("operator_type")]


def mega_franchisees(os: DataFrame) -> DataFrame:
    return named(os).groupBy("operator_name").agg(*_view())


def franchisors(os: DataFrame) -> DataFrame:
    return os.where("operator_type = 'franchisor'").groupBy("operator_name").agg(F.count_distinct("place_id").alias("found_at_store_count"), distinct_list("brand").alias("brands"))


def size_class(n: Column) -> Column:
    return F.when(n >= MEGA, "mega").when(n >= MEDIUM, "medium").otherwise("small")


def all_franchisees(os: DataFrame) -> DataFrame:
    """mega_franchisees with the best score, a corporate number and a class of size, in one aggregation."""
    more = [F.max("verification_score").alias("best_verification_score"), F.max("corporate_number").alias("corporate_number")]
    return named(os).groupBy("operator_name").agg(*_view(), *more).withColumn("size_class", size_class(F.col("store_count")))


def multi_brand(os: DataFrame, strict: bool = False) -> DataFrame:
    """An operator's stores by brand; strict counts the distinct least places of its brands as total_stores.

    os has a row for an operator and place, so its places are counted with its brands, and those under two brands once.
    """
    per = named(os).groupBy("operator_name", "brand").agg(F.count_distinct("place_id").alias("n"), F.min("place_id").alias("least"), F.max("discovered_via").alias("via"), F.max("corporate_number").alias("corp"), F.min("operator_type").alias("type"))
    out = per.groupBy("operator_name").agg(F.count_distinct("least").alias("least_places"), F.sum("n").alias("places"), F.count("*").alias("brand_count"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("brand", "n"))))).alias("brand_counts_json"), distinct_list("via").alias("discovered_via_methods"), F.max("corp").alias("corporate_number"), F.min("type").alias("operator_type"))
    return out.withColumnRenamed("least_places", "total_stores").drop("places") if strict else out.withColumnRenamed("places", "total_stores").drop("least_places")


def legacy_mega(judgements: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("franchisee_name"), F.lit("")), F.col("operator_name"))
    ok = (F.col("operation_type") == "franchisee") | (F.col("operation_type").isNull() & (F.col("is_franchise") == 1))
    return judgements.where(ok & (nz(key) != "")).groupBy(key.alias("operator_name")).agg(F.count("*").alias("store_count"), mean("confidence").alias("avg_confidence"))


def operator_totals(links: DataFrame) -> DataFrame:
    return links.groupBy("operator_name").agg(F.sum("estimated_store_count").alias("total_stores"), F.count_distinct("brand").alias("brand_count"), (F.sum("estimated_store_count") >= MEGA).alias("is_mega"))


def at_least(view: DataFrame, n: int = MEGA) -> DataFrame:
    return view.where(F.col("store_count") >= n).orderBy(F.desc("store_count"), F.desc("avg_confidence"), "operator_name")


def brand_groups(os: DataFrame, least: int, blocked: DataFrame | None = None) -> DataFrame:
    """Operators of a brand with the least number of stores, without blocked names."""
    out = os.where(nz("operator_name") != "").groupBy("operator_name", "brand").agg(F.count_distinct("place_id").alias("n"), F.max("corporate_number").alias("corporate_number"), F.min("operator_type").alias("operator_type")).where(F.col("n") >= least)
    return out.join(blocked, "operator_name", "left_anti") if blocked is not None else out


def unknown_operators(os: DataFrame, registered: DataFrame, least: int) -> DataFrame:
    return os.where("operator_type = 'unknown'").join(registered, "operator_name", "left_anti").groupBy("operator_name").agg(F.count_distinct("place_id").alias("n")).where(F.col("n") >= least)


def cross_brand(links: DataFrame, min_total: int, min_brands: int) -> DataFrame:
    """Operators by corporate number, or by name where there is none, over all brands."""
    key = F.when(nz("corporate_number") != "", F.concat(F.lit("corp:"), "corporate_number")).otherwise(F.concat(F.lit("name:"), F.lower(F.regexp_replace("operator_name", r"\s+", ""))))
    per = links.withColumn("key", key).groupBy("key", "brand").agg(F.sum("estimated_store_count").alias("n"), F.max_by("operator_name", F.struct(F.length("operator_name"), "operator_name")).alias("name"))
    out = per.groupBy("key").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("operator_name"), F.sum("n").alias("total_stores"), F.count("*").alias("brand_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "brand", "n"))), lambda x: F.concat_ws(":", x["brand"], x["n"])), "; ").alias("brands_breakdown"))
    return out.where((F.col("total_stores") >= min_total) & (F.col("brand_count") >= min_brands))


def typical(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one seen first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", (-F.col("first_seen")).alias("f"), value)).alias(value), F.max("n").alias("n"))


def strict_ranking(links: DataFrame, targets: list[str] | None = None, min_total: int = MEGA, min_brands: int = 2) -> DataFrame:
    """Operators of min_total stores and min_brands counted brands; headquarters and direct stores, and empty counts, aren't counted."""
    counted = ~nz("operator_type").isin("franchisor", "direct") & (F.col("estimated_store_count") > 0)
    if targets is not None:
        counted &= F.col("brand").isin(targets)
    out = links.groupBy("operator_name").agg(F.sum("estimated_store_count").alias("total_stores"), F.count_distinct(F.when(counted, F.col("brand"))).alias("counted_brands"), F.array_join(F.array_sort(F.collect_set(F.when(counted, F.col("brand")))), " / ").alias("brands"))
    return out.where((F.col("total_stores") >= min_total) & (F.col("counted_brands") >= min_brands))


def evidence_only(links: DataFrame, min_total: int = MEGA) -> DataFrame:
    counted = ~nz("operator_type").isin("franchisor", "direct")
    out = links.groupBy("operator_name").agg(F.sum("estimated_store_count").alias("total_stores"), F.count_distinct("brand").alias("broad_brands"), F.count_distinct(F.when(counted, F.col("brand"))).alias("counted_brands"))
    return out.where((F.col("total_stores") >= min_total) & (F.col("broad_brands") >= 2) & (F.col("counted_brands") < 2))


def wide(links: DataFrame, brands: list[str]) -> DataFrame:
    """A column of stores for each brand, and the rank by total, brands and name."""
    per = links.groupBy("operator_name").pivot("brand", brands).agg(F.max("estimated_store_count"))
    cols = [F.coalesce(F.col(f"`{b}`"), F.lit(0)).alias(b.replace("#", "_").lower()) for b in brands]
    out = per.select("operator_name", *cols)
    names = out.columns[1:]
    total, held = sum((F.col(c) for c in names), F.lit(0)), sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in names), F.lit(0))
    out = out.withColumns({"total": total.cast("long"), "held": held.cast("int")})
    return positioned(out, [F.desc("total"), F.desc("held"), F.asc("operator_name")], "company_priority_rank")


def fill_rate(links: DataFrame) -> DataFrame:
    """By brand: the greatest total of its headquarters or direct stores, the sums of what its operators count, with a status and a priority.

    An operator is its corporate number, else its name without blanks; each counts with its greatest
    franchisee count, and as a candidate with the greater of that and its unknown count.
    """
    who = F.coalesce(F.nullif(nz("corporate_number"), F.lit("")), F.regexp_replace(nz("operator_name"), r"[\s　]+", ""))
    hq = F.col("operator_type").isin("franchisor", "direct")
    n = F.coalesce("estimated_store_count", F.lit(0))
    per = links.withColumns({"hq": F.when(hq, n), "who": F.when(hq | (who == ""), None).otherwise(who), "n": n}).groupBy("brand", "who").agg(
        F.max("hq").alias("hq"), F.max(F.when(F.col("who").isNotNull() & (F.col("operator_type") == "franchisee"), F.col("n"))).alias("fr"),
        F.max(F.when(F.col("who").isNotNull() & F.col("operator_type").isin("franchisee", "unknown"), F.col("n"))).alias("cand"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = per.groupBy("brand").agg(zero(F.max("hq")).alias("expected"), zero(F.sum("fr")).alias("franchisee"), zero(F.sum("cand")).alias("candidate"), F.count("fr").alias("operators"))
    pct = F.col("franchisee") * 100 / F.col("expected")
    status = F.when(F.col("expected") <= 0, "no_franchisor_total").when(F.col("operators") == 0, "empty").when(pct > 120, "overfilled_review").when(pct < 25, "very_low").when(pct < 50, "low").when(pct < 80, "medium").otherwise("covered")
    out = out.withColumns({"fill_pct": F.round(F.try_divide(F.col("franchisee") * 100, F.nullif(F.col("expected"), F.lit(0))), 1), "status": status})
    low = F.col("status").isin("very_low", "low")
    priority = (
        F.when(F.col("status") == "overfilled_review", "REVIEW_OVERFILL").when(F.col("status") == "no_franchisor_total", "P4_NEED_TOTAL").when((F.col("status") == "empty") & (F.col("expected") >= 100), "P0_FIND_OFFICIAL_LIST")
        .when((F.col("expected") >= 300) & low, "P0_EXPAND").when((F.col("expected") >= 50) & low, "P1_EXPAND").when(F.col("status") == "medium", "P2_EXPAND").otherwise("P3_MONITOR")
    )
    return out.withColumn("priority", priority)


def brand_index(links: DataFrame) -> DataFrame:
    out = links.groupBy("brand").agg(F.count("*").alias("rows"), F.count_if(nz("corporate_number") != "").alias("verified"), F.sum("estimated_store_count").alias("sum_count"), F.max("estimated_store_count").alias("max_count"), F.min_by("operator_name", F.struct((-F.col("estimated_store_count")).alias("c"), "operator_name")).alias("largest_operator"))
    return out.withColumn("basis", F.when(F.col("verified") == F.col("rows"), "all_verified").when(F.col("verified") > 0, "partly_verified").otherwise("unverified"))


def quality(total: Column, brands: Column, corp: Column) -> Column:
    return F.when((corp != "") & (total >= 20) & (brands >= 2), "A").when((corp != "") & (total >= 20), "B").when(corp != "", "C").otherwise("D")
