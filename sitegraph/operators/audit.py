"""Coverage, recall, accuracy and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz


def rate(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), places)


def coverage_by(stores: DataFrame, os: DataFrame, by: list[str]) -> DataFrame:
    """By brand or area: stores, stores with a known and with a verified operator, and the ratios."""
    franchise = os.where(~nz("operator_type").isin("franchisor", "direct")).groupBy("place_id").agg(F.lit(1).alias("known"), F.max(F.when(nz("corporate_number") != "", 1).otherwise(0)).alias("verified"))
    out = stores.join(franchise, "place_id", "left").groupBy(*by).agg(F.count_distinct("place_id").alias("stores"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    return out.withColumns({"known_ratio": rate(F.col("known"), F.col("stores")), "verified_ratio": rate(F.col("verified"), F.col("stores"))})


def dense_coverage(stores: DataFrame, os: DataFrame, areas: DataFrame, brands: list[str]) -> DataFrame:
    """The same for each area and brand there is, with zero rows; areas and brands are small dimensions."""
    grid = areas.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in brands])))
    got = coverage_by(stores, os, ["prefecture", "brand"])
    return grid.join(got, ["prefecture", "brand"], "left").na.fill(0)


def missing_areas(stores: DataFrame, areas: list[str]) -> DataFrame:
    every = F.array(*[F.lit(a) for a in sorted(areas)])
    return stores.groupBy("brand").agg(F.array_join(F.array_except(every, F.collect_set("prefecture")), " / ").alias("missing"))


def without_operator(stores: DataFrame, os: DataFrame, verified: bool = False) -> DataFrame:
    held = os.where(nz("operator_type") != "franchisor")
    if verified:
        held = held.where(nz("corporate_number") != "")
    return stores.join(held, "place_id", "left_anti")


def truth_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the truth, how many are found and how many not, and the recall."""
    t, f = truth.select(*keys).distinct(), found.select(*keys).distinct().withColumn("hit", F.lit(1))
    out = t.join(f, keys, "left").agg(F.count("*").alias("truth"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return out.withColumns({"misses": F.col("truth") - F.col("hits"), "recall": rate(F.col("hits"), F.col("truth"))})


def area_recall(found: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Found over reference by area, where the reference has any; may exceed 1."""
    return reference.where("n > 0").join(found.withColumnRenamed("n", "found"), key, "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("recall", F.round(F.col("found") / F.col("n"), 3))


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    ok = F.col(truth).eqNullSafe(F.col(guess))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("right"), F.round(F.coalesce(F.avg(F.when(ok, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("accuracy"))


def rule_issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each broken rule."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]], accepted: str = "accepted") -> DataFrame:
    """The first gate that a row fails, in order."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(reasons):
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn("reason", F.coalesce(out, F.lit(accepted)))


def pollution(os: DataFrame, brands: int) -> DataFrame:
    """Names without a corporate number that turn up under many brands."""
    return os.groupBy("operator_name").agg(F.max(nz("corporate_number")).alias("corp"), F.count_distinct("brand").alias("brands"), F.count("*").alias("rows")).where((F.col("corp") == "") & (F.col("brands") >= brands)).select("operator_name", "brands", "rows")


def purge(os: DataFrame, bad: DataFrame) -> DataFrame:
    return os.join(bad.select("operator_name"), "operator_name", "left_anti")


def truth_report(truth: DataFrame, found: DataFrame, keys: dict[str, list[str]], most: int = 20) -> DataFrame:
    """part, truth, hits, recall, misses for each named set of key columns: distinct keys of the truth, how many are found, and the first that are not, in order, at most a few for a report."""
    out = None
    for part, cols in keys.items():
        t, f = truth.select(*cols).distinct(), found.select(*cols).distinct().withColumn("hit", F.lit(1))
        name = F.concat_ws("/", *cols)
        rows = t.join(f, cols, "left").withColumn("name", name)
        missed = rows.where("hit is null").orderBy("name").limit(most).agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("misses"))
        one = rows.agg(F.count("*").alias("truth"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).crossJoin(F.broadcast(missed))  # a row each
        one = one.select(F.lit(part).alias("part"), "truth", "hits", rate(F.col("hits"), F.col("truth")).alias("recall"), "misses")
        out = one if out is None else out.unionByName(one)
    return out


def overall_recall(found: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """found, n and recall over all areas where the reference has any."""
    both = reference.where("n > 0").join(found.withColumnRenamed("n", "found"), key, "left")
    return both.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("recall", F.round(F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("n").cast("double")), F.lit(0.0)), 3))
