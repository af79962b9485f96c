"""Judgements of recorded models: legacy fields, critics and panels, verification, rules, and rates of agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nz, operators_match
from .audit import rate, rule_issues

#: How a store is run, and marks of a company form that names are not to bear.
OPERATION_TYPES = ("direct", "franchisee", "mixed", "unknown")
SHORT_FORMS = ("(株)", "㈱")


def derived(judged: DataFrame) -> DataFrame:
    """judged with operation_type, is_franchise, operator_name, franchisee_name and franchisor_name filled from each other.

    A type that is none of OPERATION_TYPES is unknown, and an unknown one follows is_franchise. A
    store is a franchise unless it is direct. The operator is the franchisee, else the franchisor;
    an operator without either is the one its type says.
    """
    kind = F.lower(nz("operation_type"))
    kind = F.when(kind.isin(*OPERATION_TYPES) & (kind != "unknown"), kind).when(F.coalesce("is_franchise", F.lit(False)), "franchisee").otherwise("direct")
    rows = judged.withColumns({"operation_type": kind, "given_operator": nz("operator_name"), "fee": nz("franchisee_name"), "sor": nz("franchisor_name")})
    named = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("given_operator", "fee", "sor")], F.lit(""))
    alone = (named != "") & (F.col("fee") == "") & (F.col("sor") == "")
    out = rows.withColumns({
        "is_franchise": F.col("operation_type") != "direct", "operator_name": named,
        "franchisee_name": F.when(alone & (F.col("operation_type") == "franchisee"), named).otherwise(F.col("fee")),
        "franchisor_name": F.when(alone & (F.col("operation_type") == "direct"), named).otherwise(F.col("sor")),
    })
    return out.drop("given_operator", "fee", "sor")


def panel(first: DataFrame, second: DataFrame, critic: DataFrame) -> DataFrame:
    """place_id, operation_type, franchisor_name, franchisee_name, confidence of two workers (these columns) after a critic (place_id, verdict, preferred_side, adjustment).

    The critic's side is taken with its confidence; without one the first worker's, with the lower
    confidence. The adjustment is added, within 0 and 1. If both are wrong nothing is known, and
    half the lower confidence counts, not below 0.
    """
    a, b = ([F.col(c).alias(f"{n}_{c}") for c in ("operation_type", "franchisor_name", "franchisee_name", "confidence")] for n in "ab")
    rows = first.select("place_id", *a).join(second.select("place_id", *b), "place_id").join(critic, "place_id")
    wrong, low, shift = nz("verdict") == "both_wrong", F.least("a_confidence", "b_confidence"), F.coalesce("adjustment", F.lit(0.0))
    left = (nz("verdict") == "prefer_a") | (nz("preferred_side") == "a")
    right = ~left & ((nz("verdict") == "prefer_b") | (nz("preferred_side") == "b"))
    pick = lambda c, none: F.when(wrong, none).when(right, nz(f"b_{c}")).otherwise(nz(f"a_{c}"))
    base = F.when(left, F.col("a_confidence")).when(right, F.col("b_confidence")).otherwise(low)
    sure = F.when(wrong, F.greatest(F.lit(0.0), low * 0.5 + shift)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + shift)))
    return rows.select("place_id", pick("operation_type", "unknown").alias("operation_type"), pick("franchisor_name", "").alias("franchisor_name"), pick("franchisee_name", "").alias("franchisee_name"), F.round(sure, 6).alias("confidence"))


def compared(primary: DataFrame, critic: DataFrame) -> DataFrame:
    """place_id, operator_agreement, type_agreement, operation_type, franchisor_name, franchisee_name, confidence of two readings.

    Names agree if both are blank or mean one company. Where all agrees, the lower confidence
    counts; else nothing is known, with half of it.
    """
    cols = ("operation_type", "franchisor_name", "franchisee_name", "confidence")
    rows = primary.select("place_id", *[F.col(c).alias(f"p_{c}") for c in cols]).join(critic.select("place_id", *[F.col(c).alias(f"c_{c}") for c in cols]), "place_id")

    def same(c: str) -> Column:
        p, q = nz(f"p_{c}"), nz(f"c_{c}")
        return ((p == "") & (q == "")) | operators_match(p, q)

    operator, kind = same("franchisor_name") & same("franchisee_name"), F.col("p_operation_type").eqNullSafe(F.col("c_operation_type"))
    both = operator & kind
    agreed = lambda c: F.when(both, F.coalesce(F.nullif(nz(f"p_{c}"), F.lit("")), nz(f"c_{c}"))).otherwise("")
    low = F.least("p_confidence", "c_confidence")
    return rows.select(
        "place_id", operator.alias("operator_agreement"), kind.alias("type_agreement"), F.when(both, F.col("p_operation_type")).otherwise("unknown").alias("operation_type"),
        agreed("franchisor_name").alias("franchisor_name"), agreed("franchisee_name").alias("franchisee_name"), F.round(F.when(both, low).otherwise(low * 0.5), 6).alias("confidence"),
    )


def agreement(reports: DataFrame) -> DataFrame:
    """n and the shares of reports that agree on the operator, on the type, and on both; shares of none are null."""
    part = lambda c: F.round(F.avg(c.cast("double")), 6)
    return reports.agg(F.count("*").alias("n"), part(F.col("operator_agreement")).alias("operator_agreement"), part(F.col("type_agreement")).alias("type_agreement"), part(F.col("operator_agreement") & F.col("type_agreement")).alias("full_agreement"))


def cross_verified(expected: DataFrame, primary: DataFrame, others: DataFrame) -> DataFrame:
    """place_id, confirmed, boost, reason of expected operators (place_id, expected) against the primary page's operator and other pages' (place_id, observed; others with seq).

    The primary page adds .1, another one .05. A primary page that names someone else is a mismatch if no other page confirms.
    """
    first = primary.where(nz("observed") != "").groupBy("place_id").agg(F.min("observed").alias("seen"))
    rows = expected.join(first, "place_id", "left")
    alt = others.where(nz("observed") != "").join(expected, "place_id").where(operators_match(F.col("observed"), F.col("expected"))).select("place_id").distinct().withColumn("alt", F.lit(True))
    rows = rows.join(alt, "place_id", "left")
    main = operators_match(nz("seen"), nz("expected"))
    reason = F.when(nz("expected") == "", "no_expected_operator").when(main, "primary_match").when(F.coalesce("alt", F.lit(False)), "alt_match").when(F.col("seen").isNotNull(), "mismatch").otherwise("no_evidence")
    told = rows.withColumn("reason", reason)
    return told.select("place_id", F.col("reason").isin("primary_match", "alt_match").alias("confirmed"), F.when(F.col("reason") == "primary_match", 0.1).when(F.col("reason") == "alt_match", 0.05).otherwise(0.0).alias("boost"), "reason")


def first_existing(names: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """name, source, corporate_number of the first source, in order, that has the name (name, corporate_number); source is empty where none has."""
    known = None
    for n, (label, t) in enumerate(sources.items()):
        one = t.select("name", F.struct(F.lit(n).alias("rank"), F.lit(label).alias("source"), F.col("corporate_number").alias("number")).alias("x"))
        known = one if known is None else known.unionByName(one)
    best = known.groupBy("name").agg(F.min("x").alias("x"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("x.source", F.lit("")).alias("source"), F.coalesce("x.number", F.lit("")).alias("corporate_number"))


def merged_profile(profiles: DataFrame, key: str, order: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """key, each field from the first source of its list that fills it, and confidence, the share of fields that are filled.

    profiles has key, source and the fields. Fields without a list of their own take the sources of order[""].
    """
    picked = []
    for f in fields:
        ranked = F.lit(None).cast("int")
        for n, s in enumerate(order.get(f, order[""])):
            ranked = F.when((F.col("source") == s) & (nz(F.col(f).cast("string")) != ""), n).otherwise(ranked)
        picked.append(F.coalesce(F.min_by(F.col(f).cast("string"), F.when(ranked.isNotNull(), F.struct(ranked.alias("r"), F.col(f).cast("string").alias("v")))), F.lit("")).alias(f))
    out = profiles.groupBy(key).agg(*picked)
    filled = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return out.withColumn("confidence", F.round(filled / float(len(fields)), 4))


def claims_checked(claims: DataFrame, sources: list[str], refused: list[str], unresolved: Column | None = None) -> DataFrame:
    """claims with confidence, rejected, review and violations (array) after the rules for what a judge has claimed, in order.

    claims has source_url, source_text, corporate_name, count_source, confidence. A claim without a
    URL, or with a text of none or over 50 characters, loses its confidence and is rejected, as are
    claims without a company or from a source that is not listed; a URL that can't be resolved goes
    to review; a phrase of refusal halves the confidence; counts of map clusters keep .8 of it and
    go to review. A reason stays once it is set, so later rules that hold repeat the last one.
    """
    url, text, corp, src = nz("source_url"), nz("source_text"), nz("corporate_name"), nz("count_source")
    said = F.concat(url, corp, text)
    phrase = F.lit(False)
    for w in refused:
        phrase = phrase | F.contains(said, F.lit(w))
    no_url, bad_text, no_corp = url.isin("", "null"), (F.length(text) == 0) | (F.length(text) > 50), corp == ""
    lost = F.coalesce(unresolved, F.lit(False)) & (url != "") if unresolved is not None else F.lit(False)
    gmaps, unknown = src == "gmaps_cluster", (src != "") & ~src.isin(*sources)
    rules = [("source_url_empty", no_url, F.lit("source_url_empty")), ("source_text_invalid", bad_text, F.lit("source_text_invalid")), ("corporate_name_missing", no_corp, F.lit("corporate_name_missing")), ("source_url_resolves", lost, F.lit("url_unresolvable")), ("refuse_phrases_present", phrase, F.lit("refuse_phrase_found")), ("gmaps_requires_l3", gmaps, None), ("unknown_source_rejected", unknown, F.concat(F.lit('unknown_source: "'), src, F.lit('" not in source_priority')))]
    reason, broken = F.lit(""), []
    for name, holds, why in rules:
        if why is not None:
            reason = F.when(holds, why).otherwise(reason)
        broken.append(F.when(holds & (reason != ""), F.concat(F.lit(f"{name}: "), reason)))
    sure = F.when(no_url | bad_text, 0.0).otherwise(F.col("confidence").cast("double")) * F.when(phrase, 0.5).otherwise(1.0) * F.when(gmaps, 0.8).otherwise(1.0)
    return claims.withColumns({"rejected": no_url | bad_text | no_corp | unknown, "review": lost | gmaps, "violations": F.filter(F.array(*broken), lambda x: x.isNotNull()), "confidence": F.round(sure, 6)})


def golden_issues(rows: DataFrame, key: str) -> DataFrame:
    """key, rule: a row for each rule that a row of a golden table breaks (operation_type, franchisor_name, franchisee_name, is_franchise, brand, name, official_url).

    A place that occurs twice is an issue of each of its rows but the first by name.
    """
    kind, sor, fee, url = nz("operation_type"), nz("franchisor_name"), nz("franchisee_name"), nz("official_url")
    short = F.lit(False)
    for m in SHORT_FORMS:
        short = short | F.contains(sor, F.lit(m)) | F.contains(fee, F.lit(m))
    again = F.row_number().over(Window.partitionBy(key).orderBy("name", "official_url")) > 1
    rules = {
        "duplicate_place_id": F.col("again"), "place_id_empty": nz(F.col(key).cast("string")) == "", "operation_type_empty": kind == "", "operation_type_invalid": (kind != "") & ~kind.isin(*OPERATION_TYPES),
        "franchisee_with_direct": (kind == "direct") & (fee != ""), "franchisor_missing": kind.isin("franchisee", "mixed") & (sor == ""), "is_franchise_mismatch": (kind != "") & (F.coalesce("is_franchise", F.lit(False)) != (kind != "direct")),
        "company_name_style": short, "brand_empty": nz("brand") == "", "name_empty": nz("name") == "", "url_scheme": (url != "") & ~F.startswith(url, F.lit("http")),
    }
    return rule_issues(rows.withColumn("again", again), key, rules)


def classification_accuracy(rows: DataFrame) -> DataFrame:
    """n, right, accuracy: the type has to be right, and for franchises the operator too (truth_type, guess_type, truth_operator, guess_operator); 0 for none."""
    ok = F.col("truth_type").eqNullSafe(F.col("guess_type")) & ((F.col("truth_type") != "franchisee") | (nz("truth_operator") == nz("guess_operator")))
    ok = F.coalesce(ok, F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("right")).withColumn("accuracy", rate(F.col("right"), F.col("n")))


def recall_rate(found: Column, actual: Column) -> Column:
    """found over actual, which may exceed 1; 1 if there is nothing to find."""
    return F.when(actual <= 0, 1.0).otherwise(found / actual)


def retry_delay(attempt: Column, base: float, factor: float, most: float) -> Column:
    """Seconds before an attempt (from 0), without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))
