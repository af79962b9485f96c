"""The master table of operators: buckets, totals, classes, wide rows, and what is written into the registry of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, join_values, nz, structural_garbage
from .components import components
from .ranks import positioned

#: Tiers of quality with their weight, and what a link's source is worth.
QUALITY = {"A_houjin_verified": 40, "B_manual_unverified": 30, "C_candidate_unverified": 20, "D_pipeline_only_unverified_review": 10}
SOURCE_WORTH = {"jfa_disclosure": 80, "official_franchisee_page": 75, "operator_official_brand_link": 70, "manual_megajii_2026_04_24": 60, "pipeline": 50, "jfa": 40}
#: Least totals of the priority segments.
SEGMENTS = ((100, "P0_100plus"), (50, "P1_50plus"), (20, "P2_20plus"), (10, "P3_10plus"), (2, "P4_2plus"))
PRIORITY_ORDER = ("P0_FIND_OFFICIAL_LIST", "P0_EXPAND", "P1_EXPAND", "P2_EXPAND", "REVIEW_OVERFILL", "P3_MONITOR", "P4_NEED_TOTAL")
#: Columns of a brand in the master table, and the evidence columns that they join.
SETS = {"rank": "priority_rank", "tier": "priority_tier", "quality": "quality_tier", "evidence": "evidence_status", "risk": "risk_flag", "sources": "source", "source_urls": "source_url", "sample_stores": "sample_store", "sample_urls": "sample_url", "notes": "note"}
_lookup = lambda table, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c), F.lit(other))


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (operator_name, corporate_number, ...) with bucket: names of one canonical key, and all that share a corporate number, are one operator.

    A bucket is named by its least corporate number, or by its least name key if it has none.
    Groups are connected whatever the order of the rows. Rows without a name go.
    """
    keyed = rows.where(nz("operator_name") != "").withColumn("name_key", F.concat(F.lit("NAME::"), canonical_key("operator_name")))
    number = F.concat(F.lit("CORP::"), F.nullif(F.trim(nz("corporate_number")), F.lit("")))
    pairs = keyed.select(F.col("name_key").alias("node"), F.explode(F.array(F.col("name_key"), number)).alias("key"))
    groups = components(pairs)
    corp = keyed.select("name_key", number.alias("number")).where("number is not null").join(groups.withColumnRenamed("node", "name_key"), "name_key").groupBy("comp").agg(F.min("number").alias("number"))
    names = groups.join(corp, "comp", "left").select(F.col("node").alias("name_key"), F.coalesce("number", "comp").alias("bucket"))
    return keyed.join(names, "name_key").drop("name_key")


def brand_counts(evidence: DataFrame) -> DataFrame:
    """bucket, brand, n: the greatest of the counts given and of the distinct stores of the pipeline and of recruitment pages; zeros don't count."""
    stores = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("store_id")))
    per = evidence.where(nz("brand") != "").groupBy("bucket", "brand").agg(F.greatest(F.coalesce(F.max("store_count"), F.lit(0)), stores("pipeline"), stores("recruitment")).cast("long").alias("n"))
    return per.where("n > 0")


def totals(evidence: DataFrame) -> DataFrame:
    """bucket, total_stores, brand_count: the greatest of the totals reported, the sum by brand, and the distinct stores of either source; buckets with any evidence appear."""
    stores = lambda kind, c: F.count_distinct(F.when(F.col("kind") == kind, F.col(c)))
    base = evidence.groupBy("bucket").agg(F.coalesce(F.max("reported_total"), F.lit(0)).alias("t"), F.coalesce(F.max("reported_brands"), F.lit(0)).alias("b"), stores("pipeline", "store_id").alias("ps"), stores("recruitment", "store_id").alias("rs"), stores("pipeline", "brand").alias("pb"), stores("recruitment", "brand").alias("rb"))
    sums = brand_counts(evidence).groupBy("bucket").agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    both = base.join(sums, "bucket", "left")
    zero = F.lit(0)
    return both.select("bucket", F.greatest("t", F.coalesce("s", zero), "ps", "rs").cast("long").alias("total_stores"), F.greatest("b", F.coalesce("k", zero), "pb", "rb").cast("long").alias("brand_count"))


def quality(numbers: Column, tiers: Column, accepted: Column, urls: Column, stores: Column) -> Column:
    """The best tier: a corporate number, else the best tier given, else accepted stores, candidate URLs, or pipeline stores."""
    weigh = lambda t: _lookup(QUALITY, t, 0)
    best = F.array_sort(F.transform(F.filter(tiers, lambda t: nz(t) != ""), lambda t: F.struct((-weigh(t)).alias("w"), t.alias("t"))))
    return F.when(numbers, "A_houjin_verified").when(F.size(best) > 0, F.get(best, 0)["t"]).when(accepted, "A_houjin_verified").when(urls, "C_candidate_unverified").when(stores, "D_pipeline_only_unverified_review").otherwise("unknown")


def segment(total: Column) -> Column:
    out = F.lit("PX_single_or_unknown")
    for least, name in reversed(SEGMENTS):
        out = F.when(total >= least, name).otherwise(out)
    return out


def risk(franchisor: Column, flags: Column, best: Column, numbers: Column) -> Column:
    return F.when(franchisor, "franchisor_or_direct_review").when(flags, "review_required").when(best == "D_pipeline_only_unverified_review", "pipeline_review").when(~numbers, "unverified_review").otherwise("verified")


def master_rows(evidence: DataFrame, brands: list[str], least: int = 2) -> DataFrame:
    """A row for each operator bucket of the least total, with rank, segment, quality, risk, URLs and eleven columns for each brand.

    evidence: bucket, operator_name, corporate_number, brand, kind (link, pipeline, recruitment),
    store_id, store_count, reported_total, reported_brands, operator_kind, accepted, url and the
    columns of SETS; all but bucket, name and kind may be null. The display name is the most
    frequent, of equally frequent ones the least. Ranks: total, brands, quality, name.
    """
    filled = lambda c: F.array_sort(F.collect_set(F.when(nz(c) != "", F.col(c))))
    names = evidence.groupBy("bucket", "operator_name").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.min_by("operator_name", F.struct((-F.col("n")).alias("o"), "operator_name")).alias("operator_name"))
    facts = evidence.groupBy("bucket").agg(
        filled("corporate_number").alias("numbers"), filled("quality_tier").alias("tiers"), filled("risk_flag").alias("flags"), filled("operator_kind").alias("kinds"), F.max(F.coalesce("accepted", F.lit(False))).alias("accepted"),
        F.max((F.col("kind") == "recruitment") & (nz("url") != "")).alias("urls"), F.max((F.col("kind") == "pipeline") & F.col("store_id").isNotNull()).alias("stores"),
        F.array_sort(F.array_distinct(F.flatten(F.array(F.collect_set(F.when(nz("url") != "", F.col("url"))), F.collect_set(F.when(nz("source_url") != "", F.col("source_url"))), F.collect_set(F.when(nz("sample_url") != "", F.col("sample_url"))))))).alias("all_urls"),
    )
    has = F.size("numbers") > 0
    out = totals(evidence).where(F.col("total_stores") >= least).join(names, "bucket").join(facts, "bucket")
    out = out.withColumn("quality_best_tier", quality(has, F.col("tiers"), F.col("accepted"), F.col("urls"), F.col("stores")))
    hq = F.array_contains("kinds", "franchisor") | F.array_contains("flags", "franchisor_or_direct_link")
    out = out.select(
        "bucket", "operator_name", "total_stores", "brand_count", "quality_best_tier", segment(F.col("total_stores")).alias("priority_segment"), risk(hq, F.size("flags") > 0, F.col("quality_best_tier"), has).alias("risk_level"),
        F.coalesce(F.get("numbers", 0), F.lit("")).alias("primary_corporate_number"), F.array_join("numbers", " / ").alias("corporate_numbers"), F.array_join("flags", " / ").alias("risk_flags_all"), F.size("all_urls").alias("all_evidence_url_count"), F.array_join("all_urls", " / ").alias("all_evidence_urls"),
    )
    counts = brand_counts(evidence)
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "brand", "n"))), lambda x: F.concat_ws(":", x["brand"], x["n"]))
    out = out.join(counts.groupBy("bucket").agg(F.array_join(parts, ";").alias("brands_breakdown")), "bucket", "left").withColumn("brands_breakdown", nz("brands_breakdown"))
    token = lambda b: b.replace("#", "_").replace(" ", "_").lower()
    by_brand = evidence.where(F.col("brand").isin(brands)).groupBy("bucket").pivot("brand", brands).agg(*[join_values(F.collect_set(c)).alias(f"{name}") for name, c in SETS.items()])
    by_brand = by_brand.select("bucket", *[F.col(f"`{b}_{name}`").alias(f"{name}_{token(b)}") for b in brands for name in SETS])
    stores = counts.where(F.col("brand").isin(brands)).groupBy("bucket").pivot("brand", brands).agg(F.max("n"))
    stores = stores.select("bucket", *[F.col(f"`{b}`").alias(f"stores_{token(b)}") for b in brands])
    wide = out.join(by_brand, "bucket", "left").join(stores, "bucket", "left")
    wide = wide.select(*out.columns, *[c for b in brands for c in (F.coalesce(F.col(f"stores_{token(b)}"), F.lit(0)).alias(f"stores_{token(b)}"), *(nz(f"{name}_{token(b)}").alias(f"{name}_{token(b)}") for name in SETS))])
    order = [F.desc("total_stores"), F.desc("brand_count"), F.desc(_lookup(QUALITY, F.col("quality_best_tier"), 0)), F.asc("operator_name"), F.asc("bucket")]
    return positioned(wide, order, "company_priority_rank")


def excluded_rows(evidence: DataFrame, least: int = 2) -> DataFrame:
    """Buckets below the least total, with the reason."""
    return totals(evidence).where(F.col("total_stores") < least).withColumn("exclude_reason", F.lit(f"operator_total_stores_est_below_{least}"))


# -- links ---------------------------------------------------------------------------------------


def weak_link(source: Column, kind: Column, url: Column, note: Column) -> Column:
    """An unknown operator that chain discovery alone brought, without a URL."""
    return (nz(source) == "pipeline") & (nz(kind) == "unknown") & (nz(url) == "") & (F.contains(nz(note), F.lit("chain_discovery")) | F.contains(nz(note), F.lit("chain_verified")))


def best_links(links: DataFrame, seq: str) -> DataFrame:
    """One row for each brand and name without blanks: of strong links the one with a count, the greatest count, the worthiest source, a number, a head office, a URL, the last note; of equal ones the first."""
    n = F.coalesce("estimated_store_count", F.lit(0))
    score = [n > 0, n, _lookup(SOURCE_WORTH, F.col("source"), 0), nz("corporate_number") != "", nz("head_office") != "", nz("source_url") != "", nz("note")]
    keyed = links.where(~weak_link(F.col("source"), F.col("operator_type"), F.col("source_url"), F.col("note"))).withColumn("name_key", F.regexp_replace(nz("operator_name"), r"[\s　]+", ""))
    order = Window.partitionBy("brand", "name_key").orderBy(*[s.desc() for s in score], seq)
    return keyed.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def overridden(links: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """links with the fields of overrides (brand, operator_name, fields, note) put over theirs; a note is appended. overrides: a few rows by hand."""
    patch = overrides.select("brand", "operator_name", *[F.col(f).alias(f"new_{f}") for f in [*fields, "note"]])
    rows = links.join(F.broadcast(patch), ["brand", "operator_name"], "left")
    note = F.when(nz("new_note") == "", nz("note")).when(nz("note") == "", F.col("new_note")).otherwise(F.concat("note", F.lit("; "), "new_note"))
    return rows.withColumns({**{f: F.coalesce(f"new_{f}", f) for f in fields}, "note": note}).drop(*[f"new_{f}" for f in [*fields, "note"]])


def garbage_links(links: DataFrame) -> DataFrame:
    """link_id of pipeline links to delete: names that no company has, and rows without a number where another row of the canonical name has one."""
    rows = links.where("source = 'pipeline'").withColumn("key", canonical_key("operator_name"))
    numbered = F.max(nz("corporate_number") != "").over(Window.partitionBy("key"))
    told = rows.withColumn("numbered", numbered & (F.col("key") != ""))
    return told.where(structural_garbage("operator_name") | ((nz("corporate_number") == "") & F.col("numbered"))).select("link_id")


def merged_source_rows(rows: DataFrame, seq: str) -> DataFrame:
    """Rows alike in brand, number (or name), URL, parser and type as one: the greatest count, all store names in their order, blanks filled by the first row that has them."""
    key = F.coalesce(F.nullif(nz("corporate_number"), F.lit("")), F.col("operator_name"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(nz(c) != "", F.col(seq))), F.lit("")).alias(c)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(seq, "store_names"))), lambda x: x["store_names"])
    return rows.withColumn("who", key).groupBy("brand", "who", "source_url", "parser", "operator_type").agg(F.min_by("operator_name", seq).alias("operator_name"), first("corporate_number"), first("head_office"), first("prefecture"), F.max(F.coalesce("estimated_store_count", F.lit(0))).alias("estimated_store_count"), F.array_distinct(F.flatten(in_order)).alias("store_names")).drop("who")


def link_of_source_rows(rows: DataFrame, source: str) -> DataFrame:
    """Links as they are written for source rows: counts not below 0, and a note of the parts that there are."""
    filled = lambda c: F.nullif(nz(c), F.lit(""))
    stores = F.when(F.size("store_names") > 0, F.concat(F.lit("stores="), F.array_join("store_names", ";")))
    where = F.concat(F.lit("address="), filled("store_address"))
    note = F.concat_ws("; ", filled("note"), filled("verification_status"), stores, where)
    return rows.where(nz("operator_name") != "").select("brand", "operator_name", nz("corporate_number").alias("corporate_number"), F.greatest(F.coalesce("estimated_store_count", F.lit(0)), F.lit(0)).alias("estimated_store_count"), "operator_type", F.lit(source).alias("source"), "source_url", note.alias("note"))


def overwritten(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], seq: str) -> DataFrame:
    """old with the last filled value of each field from new, by key, in order of seq; new keys are added. Blank, null and zero count as not filled."""
    full = lambda c: F.when(nz(F.col(c).cast("string")).isin("", "0", "false"), None).otherwise(F.col(c))
    last = new.groupBy(*keys).agg(*[F.max_by(c, F.when(full(c).isNotNull(), F.col(seq))).alias(f"new_{c}") for c in fields])
    both = old.join(last, keys, "full")
    return both.select(*keys, *[F.coalesce(full(f"new_{c}"), F.col(c)).alias(c) for c in fields])


def upsert_operators(old: DataFrame, new: DataFrame, fields: list[str], seq: str) -> DataFrame:
    """Operators (name, corporate_number, fields) after new rows: by number, else by name among those without a number, else added.

    A row with a number that no operator bears takes over the operator of its name without one. New
    rows are merged among themselves first, by number, or by name where they have none.
    """
    rows = new.withColumn("corporate_number", nz("corporate_number"))
    numbered = rows.where("corporate_number <> ''").groupBy("corporate_number").agg(F.max_by("name", seq).alias("name"), *[F.max_by(c, F.when(nz(c) != "", F.col(seq))).alias(c) for c in fields])
    plain = rows.where("corporate_number = ''").groupBy("name").agg(*[F.max_by(c, F.when(nz(c) != "", F.col(seq))).alias(c) for c in fields])
    base = old.withColumn("corporate_number", nz("corporate_number"))
    known, blank = base.where("corporate_number <> ''"), base.where("corporate_number = ''")
    filled = lambda n, o: [F.coalesce(F.nullif(nz(F.col(f"{n}.{c}")), F.lit("")), F.col(f"{o}.{c}"), F.lit("")).alias(c) for c in fields]
    met = known.alias("o").join(numbered.alias("n"), F.col("o.corporate_number") == F.col("n.corporate_number"), "left").select(F.coalesce("n.name", "o.name").alias("name"), F.col("o.corporate_number").alias("corporate_number"), *filled("n", "o"))
    rest = numbered.join(known.select("corporate_number"), "corporate_number", "left_anti")
    owner = rest.groupBy("name").agg(F.min("corporate_number").alias("owner"))  # one of a name takes the unnumbered operator over
    rest = rest.join(owner, "name").withColumn("taker", F.col("corporate_number") == F.col("owner"))
    added = rest.alias("n").join(blank.alias("o"), F.col("n.taker") & (F.col("n.name") == F.col("o.name")), "left").select(F.col("n.name").alias("name"), F.col("n.corporate_number").alias("corporate_number"), *filled("n", "o"))
    free = blank.join(owner.select("name"), "name", "left_anti")
    both = free.alias("o").join(plain.alias("n"), F.col("o.name") == F.col("n.name"), "full").select(F.coalesce("o.name", "n.name").alias("name"), F.lit("").alias("corporate_number"), *filled("n", "o"))
    return met.unionByName(added).unionByName(both)


def bridged(judged: DataFrame) -> DataFrame:
    """Rows for the table of operators and stores from judgements: franchisees by their own name, direct stores by the brand's, with a name."""
    kind = F.coalesce(F.nullif(nz("operation_type"), F.lit("")), F.when(F.coalesce("is_franchise", F.lit(False)), "franchisee").otherwise("direct"))
    name = F.when(kind == "franchisee", F.coalesce(F.nullif(nz("franchisee_name"), F.lit("")), F.col("operator_name"))).when(kind == "direct", F.coalesce(F.nullif(nz("franchisor_name"), F.lit("")), F.col("operator_name")))
    return judged.select(name.alias("operator_name"), "place_id", kind.alias("operator_type"), "confidence").where(F.col("operator_type").isin("franchisee", "direct") & (nz("operator_name") != ""))


def fill_order(rows: DataFrame) -> DataFrame:
    """Fill rates by priority, the greatest expectation, the least rate (none last), and brand."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITY_ORDER]), F.col("priority")), F.lit(0)), F.lit(10))
    return positioned(rows, [F.asc(rank), F.desc("expected"), F.asc(F.coalesce("fill_pct", F.lit(9999.0))), F.asc("brand")], "position")


def appended_brands(seeds: DataFrame, links: DataFrame, key: Column) -> DataFrame:
    """seeds (brand) and the brands of links with a franchisee whose key (a Column over brand) no seed has, one brand for a key."""
    mine = seeds.select("brand", key.alias("k"), F.lit(False).alias("from_links"))
    more = links.where("operator_type = 'franchisee'").select("brand", key.alias("k")).groupBy("k").agg(F.min("brand").alias("brand")).where(nz("k") != "").join(mine.select("k"), "k", "left_anti")
    return mine.unionByName(more.select("brand", "k", F.lit(True).alias("from_links"))).drop("k")


def brand_summary(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """For each seed brand: rows, franchisees, franchisors, verified franchisees, the greatest count and a status."""
    kind = lambda k: F.count_if(F.col("operator_type") == k)
    per = links.groupBy("brand").agg(F.count("*").alias("rows"), kind("franchisee").alias("franchisees"), kind("franchisor").alias("franchisors"), F.count_if((F.col("operator_type") == "franchisee") & (nz("corporate_number") != "")).alias("verified"), F.max("estimated_store_count").alias("max_count"))
    out = seeds.select("brand").distinct().join(per, "brand", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("rows") == 0, "seed_only").when(F.col("franchisees") == 0, "franchisor_only").when(F.col("verified") == 0, "unverified").otherwise("evidenced"))


def count_basis(links: DataFrame, repeated_source: str) -> DataFrame:
    """links with scope_brands and count_basis: a count of the manual source that an operator repeats over several brands is its total, not a brand's."""
    who = F.coalesce(F.nullif(nz("corporate_number"), F.lit("")), F.lower("operator_name"))
    rows = links.withColumn("who", who)
    brands = F.size(F.collect_set(F.when(nz("brand") != "", F.col("brand"))).over(Window.partitionBy("who")))
    same = F.count("*").over(Window.partitionBy("who", "estimated_store_count"))
    rows = rows.withColumns({"scope_brands": brands, "same": same})
    manual = F.col("source") == repeated_source
    basis = F.when(manual & (F.col("scope_brands") > 1) & (F.col("same") > 1), "operator_total_repeated_not_brand_specific").when(manual, "operator_declared_total_single_brand_or_unverified_basis").otherwise("source_estimated_or_store_matched_count")
    return rows.withColumn("count_basis", basis).drop("who", "same")
