"""Stores against official lists, evidence and each other: matches, gaps, audits and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, company_core, nz, operators_match
from ..shared import small
from .matching import near_pairs

#: What a link about other things than a brand holds, and words of company forms in map tags.
REVIEW_HINTS = ("news", "topics", "ir/", "recruit", "career", "job", "jobdescription", "staff", "voice", "interview", "採用", "求人", "募集", "社員")
TAG_FORMS = ("株式会社", "有限会社", "合同会社", "Inc.", "Co., Ltd")
TAG_ORDER = ("operator:ja", "operator", "owner:ja", "owner")


def by_operator(os: DataFrame, operator: str, at: str) -> DataFrame:
    """Stores of an operator in the order in which they were confirmed."""
    return os.where(F.col("operator_name") == operator).orderBy(at, "place_id")


def best_place_of_url(stores: DataFrame, os: DataFrame, preferred: str) -> DataFrame:
    """official_url, place_id, links: of the stores of a URL the one with the most operators, then one with a preferred id, then the least."""
    n = os.groupBy("place_id").agg(F.count("operator_name").alias("links"))
    rows = stores.where(nz("official_url") != "").select("place_id", "official_url").join(n, "place_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    order = F.struct((-F.col("links")).alias("l"), (~F.startswith(F.col("place_id").cast("string"), F.lit(preferred))).alias("p"), "place_id")
    return rows.groupBy("official_url").agg(F.min_by("place_id", order).alias("place_id"), F.max("links").alias("links"))


def enrichment_candidates(stores: DataFrame, os: DataFrame, headquarters_only: bool = True, with_url: bool = True) -> DataFrame:
    """Stores whose operator is still to be found, those without a phone first.

    A store is done if a phone lookup found its operator, or a page did: one that runs a franchise,
    if headquarters_only, else any.
    """
    found = F.col("discovered_via").isin("per_store", "chain_verified")
    done = (F.col("discovered_via") == "enrich_phone_lookup") | (found & (F.col("operator_type") == "franchisee") if headquarters_only else found)
    rows = stores.join(os.where(done).select("place_id"), "place_id", "left_anti")
    rows = rows.where(nz("official_url") != "") if with_url else rows
    return rows.select("place_id", "name", "address", nz("phone").alias("phone"), nz("official_url").alias("official_url")).orderBy(F.desc(nz("phone") == ""), "place_id")


def verified_elsewhere(os: DataFrame) -> DataFrame:
    """place_id of stores with an operator that is no headquarters and has a corporate number."""
    return os.where((nz("operator_name") != "") & ~nz("operator_type").isin("franchisor", "direct") & (nz("corporate_number") != "")).select("place_id").distinct()


def page_research_targets(stores: DataFrame, os: DataFrame, brands: list[str]) -> DataFrame:
    """Stores of some brands with a URL and without a verified operator, by brand and id."""
    rows = stores.where(F.col("brand").isin(brands) & (nz("official_url") != ""))
    return rows.join(verified_elsewhere(os), "place_id", "left_anti").orderBy("brand", "place_id")


def not_official(stores: DataFrame, official: DataFrame) -> DataFrame:
    """place_id, reason of stores whose URL the official list (official_url) has not, and of those after the first of a URL that it has."""
    listed = official.select("official_url").distinct().withColumn("listed", F.lit(True))
    rows = stores.select("place_id", nz("official_url").alias("official_url")).join(listed, "official_url", "left")
    nth = F.row_number().over(Window.partitionBy("official_url").orderBy("place_id"))
    told = rows.where("listed").withColumn("nth", nth).where("nth > 1").select("place_id", F.lit("duplicate_official_url").alias("reason"))
    return rows.where("listed is null").select("place_id", F.lit("not_in_official_list").alias("reason")).unionByName(told)


def false_positives(stores: DataFrame, marks: list[str]) -> DataFrame:
    """Stores that show none of a brand's marks in name or URL, by id."""
    said = F.lower(F.concat_ws(" ", nz("name"), nz("official_url")))
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains(said, F.lit(m.lower()))
    return stores.where(~hit).orderBy("place_id")


def marked_masters(os: DataFrame, brand: str, names: list[str]) -> DataFrame:
    """os with the type franchisor for a brand's master franchisees."""
    return os.withColumn("operator_type", F.when((F.col("brand") == brand) & F.col("operator_name").isin(names), "franchisor").otherwise(F.col("operator_type")))


def remapped(os: DataFrame, mapping: DataFrame) -> DataFrame:
    """os and, for each store of mapping (old, new), copies of its rows at the new store, unless the operator is there already."""
    moved = os.join(mapping.where("old <> new").select(F.col("old").alias("place_id"), "new").distinct(), "place_id").withColumn("place_id", F.col("new")).drop("new")
    once = moved.withColumn("r", F.row_number().over(Window.partitionBy("operator_name", "place_id").orderBy(*[c for c in moved.columns if c not in ("operator_name", "place_id")]))).where("r = 1").drop("r")
    return os.unionByName(once.join(os.select("operator_name", "place_id"), ["operator_name", "place_id"], "left_anti"))


def official_matches(official: DataFrame, stores: DataFrame) -> DataFrame:
    """slug, place_id, how: the store of each official one (slug, url, address) by its slug in the URL, else by the URL or address; the least id of a way.

    The slug is a whole part of the URL's path.
    """
    parts = stores.select("place_id", "official_url", "address", F.explode(F.array_distinct(F.slice(F.split(nz("official_url"), "/"), 2, 1000))).alias("slug"))
    parts = parts.where((F.col("slug") != "") & F.contains("official_url", F.concat(F.lit("/"), "slug", F.lit("/"))))
    by_slug = official.select("slug").join(parts.select("slug", "place_id"), "slug").withColumn("how", F.lit(0))
    by_url = official.select("slug", F.col("url").alias("official_url")).join(stores.select("official_url", "place_id"), "official_url").select("slug", "place_id", F.lit(1).alias("how"))
    by_address = official.select("slug", "address").where(nz("address") != "").join(stores.select("address", "place_id"), "address").select("slug", "place_id", F.lit(1).alias("how"))
    hits = by_slug.select("slug", "place_id", "how").unionByName(by_url).unionByName(by_address)
    best = hits.groupBy("slug").agg(F.min(F.struct("how", "place_id")).alias("b"))
    return best.select("slug", "b.place_id", F.when(F.col("b.how") == 0, "slug").otherwise("url_or_address").alias("how"))


def matched_pages(pages: DataFrame, stores: DataFrame) -> DataFrame:
    """page_id, place_id, reason: the store whose core name equals, holds or lies in a page's (page_id, core, address); an address alike, blanks aside, tells several apart.

    stores: place_id, core, address. Cores meet in their first two characters somewhere in the other, so
    only pairs that share a run of two characters are compared; each core and each address of a core once.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    p = pages.select("page_id", nz("core").alias("pc"), F.regexp_replace(nz("address"), r"\s+", "").alias("pa"))
    s = stores.where(nz("core") != "").select("place_id", F.col("core").alias("sc"), F.regexp_replace(nz("address"), r"\s+", "").alias("sa"))
    held = s.distinct().groupBy("sc", "sa").agg(F.count("*").alias("n"), F.min("place_id").alias("one")).checkpoint()
    head = lambda c: F.substring(c, 1, 2)
    x, y = p.where("pc <> ''").select("pc").distinct(), held.select("sc").distinct()
    inside = x.select("*", F.explode(runs(F.col("pc"))).alias("g")).join(y.withColumn("g", head(F.col("sc"))), "g").where(F.contains("pc", F.col("sc")))
    around = x.withColumn("g", head(F.col("pc"))).join(y.select("*", F.explode(runs(F.col("sc"))).alias("g")), "g").where(F.contains("sc", F.col("pc")))
    cores = inside.unionByName(around.select(*inside.columns)).drop("g").distinct().checkpoint()
    named = cores.join(held.groupBy("sc").agg(F.sum("n").alias("n"), F.min("one").alias("one")), "sc").groupBy("pc").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    spots = p.where("pc <> '' and pa <> ''").select("pc", "pa").distinct()
    alike = F.contains("pa", F.col("sa")) | F.contains("sa", F.col("pa"))
    near = spots.join(cores, "pc").join(held.where("sa <> ''"), "sc").where(alike).groupBy("pc", "pa").agg(F.sum("n").alias("na"), F.min("one").alias("near"))
    out = p.withColumnRenamed("pc", "core").join(small(named.withColumnRenamed("pc", "core")), "core", "left").join(small(near.withColumnRenamed("pc", "core")), ["core", "pa"], "left")
    reason = F.when(F.col("core") == "", "store_core_missing").when(F.col("n").isNull(), "store_not_found").when(F.col("na") == 1, "").when(F.col("na") > 1, "store_address_ambiguous").when(F.col("n") == 1, "").otherwise("store_name_ambiguous")
    return out.withColumn("reason", reason).select("page_id", F.when(F.col("reason") == "", F.when(F.col("na") == 1, F.col("near")).otherwise(F.col("one"))).alias("place_id"), "reason")


def by_address_key(stores: DataFrame, candidates: DataFrame) -> DataFrame:
    """place_id, operator_name, once each, of stores and candidates (operator_name) of one address key (key); blank keys meet nothing."""
    return stores.where(nz("key") != "").select("place_id", "key").join(candidates.where(nz("key") != "").select("operator_name", "key").distinct(), "key").select("place_id", "operator_name").distinct()


def operators_of_found(searched: DataFrame, stores: DataFrame, os: DataFrame, area: Column) -> DataFrame:
    """operator_name, stores: how many stores that a search found, and that lie in an area, an operator has; most first."""
    here = stores.where(area).join(searched.select("place_id"), "place_id", "left_semi").select("place_id")
    return os.join(here, "place_id", "left_semi").groupBy("operator_name").agg(F.count_distinct("place_id").alias("stores")).orderBy(F.desc("stores"), "operator_name")


def operator_tag(tags: Column, brand_key: Column, blocked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, operator_name: the first tag of TAG_ORDER of rows that names a company, but neither the brand nor a blocked headquarters, by canonical key, match or first four characters of the core.

    blocked: name; a short list, broadcast.
    """
    held = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.trim(nz(F.element_at(tags, t))).alias("op")) for i, t in enumerate(TAG_ORDER)]), lambda x: (x["op"] != "") & x["op"].rlike("|".join(rf"\Q{f}\E" for f in TAG_FORMS)))
    each = rows.select(key, brand_key.alias("brand_key"), F.explode(held).alias("x")).select(key, "brand_key", "x.i", "x.op").withColumn("k", canonical_key("op"))
    each = each.where(~F.contains("k", F.col("brand_key")))
    core = lambda c: F.regexp_replace(c, "株式会社|有限会社|合同会社|・| ", "")
    bad = blocked.select(F.col("name").alias("b"), canonical_key("name").alias("bk"))
    kin = (F.length(core(F.col("k"))) >= 4) & (F.length(core(F.col("bk"))) >= 4) & (F.substring(core(F.col("k")), 1, 4) == F.substring(core(F.col("bk")), 1, 4))
    kept = each.join(F.broadcast(bad), (F.col("k") == F.col("bk")) | operators_match(F.col("op"), F.col("b")) | kin, "left_anti")
    return kept.groupBy(key).agg(F.min_by("op", "i").alias("operator_name"))


def new_map_stores(found: DataFrame, stores: DataFrame, metres: float = 120.0) -> DataFrame:
    """Rows of found (place_id, brand, lat, lng) that are new: no store bears the id, and none of the brand lies within the distance.

    Of new ones within the distance of each other those stay that no nearer-numbered one suppresses:
    in the order of place_id, each is compared to the stores and to what stays before it.
    """
    once = found.dropDuplicates(["place_id"]).join(stores.select("place_id"), "place_id", "left_anti")
    points = lambda t: t.select(F.col("place_id").alias("id"), "brand", "lat", "lng")
    near = near_pairs(points(once), points(stores), metres, flat=True, same=("brand",)).select(F.col("a_id").alias("place_id")).distinct()
    left = once.join(near, "place_id", "left_anti").checkpoint()
    pairs = near_pairs(points(left), points(left), metres, flat=True, same=("brand",)).where("a_id < b_id").select(F.col("a_id").alias("before"), F.col("b_id").alias("after")).checkpoint()
    kept = left.select("place_id").limit(0)
    open_ids = left.select("place_id")
    while open_ids.limit(1).count():  # the least of all is never suppressed, so each round settles one at least
        mine = pairs.join(open_ids.withColumnRenamed("place_id", "before"), "before").join(open_ids.withColumnRenamed("place_id", "after"), "after")
        sure = open_ids.join(mine.select(F.col("after").alias("place_id")), "place_id", "left_anti").checkpoint()
        gone = pairs.join(sure.withColumnRenamed("place_id", "before"), "before", "left_semi").select(F.col("after").alias("place_id"))
        kept = kept.unionByName(sure)
        open_ids = open_ids.join(sure, "place_id", "left_anti").join(gone, "place_id", "left_anti").checkpoint()
    return once.join(kept, "place_id", "left_semi")


def reviewed_brand_links(anchors: DataFrame, existing: DataFrame, allow_external: bool = False) -> DataFrame:
    """anchors (operator, site, page_url, brand, href, label) with status, once for a brand, target and page.

    Brands that the operator has are existing; links off the site are for review unless allowed, as
    are links about news, jobs or investors; the others are accepted.
    """
    site = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")
    bare = lambda c: F.regexp_replace(F.col(c), "#.*$", "")
    rows = anchors.withColumns({"href": bare("href"), "page_url": bare("page_url")})
    once = Window.partitionBy("operator", "brand", "href", "page_url").orderBy("label")
    rows = rows.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    rows = rows.join(existing.select("operator", "brand").distinct().withColumn("has", F.lit(True)), ["operator", "brand"], "left")
    outside = (F.col("href") != "") & ((site(F.col("site")) != site(F.col("href"))) | (site(F.col("site")) == ""))
    said = F.lower(F.concat_ws(" ", "label", "href", "page_url"))
    other = said.rlike("|".join(rf"\Q{h}\E" for h in REVIEW_HINTS))
    held_back = outside & F.lit(not allow_external)
    status = F.when(F.col("has"), "existing_link").when(held_back, "external_link_review").when(other, "review_link_not_auto_applied").otherwise("accepted")
    return rows.withColumn("status", status).drop("has")


def chain_summary(found: DataFrame, seq: str) -> DataFrame:
    """operator key, display name, type, stores and mean confidence of what chain discovery found; the most frequent name and type, of equally frequent ones the first seen."""
    rows = found.where(nz("operator_name") != "").withColumn("key", canonical_key("operator_name"))

    def mode(c: str) -> DataFrame:
        n = rows.groupBy("key", c).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
        return n.groupBy("key").agg(F.min_by(c, F.struct((-F.col("n")).alias("n"), "first")).alias(c))

    base = rows.groupBy("key").agg(F.count_distinct("place_id").alias("stores"), F.round(F.avg(F.col("confidence").cast("double")), 8).alias("mean_confidence"))
    return base.join(mode("operator_name"), "key").join(mode("operator_type"), "key")


def audit(registered: DataFrame, top: DataFrame, matched: DataFrame, bottom: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coverage by operator, stores that nobody claims, operators that a search does not find).

    registered: operator_name, registered; top: operator_name, top_id (what a search for it found);
    matched: top_id, bottom_id; bottom: place_id. coverage_pct is the matched share of the registered
    count, 0 where that is none.
    """
    mine = top.join(matched, "top_id", "left").groupBy("operator_name").agg(F.count_distinct("top_id").alias("found"), F.count_distinct("bottom_id").alias("matched"))
    rows = registered.join(mine, "operator_name", "left").na.fill(0, ["found", "matched"])
    pct = F.when(F.col("registered") > 0, F.round(F.col("matched") * 100.0 / F.col("registered"), 2)).otherwise(0.0)
    unknown = bottom.join(matched.select(F.col("bottom_id").alias("place_id")), "place_id", "left_anti")
    return rows.withColumn("coverage_pct", pct), unknown, rows.where("found = 0").select("operator_name")


def recruitment_ranking(candidates: DataFrame, accepted: DataFrame, headquarters: DataFrame) -> DataFrame:
    """Operators that recruitment pages name, by accepted and candidate stores, URLs, confidence and name, all falling.

    candidates: operator_name, brand, place_id, store_name, url, source_type, reject_reason,
    confidence; accepted: operator_name, brand, place_id, store_name, corporate_number, url;
    headquarters: name. Reasons are the five most frequent, samples the first six.
    """
    both = candidates.withColumn("accepted", F.lit(False)).unionByName(accepted.withColumn("accepted", F.lit(True)), allowMissingColumns=True).where(nz("operator_name") != "").withColumn("key", canonical_key("operator_name"))
    some = lambda c, when=None: F.array_sort(F.collect_set(F.when((nz(F.col(c).cast("string")) != "") & (F.lit(True) if when is None else when), F.col(c).cast("string"))))
    reasons = both.where(nz("reject_reason") != "").groupBy("key", "reject_reason").agg(F.count("*").alias("n")).groupBy("key").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reject_reason", "n"))), 1, 5), lambda x: F.concat_ws(":", x["reject_reason"], x["n"])), " / ").alias("reject_reasons"))
    out = both.groupBy("key").agg(
        F.min("operator_name").alias("operator_name"), F.size(some("brand")).alias("brand_count"), F.array_join(some("brand"), " / ").alias("brands"), F.size(some("place_id")).alias("candidate_stores"),
        F.size(some("url", ~F.col("accepted"))).alias("candidate_urls"), F.size(some("place_id", F.col("accepted"))).alias("accepted_stores"), F.array_join(some("corporate_number"), " / ").alias("corporate_numbers"),
        F.round(F.coalesce(F.max("confidence"), F.lit(0.0)), 2).alias("max_confidence"), F.count_if(F.startswith(nz("reject_reason"), F.lit("blocked_franchisor"))).alias("blocked_rows"), F.array_join(F.slice(some("store_name"), 1, 6), " / ").alias("sample_stores"),
    ).join(reasons, "key", "left").withColumn("reject_reasons", nz("reject_reasons"))
    known = headquarters.select(canonical_key("name").alias("key")).distinct().withColumn("hq", F.lit(True))
    out = out.join(known, "key", "left")
    status = F.when(F.coalesce("hq", F.lit(False)) | (F.col("blocked_rows") > 0), "franchisor_or_hq_candidate").when(F.contains("operator_name", F.lit("ホールディングス")), "parent_or_hq_candidate").when(F.col("accepted_stores") > 0, "verified").otherwise("candidate_unverified")
    order = [F.desc(c) for c in ("accepted_stores", "candidate_stores", "candidate_urls", "max_confidence", "operator_name")]
    return out.withColumn("status", status).drop("hq", "key").orderBy(*order)


def directory(links: DataFrame, registry: DataFrame, prefecture: str = "", present: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Operators by number, or by name where they have none: longest head office, first filled website and prefecture, brands with their greatest counts.

    links: operator_name, corporate_number, head_office, prefecture, website, brand, operator_type,
    estimated_store_count, seq. Headquarters and blocked names (name) are left out. Optional filters:
    the prefecture of the head office, and operators with stores in a place (present: operator_name, stores).
    """
    from ..functions.japan import resolve_prefecture

    rows = links.where(~nz("operator_type").isin("franchisor", "direct"))
    if blocked is not None:
        rows = rows.withColumn("k", canonical_key("operator_name")).join(blocked.select(canonical_key("name").alias("k")).distinct(), "k", "left_anti").drop("k")
    who = F.when(nz("corporate_number") != "", F.col("corporate_number")).otherwise(F.concat(F.lit("NAME::"), "operator_name"))
    rows = rows.withColumn("who", who)
    first = lambda c: F.coalesce(F.min_by(c, F.when(nz(c) != "", F.col("seq"))), F.lit("")).alias(c)
    longest = F.coalesce(F.min_by("head_office", F.struct((-F.length(nz("head_office"))).alias("n"), "seq")), F.lit("")).alias("head_office")
    info = rows.groupBy("who").agg(F.min_by("operator_name", "seq").alias("operator_name"), F.max(nz("corporate_number")).alias("corporate_number"), longest, first("website"), first("prefecture"))
    per = rows.groupBy("who", "brand").agg(F.max(F.coalesce("estimated_store_count", F.lit(0))).alias("n"))
    sums = per.groupBy("who").agg(F.count("*").alias("brand_count"), F.sum("n").alias("total_stores"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("brand", "n"))), lambda x: F.concat_ws(":", x["brand"], x["n"])), "; ").alias("brands"))
    r = registry.groupBy("corporate_number").agg(F.min("prefecture").alias("r_pref"))
    out = info.join(sums, "who").join(r, "corporate_number", "left")
    out = out.withColumn("prefecture", resolve_prefecture(F.col("head_office"), F.col("prefecture"), F.col("r_pref"), F.lit(""))).drop("r_pref", "who")
    if prefecture:
        out = out.where(F.col("prefecture") == prefecture)
    if present is not None:
        out = out.join(present.where("stores > 0").select("operator_name", "stores"), "operator_name")
    return out.orderBy(F.desc("brand_count"), F.desc("total_stores"), "operator_name")


def directory_components(links: DataFrame) -> DataFrame:
    """By operator and brand the greatest count, and the sources, URLs and notes that say so."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(nz(c) != "", F.col(c)))), " / ").alias(f"{c}s")
    return links.groupBy("operator_name", "brand").agg(F.max(F.coalesce("estimated_store_count", F.lit(0))).alias("stores"), joined("source"), joined("source_url"), joined("note"))


def scope_report(found: DataFrame, least: int = 20) -> DataFrame:
    """operator_name, verified, unverified, is_mega (on verified stores alone) of what research found (operator_name, place_id, verified)."""
    named = found.where(nz("operator_name") != "")
    out = named.groupBy("operator_name").agg(F.count_distinct(F.when(F.col("verified"), F.col("place_id"))).alias("verified"), F.count_distinct(F.when(~F.col("verified"), F.col("place_id"))).alias("unverified"))
    return out.withColumn("is_mega", F.col("verified") >= least)


def same_company(a: Column, b: Column) -> Column:
    """Core names alike."""
    return (company_core(a) != "") & (company_core(a) == company_core(b))


def research_stores(stores: DataFrame, brand: str, most: int = 0) -> DataFrame:
    """Stores of a brand with a URL, by name and id, at most a few if a number is given (the work that a person orders)."""
    rows = stores.where((F.col("brand") == brand) & (nz("official_url") != "")).orderBy("name", "place_id")
    return rows.limit(most) if most else rows


def bottom_up(stores: DataFrame, brand: str) -> DataFrame:
    """Stores of a brand, null address and URL as empty."""
    return stores.where(F.col("brand") == brand).select("place_id", "brand", "name", nz("address").alias("address"), "lat", "lng", nz("official_url").alias("official_url"))
