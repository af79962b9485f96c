"""Looking companies up in the corporate registry: tiers, context, scores and verified rows.

A registry has corporate_number, name, normalized_name, process, prefecture, city, street, and update_date where said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.japan import compact
from ..functions.text import COMPANY_FORMS, canonical_key, core_key, may_run_stores, name_similarity, nz, operator_name
from ..shared import small

#: Processes of companies that exist.
ACTIVE = ("01", "11", "12", "13", "21", "22", "31")
TIERS = ("exact", "normalized", "prefix", "normalized_prefix", "substring")


def active(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("process").isin(*ACTIVE))


def address(registry_city: str = "city") -> Column:
    return F.concat(nz("prefecture"), nz(registry_city), nz("street"))


def _starting(names: DataFrame, registry: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Pairs whose registry column begins with the name's column, as equi-joins on beginnings of the lengths that names have."""
    lengths = sorted(r[0] for r in names.select(F.length(mine)).distinct().collect() if r[0])  # no more than the longest name has characters
    heads = registry.select("corporate_number", F.col(theirs).alias("whole"), F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where(F.length("whole") >= F.col("n"))
    return names.join(heads.select("corporate_number", F.expr("substring(whole, 1, n)").alias(mine)), mine).select("name", "corporate_number")


def _containing(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs whose registry name holds the name anywhere: both meet in the name's rarest run of two characters, then are compared."""
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    grams = registry.select("corporate_number", F.col("name").alias("whole"), F.explode(runs(F.col("name"))).alias("g"))
    seen = grams.groupBy("g").agg(F.count("*").alias("seen"))
    mine = names.where(F.length("name") >= 2).select("name", F.explode(runs(F.col("name"))).alias("g")).join(seen, "g", "left")
    rarest = mine.groupBy("name").agg(F.min_by("g", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "g")).alias("g"))
    found = rarest.join(grams, "g").where(F.contains("whole", F.col("name"))).select("name", "corporate_number")
    single = names.where(F.length("name") == 1)
    chars = registry.select("corporate_number", F.explode(F.array_distinct(F.split("name", ""))).alias("name")).where("name <> ''")
    return found.unionByName(single.select("name").join(chars, "name").select("name", "corporate_number")).distinct()


def cascade(names: DataFrame, registry: DataFrame, tiers: tuple[str, ...] = TIERS, keep_all: bool = False) -> DataFrame:
    """name, corporate_number, tier (from 1) of the first tier of each name with a hit among existing companies.

    A tier is tried for those names alone that the tiers before it leave. The least number of a tier
    stands, or with keep_all every one. Tiers: the name itself, its normalised form, a name that
    begins with it, a normalised name that begins with its form, a name that holds it. Blank names find nothing.
    """
    rows = active(registry).checkpoint()
    left = names.select(F.trim("name").alias("name")).where(nz("name") != "").distinct().withColumn("key", canonical_key("name")).checkpoint()
    found = None
    for n, tier in enumerate(tiers, 1):
        if tier == "exact":
            hits = left.join(rows.select("name", "corporate_number"), "name").select("name", "corporate_number")
        elif tier == "normalized":
            hits = left.where("key <> ''").join(rows.select(F.col("normalized_name").alias("key"), "corporate_number"), "key").select("name", "corporate_number")
        elif tier == "prefix":
            hits = _starting(left, rows, "name", "name")
        elif tier == "normalized_prefix":
            hits = _starting(left.where("key <> ''"), rows, "key", "normalized_name")
        else:
            hits = _containing(left.select("name"), rows)
        hits = hits.distinct() if keep_all else hits.groupBy("name").agg(F.min("corporate_number").alias("corporate_number"))
        hits = hits.withColumn("tier", F.lit(n)).checkpoint()
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("name").distinct(), "name", "left_anti").checkpoint()
    return found


def exact_verified(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, registry_name, corporate_number of the company with that name or its canonical form; an existing one before one that is not, then the least number."""
    keyed = names.select("name").distinct().withColumn("key", canonical_key("name"))
    r = registry.select(F.col("name").alias("registry_name"), F.col("normalized_name").alias("key"), "corporate_number", F.col("process").isin(*ACTIVE).alias("alive"))
    hits = keyed.join(r, "key").withColumn("other", (F.col("registry_name") != F.col("name")).cast("int"))
    order = F.struct((~F.col("alive")).alias("closed"), "other", "corporate_number")
    return hits.where("key <> ''").groupBy("name").agg(F.min_by("registry_name", order).alias("registry_name"), F.min_by("corporate_number", order).alias("corporate_number"))


def franchisor_record(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, corporate_number, tier, alive: the first tier's company of the exact name, else its least number; companies that no longer exist only where no other is found."""
    alive = cascade(names, registry, keep_all=True).withColumn("alive", F.lit(True))
    rest = names.join(alive.select("name").distinct(), "name", "left_anti")
    closed = cascade(rest, registry.withColumn("process", F.lit(ACTIVE[0])), keep_all=True).withColumn("alive", F.lit(False))
    hits = alive.unionByName(closed).join(registry.select("corporate_number", F.col("name").alias("registry_name")), "corporate_number")
    order = F.struct((F.col("registry_name") != F.col("name")).alias("other"), "corporate_number")
    return hits.groupBy("name").agg(F.min_by("corporate_number", order).alias("corporate_number"), F.min("tier").alias("tier"), F.max("alive").alias("alive"))


def variants(name: Column) -> Column:
    """The display name, and with the form before and behind it if it has none."""
    base = operator_name(name)
    formed = base.rlike("^(?:" + "|".join(COMPANY_FORMS) + ")|(?:" + "|".join(COMPANY_FORMS) + ")$")
    return F.when(base == "", F.array().cast("array<string>")).when(formed, F.array(base)).otherwise(F.array(base, F.concat(F.lit("株式会社"), base), F.concat(base, F.lit("株式会社"))))


def hydration_candidates(names: DataFrame, registry: DataFrame) -> DataFrame:
    """name, and each existing company once whose normalised name is that of a variant."""
    keyed = names.select("name", F.explode(variants(F.col("name"))).alias("variant")).withColumn("key", F.lower("variant"))
    r = active(registry).select(F.col("normalized_name").alias("key"), "corporate_number", F.col("name").alias("registry_name"), "prefecture", "city", "street")
    return keyed.join(r, "key").select("name", "corporate_number", "registry_name", "prefecture", "city", "street").dropDuplicates(["name", "corporate_number"])


def prefecture_preferred(names: DataFrame, registry: DataFrame, most: int = 6) -> DataFrame:
    """name and its candidates, those of its prefecture alone if there are any, by number, at most a few (a shortlist for review)."""
    got = hydration_candidates(names, registry).join(names.select("name", F.col("prefecture").alias("wanted")), "name")
    same = F.max((F.col("wanted") != "") & (F.col("prefecture") == F.col("wanted"))).over(Window.partitionBy("name"))
    kept = got.withColumn("any", same).where(~F.col("any") | (F.col("prefecture") == F.col("wanted")))
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("corporate_number"))).where(F.col("r") <= most).select("name", "corporate_number", "prefecture")


def address_score(prefecture: Column, head_office: Column, r_prefecture: Column, r_city: Column, r_street: Column) -> Column:
    """50 for the prefecture, 20 for the city, 30 for the street of a company in what is known of a head office."""
    hq, city, street = compact(head_office), compact(r_city), compact(r_street)
    whole = compact(F.concat(nz(r_prefecture), nz(r_city), nz(r_street)))
    held = hq != ""
    return (
        F.when((nz(prefecture) != "") & (prefecture == r_prefecture), 50).otherwise(0) + F.when(held & (city != "") & F.contains(hq, city), 20).otherwise(0)
        + F.when(held & (street != "") & (F.contains(hq, street) | F.contains(whole, hq)), 30).otherwise(0)
    )


def best_context(contexts: DataFrame, key: str) -> DataFrame:
    """One context (prefecture, head_office) a key: with a prefecture, then with a head office, then the longest, then the least."""
    order = F.struct((nz("prefecture") != "").alias("p"), (nz("head_office") != "").alias("h"), F.length(nz("head_office")).alias("n"), nz("head_office").alias("o"), nz("prefecture").alias("q"))
    return contexts.groupBy(key).agg(F.max_by("prefecture", order).alias("prefecture"), F.max_by("head_office", order).alias("head_office"))


def selected_matches(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """name, status, corporate_number (null if none is taken), reason from candidates (hydration_candidates) and contexts (name, prefecture, head_office).

    One candidate stands unless the context's prefecture differs; of several the best address score
    stands if it is 50 or more and nobody shares it.
    """
    ctx = best_context(contexts, "name").withColumnsRenamed({"prefecture": "c_pref", "head_office": "c_hq"})
    scored = candidates.join(ctx, "name", "left").withColumn("score", address_score(nz("c_pref"), nz("c_hq"), F.col("prefecture"), F.col("city"), F.col("street")))
    name = Window.partitionBy("name")
    ranked = scored.withColumns({"n": F.count("*").over(name), "top": F.max("score").over(name), "r": F.row_number().over(name.orderBy(F.desc("score"), "corporate_number"))})
    ranked = ranked.withColumn("tied", F.sum(F.when(F.col("score") == F.col("top"), 1).otherwise(0)).over(name)).where("r = 1")
    differs = (nz("c_pref") != "") & (F.col("c_pref") != F.col("prefecture"))
    told = ranked.withColumn("status", F.when((F.col("n") == 1) & differs, "prefecture_mismatch").when(F.col("n") == 1, "accepted_unique").when((F.col("top") >= 50) & (F.col("tied") == 1), "accepted_disambiguated").otherwise("ambiguous"))
    reason = (
        F.when(F.col("status") == "prefecture_mismatch", "single_name_hit_but_hq_prefecture_differs").when(F.col("status") == "accepted_unique", "single_normalized_name_hit")
        .when((F.col("status") == "accepted_disambiguated") & (F.col("top") >= 80), "matched_hq_address").when(F.col("status") == "accepted_disambiguated", "matched_hq_prefecture").otherwise("multiple_normalized_name_hits")
    )
    return told.select("name", "status", F.when(F.startswith("status", F.lit("accepted")), F.col("corporate_number")).alias("corporate_number"), reason.alias("reason"))


def verified_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (id, operator_name, corporate_number, prefecture, city of context) with corporate_number, registry_name and status.

    A given number is looked up; else the one company of the first tier with a hit (without
    substrings), existing ones first; else of several the one in the context's prefecture and city.
    """
    given = rows.where(nz("corporate_number") != "").join(registry.select("corporate_number", F.col("name").alias("registry_name")), "corporate_number", "left")
    given = given.select("id", "operator_name", "corporate_number", "registry_name", F.when(F.col("registry_name").isNull(), "houjin_corp_number_missing").otherwise("houjin_corp_number").alias("status"))
    blank = rows.where(nz("corporate_number") == "")
    names = blank.select(F.trim("operator_name").alias("name")).distinct()
    alive = cascade(names, registry, TIERS[:4], keep_all=True).withColumn("fallback", F.lit(""))
    rest = names.join(alive.select("name").distinct(), "name", "left_anti")
    closed = cascade(rest, registry.withColumn("process", F.lit(ACTIVE[0])), TIERS[:4], keep_all=True).withColumn("fallback", F.lit("_inactive_fallback"))
    hits = alive.unionByName(closed).join(registry.select("corporate_number", F.col("name").alias("registry_name"), F.col("prefecture").alias("r_pref"), F.col("city").alias("r_city")).dropDuplicates(["corporate_number"]), "corporate_number").withColumnRenamed("corporate_number", "number")
    met = blank.drop("corporate_number").join(hits, F.trim("operator_name") == F.col("name"), "left")
    one = Window.partitionBy("id")
    in_pref = (nz("prefecture") != "") & (F.col("r_pref") == F.col("prefecture"))
    in_city = in_pref & (nz("city") != "") & F.startswith(nz("r_city"), F.col("city"))
    met = met.withColumns({"p": in_pref, "c": in_city}).withColumns({"n": F.count("number").over(one), "np": F.count_if("p").over(one), "nc": F.count_if("c").over(one)})
    kept = F.when(F.col("nc") > 0, F.col("c")).when(F.col("np") > 0, F.col("p")).when((nz("prefecture") != "") & (nz("city") != ""), False).otherwise(True)
    told = met.groupBy("id", "operator_name").agg(
        F.max("n").alias("n"), F.count_if(kept & F.col("number").isNotNull()).alias("left"), F.min("number").alias("only"), F.min(F.when(kept, F.col("number"))).alias("chosen"),
        F.min("registry_name").alias("only_name"), F.min(F.when(kept, F.col("registry_name"))).alias("chosen_name"), F.max("fallback").alias("fallback"),
    )
    single, context = F.col("n") == 1, (F.col("n") > 1) & (F.col("left") == 1)
    status = F.when(F.col("n") == 0, "houjin_no_match").when(single, F.concat(F.lit("houjin_unique_name"), "fallback")).when(context, F.concat(F.lit("houjin_context_match"), "fallback")).otherwise("houjin_ambiguous")
    found = told.select("id", "operator_name", F.when(single, F.col("only")).when(context, F.col("chosen")).otherwise("").alias("corporate_number"), F.when(single, F.col("only_name")).when(context, F.col("chosen_name")).alias("registry_name"), status.alias("status"))
    return given.unionByName(found)


def seed_resolved(seeds: DataFrame, operators: DataFrame, registry: DataFrame) -> DataFrame:
    """name, corporate_number, note: of the known operators by name in lower case, blanks aside, with a number first; else of the registry if its canonical name has one number."""
    loose = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    order = F.struct((nz("corporate_number") == "").alias("blank"), "corporate_number")
    known = operators.select(loose("name").alias("k"), "corporate_number").groupBy("k").agg(F.min_by("corporate_number", order).alias("corporate_number"), F.count("*").alias("n"))
    mine = seeds.select("name").distinct().withColumn("k", loose("name")).join(known, "k", "left").withColumn("key", canonical_key("name"))
    r = registry.groupBy(F.col("normalized_name").alias("key")).agg(F.count_distinct("corporate_number").alias("numbers"), F.min("corporate_number").alias("number"))
    both = mine.join(r, "key", "left")
    note = F.when(F.col("n") == 1, "operator_company_match").when(F.col("n") > 1, "operator_company_multiple").when(F.col("numbers") == 1, "houjin_exact").when(F.col("numbers") > 1, "houjin_ambiguous").otherwise("")
    return both.select("name", F.when(F.col("n") >= 1, nz("corporate_number")).when(F.col("numbers") == 1, F.col("number")).otherwise("").alias("corporate_number"), note.alias("note"))


def by_location(stores: DataFrame, registry: DataFrame) -> DataFrame:
    """place_id, n, corporate_number, reason: companies that may run stores in a store's prefecture and city and in the street its town begins; a single one is chosen.

    stores has place_id and parts (place_parts of the address). Stores without a prefecture or city don't appear.
    Companies are counted once for each beginning of a street where a store is, not for each store.
    """
    at = ("pref", "city", "town")
    s = stores.select("place_id", "parts.*").where("pref <> '' and city <> ''")
    r = active(registry).where(may_run_stores("name")).select("corporate_number", F.col("prefecture").alias("pref"), "city", nz("street").alias("street"))
    streets = r.groupBy("pref", "city", "street").agg(F.count("*").alias("n"), F.min("corporate_number").alias("number"))
    heads = streets.withColumn("town", F.explode(F.transform(F.sequence(F.lit(0), F.length("street")), lambda k: F.substring(F.col("street"), F.lit(1), k))))
    told = small(heads.join(s.select(*at).distinct(), list(at), "left_semi").groupBy(*at).agg(F.sum("n").alias("n"), F.min("number").alias("number")))
    out = s.join(told, list(at), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") == 1, "single_match").when(F.col("n") > 1, F.concat(F.lit("multi_match("), F.col("n").cast("string"), F.lit(")"))).otherwise("no_match")
    return out.select("place_id", "n", F.when(F.col("n") == 1, F.col("number")).otherwise("").alias("corporate_number"), reason.alias("reason"))


#: Forms that run no chain, words of a headquarters, and what follows a brand in the names of others.
NO_CHAINS = ("財団法人", "社団法人", "組合", "連合会", "協議会", "独立行政法人", "国立大学", "公立大学")
HEADQUARTERS_WORDS = ("ホールディングス", "コーポレーション", "グループ", "ジャパン", "インターナショナル")
OTHER_TRADES = ("デザイン", "不動産", "土地", "エンター", "サービス", "物流", "建設")


def franchisor_score(brand: Column, name: Column) -> Column:
    """How much a company's name looks like the headquarters of a brand."""
    held = F.contains(name, brand)
    after = F.when(held, F.substring(name, F.call_function("instr", name, brand) + F.length(brand), F.length(name))).otherwise("")
    hq = name.rlike("|".join(HEADQUARTERS_WORDS))
    part = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        part(held, 10) + part(hq, 5) + part(name.rlike("^(?:株式会社|有限会社)"), 1) + part(name == F.concat(F.lit("株式会社"), brand), 20)
        + part(after.rlike("|".join(OTHER_TRADES)), -15) + part(after.rlike("[市町区店支局]") & ~hq & ~F.endswith(name, F.lit("コーポレーション")), -15)
    )
    return F.when(name.rlike("|".join(NO_CHAINS)), -1000).otherwise(score)


def guessed_franchisor(candidates: DataFrame, brand: str, name: str, least: int = 15) -> DataFrame:
    """brand, name, score of the candidate with the highest score, then the shortest name, then the least, if the score is enough."""
    scored = candidates.withColumn("score", franchisor_score(F.col(brand), F.col(name)))
    order = F.struct((-F.col("score")).alias("s"), F.length(name).alias("n"), name)
    return scored.groupBy(brand).agg(F.min_by(name, order).alias(name), F.max("score").alias("score")).where(F.col("score") >= least)


def shortest_or_exact(candidates: DataFrame, wanted: str, name: str) -> DataFrame:
    """The candidate of the exact name, else the shortest, then the least."""
    order = F.struct((F.col(name) != F.col(wanted)).alias("other"), F.length(name).alias("n"), name)
    return candidates.groupBy(wanted).agg(F.min_by(name, order).alias(name))


def bonus(same_name: Column, same_prefecture: Column) -> Column:
    """3 for the exact name and 1 for the prefecture."""
    return F.when(same_name, 3.0).otherwise(0.0) + F.when(same_prefecture, 1.0).otherwise(0.0)


def adjusted_score(base: Column, extra: Column) -> Column:
    """Similarity plus a tenth of the bonus, 1 at most."""
    return F.least(base + extra * 0.1, F.lit(1.0))


def match_level(extra: Column) -> Column:
    return F.when(extra >= 3.0, "exact").when(extra >= 1.0, "partial").otherwise("ambiguous")


def resolved(candidates: DataFrame, key: str, gap: float = 0.1) -> DataFrame:
    """key, corporate_number, level of each key whose candidates resolve: (key, query, name, corporate_number, score, prefecture, city, hint_prefecture, hint_city).

    The least number in the hinted prefecture and city, else the highest adjusted score unless the second is nearer than the gap.
    """
    extra = bonus(F.col("name") == F.col("query"), F.col("prefecture").eqNullSafe(F.col("hint_prefecture")))
    rows = candidates.withColumns({"extra": extra, "points": F.round(adjusted_score(F.col("score"), extra), 9), "here": (F.col("prefecture") == F.col("hint_prefecture")) & (F.col("city") == F.col("hint_city"))})
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("here", F.lit(False))), F.desc(F.when(F.coalesce("here", F.lit(False)), 0.0).otherwise(F.col("points"))), "corporate_number")
    ranked = rows.withColumns({"r": F.row_number().over(order), "next": F.lead("points").over(order)})
    clear = F.coalesce("here", F.lit(False)) | F.col("next").isNull() | (F.round(F.col("points") - F.col("next"), 9) >= gap)
    return ranked.where((F.col("r") == 1) & clear).select(key, "corporate_number", match_level(F.col("extra")).alias("level"))


def best_verify(candidates: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, corporate_number, score of the existing company whose core name is most like the key's, of equal ones the first."""
    scored = active(candidates).withColumn("score", F.round(name_similarity(core_key(key), core_key("name")), 4))
    order = F.struct((-F.col("score")).alias("s"), seq)
    return scored.groupBy(key).agg(F.min_by("corporate_number", order).alias("corporate_number"), F.max("score").alias("score"))


def phone_operators(stores: DataFrame, lookups: list[DataFrame]) -> DataFrame:
    """place_id, operator_name, source of the first lookup table (phone, operator_name), in order, that knows a store's phone."""
    digits = lambda c: F.regexp_replace(nz(c), r"\D", "")
    rows = stores.select("place_id", digits("phone").alias("p")).where("p <> ''")
    known = None
    for n, t in enumerate(lookups):
        one = t.where(nz("operator_name") != "").select(digits("phone").alias("p"), "operator_name", F.lit(n).alias("source"))
        known = one if known is None else known.unionByName(one)
    best = known.groupBy("p").agg(F.min(F.struct("source", "operator_name")).alias("b"))
    return rows.join(best, "p").select("place_id", "b.operator_name", "b.source")
