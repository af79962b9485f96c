"""The registered queries of the domain, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import audit, evidence, matching, views, writes
from ..shared import shared_base
from ..streaming import events as streams
from . import domain
from .domain import DOMAIN_SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TARGETS = ["Brand#11", "Brand#22", "Brand#3", "Brand#4"]


def query(sql: str | None = None, plain: bool = False, recursive: bool = False):
    """Register a query under its name; sql goes on from the domain tables unless it is plain."""

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared_base(spark)
            return f(spark, sf_dir)

        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql if plain else (DOMAIN_SQL.replace("with arrivals", "with recursive arrivals", 1) if recursive else DOMAIN_SQL) + sql
        return run

    return put


def _os(s: SparkSession, d: str) -> DataFrame:
    return writes.merge_operator_stores(domain.arrivals(s, d))


def _links(s: SparkSession, d: str) -> DataFrame:
    return writes.links_of(domain.arrivals(s, d))


_NAMED = "from operator_stores where coalesce(operator_name, '') <> '' and coalesce(operator_type, '') <> 'franchisor'"
_LIST = "string_agg(distinct {0}, ',' order by {0})"
_VIEW = f"select operator_name, count(distinct place_id) as store_count, round(avg(confidence::double), 8) as avg_confidence, {_LIST.format('brand')} as brands, {_LIST.format('discovered_via')} as discovered_via_methods, min(operator_type) as operator_type"


@query(f"{_VIEW} {_NAMED} group by operator_name having count(distinct place_id) >= 20")
def mega_operators(s, d):
    return views.at_least(views.mega_franchisees(_os(s, d)))


@query(f"{_VIEW} {_NAMED} group by operator_name")
def view_mega_franchisees(s, d):
    return views.mega_franchisees(_os(s, d))


@query(f"select operator_name, count(distinct place_id) as found_at_store_count, {_LIST.format('brand')} as brands from operator_stores where operator_type = 'franchisor' group by operator_name")
def view_franchisors(s, d):
    return views.franchisors(_os(s, d))


@query(f"{_VIEW}, max(verification_score) as best_verification_score, max(corporate_number) as corporate_number, case when count(distinct place_id) >= 20 then 'mega' when count(distinct place_id) >= 5 then 'medium' else 'small' end as size_class {_NAMED} group by operator_name")
def view_all_franchisees(s, d):
    return views.all_franchisees(_os(s, d))


def _multi(total: str) -> str:
    return f""", p as (select operator_name, brand, count(distinct place_id) as n, min(place_id) as place_id, max(discovered_via) as via, max(corporate_number) as corp, min(operator_type) as type {_NAMED} group by all),
t as (select operator_name, count(distinct place_id) as t {_NAMED} group by all)
select operator_name, {total} as total_stores, count(*) as brand_count, concat('{{', string_agg(concat('"', brand, '":', n), ',' order by brand), '}}') as brand_counts_json, {_LIST.format('via')} as discovered_via_methods, max(corp) as corporate_number, min(type) as operator_type from p join t using (operator_name) group by operator_name"""


@query(_multi("any_value(t)"))
def view_multi_brand(s, d):
    return views.multi_brand(_os(s, d))


@query(_multi("count(distinct place_id)"))
def view_multi_brand_strict(s, d):
    return views.multi_brand(_os(s, d), strict=True)


@query("select coalesce(nullif(franchisee_name, ''), operator_name) as operator_name, count(*) as store_count, round(avg(confidence::double), 8) as avg_confidence from judgements where (operation_type = 'franchisee' or (operation_type is null and is_franchise = 1)) and coalesce(nullif(franchisee_name, ''), operator_name, '') <> '' group by 1")
def view_legacy_mega(s, d):
    return views.legacy_mega(domain.judgements(s, d))


@query("select operator_name, sum(estimated_store_count)::bigint as total_stores, count(distinct brand) as brand_count, sum(estimated_store_count) >= 20 as is_mega from links group by 1")
def operator_totals(s, d):
    return views.operator_totals(_links(s, d))


@query("select brand, operator_type, count(*) as n, count(distinct operator_name) as operators from operator_stores group by all")
def counts_by_key(s, d):
    return _os(s, d).groupBy("brand", "operator_type").agg(F.count("*").alias("n"), F.count_distinct("operator_name").alias("operators"))


@query("select operator_name, brand, count(distinct place_id) as n, max(corporate_number) as corporate_number, min(operator_type) as operator_type from operator_stores where operator_name not in (select operator_name from operator_stores group by 1 having count_if(operator_type = 'franchisor') >= 6) group by all having count(distinct place_id) >= 3")
def brand_groups_unblocked(s, d):
    os = _os(s, d)
    blocked = os.groupBy("operator_name").agg(F.count_if(F.col("operator_type") == "franchisor").alias("n")).where("n >= 6").select("operator_name")
    return views.brand_groups(os, 3, blocked)


@query("select operator_name, count(distinct place_id) as n from operator_stores where operator_type = 'unknown' and operator_name not in (select name from registry where process = '71') group by 1 having count(distinct place_id) >= 10")
def unknown_operator_groups(s, d):
    closed = domain.registry(s, d).where("process = '71'").select(F.col("name").alias("operator_name"))
    return views.unknown_operators(_os(s, d), closed, 10)


@query(""", p as (select case when corporate_number <> '' then concat('corp:', corporate_number) else concat('name:', lower(regexp_replace(operator_name, '\\s+', '', 'g'))) end as key, brand, sum(estimated_store_count)::bigint as n, max(operator_name) as name from links group by all)
select key, max(name) as operator_name, sum(n)::bigint as total_stores, count(*) as brand_count, string_agg(concat(brand, ':', n), '; ' order by -n, brand) as brands_breakdown from p group by key having sum(n) >= 40 and count(*) >= 3""")
def cross_brand_operators(s, d):
    return views.cross_brand(_links(s, d), 40, 3)


@query(""", n as (select operator_name, brand, count(*) as n, min(place_id * 10 + seq) as f from arrivals group by all)
select operator_name, arg_max(brand, (n, -f, brand)) as brand, max(n) as n from n group by 1""")
def typical_brand(s, d):
    return views.typical(domain.arrivals(s, d).withColumn("at", F.col("place_id") * 10 + F.col("seq")), "operator_name", "brand", "at")


def _ranking(extra: str = "") -> str:
    c = f"operator_type not in ('franchisor', 'direct') and estimated_store_count > 0 {extra}"
    return f"select operator_name, sum(estimated_store_count)::bigint as total_stores, count(distinct case when {c} then brand end) as counted_brands, coalesce(string_agg(distinct brand, ' / ' order by brand) filter (where {c}), '') as brands from links group by 1 having sum(estimated_store_count) >= 20 and count(distinct case when {c} then brand end) >= 2"


@query(_ranking())
def strict_mega_ranking(s, d):
    return views.strict_ranking(_links(s, d))


@query(_ranking("and brand in ('Brand#11', 'Brand#22', 'Brand#3', 'Brand#4')"))
def strict_mega_ranking_targets(s, d):
    return views.strict_ranking(_links(s, d), TARGETS)


@query("select operator_name, sum(estimated_store_count)::bigint as total_stores, count(distinct brand) as broad_brands, count(distinct case when operator_type not in ('franchisor', 'direct') then brand end) as counted_brands from links where brand in ('Brand#11', 'Brand#22', 'Brand#3', 'Brand#4') group by 1 having sum(estimated_store_count) >= 3 and count(distinct brand) >= 2 and count(distinct case when operator_type not in ('franchisor', 'direct') then brand end) < 2")
def evidence_only_review(s, d):
    return views.evidence_only(_links(s, d).where(F.col("brand").isin(TARGETS)), min_total=3)


@query(""", t as (select operator_name, max(corporate_number) as corporate_number, sum(estimated_store_count)::bigint as total_stores, count(distinct brand) as brand_count from links group by 1)
select *, case when corporate_number <> '' and total_stores >= 20 and brand_count >= 2 then 'A' when corporate_number <> '' and total_stores >= 20 then 'B' when corporate_number <> '' then 'C' else 'D' end as quality from t""")
def quality_classes(s, d):
    t = _links(s, d).groupBy("operator_name").agg(F.max("corporate_number").alias("corporate_number"), F.sum("estimated_store_count").alias("total_stores"), F.count_distinct("brand").alias("brand_count"))
    return t.withColumn("quality", views.quality(F.col("total_stores"), F.col("brand_count"), F.col("corporate_number")))


@query("select name as brand, min(operator_hint) as operator_name, count(distinct operator_hint) as n from stores group by 1 having count(distinct operator_hint) <= 2")
def near_singleton_brands(s, d):
    """Brands of two operators at most; a store's name stands for a brand, as there are few stores of a name."""
    rows = domain.stores(s, d).select(F.col("name").alias("brand"), F.col("operator_hint").alias("operator_name")).distinct()
    return rows.groupBy("brand").agg(F.min("operator_name").alias("operator_name"), F.count("*").alias("n")).where("n <= 2")


@query("select operator_name, estimated_store_count, count(*) as brands from links where source = 'official' group by all having count(*) > 1")
def repeated_totals(s, d):
    return _links(s, d).where("source = 'official'").groupBy("operator_name", "estimated_store_count").agg(F.count("*").alias("brands")).where("brands > 1")


# -- writes ------------------------------------------------------------------------------------


@query("select * from operator_stores")
def upsert_operator_stores(s, d):
    return _os(s, d)


@query("select operator_hint, official_url, place_id, name from stores qualify row_number() over (partition by official_url order by place_id desc) = 1")
def upsert_last_wins(s, d):
    return writes.last_wins(domain.stores(s, d).select("operator_hint", "official_url", "place_id", "name"), ["official_url"], ["place_id"])


@query("select place_id, phone, name from stores qualify row_number() over (partition by phone order by place_id) = 1 or phone = ''")
def dedupe_keep_first(s, d):
    return writes.first_wins(domain.stores(s, d).select("place_id", "phone", "name"), ["phone"], ["place_id"], blank_passes=True)


@query(", o as (select phone, place_id from stores where prefecture = 'NATION_3' and phone <> '' qualify row_number() over (partition by phone order by place_id) = 1), n as (select phone, place_id from stores where prefecture <> 'NATION_3' and phone <> '' qualify row_number() over (partition by phone order by place_id) = 1) select * from o union all select * from n where phone not in (select phone from o)")
def insert_or_ignore(s, d):
    rows = domain.stores(s, d).where("phone <> ''").select("phone", "place_id", "prefecture")
    old = writes.first_wins(rows.where("prefecture = 'NATION_3'").drop("prefecture"), ["phone"], ["place_id"])
    return writes.insert_or_ignore(old, rows.where("prefecture <> 'NATION_3'").drop("prefecture"), ["phone"], ["place_id"])


@query("select operator_name, brand, concat_ws(':', 'REG', corporate_number, brand, i) as place_id, 0.95::double as confidence from (select *, unnest(range(1, greatest(estimated_store_count, 1) + 1)) as i from links where corporate_number <> '')")
def registry_seed_rows(s, d):
    return writes.seed_rows(_links(s, d))


@query(", f as (select prefecture, concat('00-', min(place_id)) as phone from stores group by 1) select s.place_id, coalesce(nullif(s.phone, ''), f.phone, '') as phone from stores s left join f using (prefecture)")
def fill_missing_phone(s, d):
    st = domain.stores(s, d)
    new = st.groupBy("prefecture").agg(F.concat(F.lit("00-"), F.min("place_id").cast("string")).alias("phone"))
    return writes.fill_blank(st.select("place_id", "phone", "prefecture"), new, "prefecture", "phone").select("place_id", "phone")


@query(", m as (select distinct operator_name as old, concat('M', (substr(operator_name, 10)::int % 7)) as new from links where corporate_number = '') select brand, coalesce(m.new, operator_name) as operator_name, max(estimated_store_count) as estimated_store_count from links left join m on m.old = operator_name group by 1, 2")
def remap_links(s, d):
    links = _links(s, d)
    mapping = links.where("corporate_number = ''").select(F.col("operator_name").alias("old"), F.concat(F.lit("M"), (F.expr("cast(substr(operator_name, 10) as int)") % 7).cast("string")).alias("new")).distinct()
    return writes.remap(links.select("brand", "operator_name", "estimated_store_count"), mapping, "operator_name")


# -- joins -------------------------------------------------------------------------------------


@query("select o.operator_name, o.brand, s.prefecture, count(distinct s.place_id) as n from operator_stores o join stores s using (place_id) where contains(s.prefecture, '_1') group by all")
def stores_in_area_by_operator(s, d):
    return _os(s, d).join(domain.stores(s, d).where(F.contains("prefecture", F.lit("_1"))).select("place_id", "prefecture"), "place_id").groupBy("operator_name", "brand", "prefecture").agg(F.count_distinct("place_id").alias("n"))


@query("select j.place_id, s.name, j.operation_type, j.judged_at::varchar as judged_at from judgements j join stores s using (place_id) order by judged_at desc, place_id limit 100")
def latest_judgements(s, d):
    return domain.judgements(s, d).join(domain.stores(s, d).select("place_id", "name"), "place_id").select("place_id", "name", "operation_type", F.col("judged_at").cast("string").alias("judged_at")).orderBy(F.desc("judged_at"), "place_id").limit(100)


@query("select place_id, brand, prefecture from stores where place_id not in (select place_id from operator_stores where operator_type <> 'franchisor')")
def stores_without_operator(s, d):
    return audit.without_operator(domain.stores(s, d), _os(s, d)).select("place_id", "brand", "prefecture")


@query("select place_id, brand, prefecture from stores where place_id not in (select place_id from operator_stores where operator_type <> 'franchisor' and corporate_number <> '')")
def stores_unverified(s, d):
    return audit.without_operator(domain.stores(s, d), _os(s, d), verified=True).select("place_id", "brand", "prefecture")


@query(", p as (select operator_name, brand, max(estimated_store_count) as n from links group by all) select operator_name, sum(n)::bigint as total from p where exists (select 1 from links l where l.operator_name = p.operator_name and l.operator_type <> 'franchisor' and l.brand <> p.brand) group by 1 having sum(n) >= 45")
def semi_join_operators(s, d):
    links = _links(s, d)
    p = links.groupBy("operator_name", "brand").agg(F.max("estimated_store_count").alias("n"))
    other = links.where("operator_type <> 'franchisor'").select(F.col("operator_name").alias("o"), F.col("brand").alias("b"))
    return p.join(other, F.expr("operator_name = o and brand <> b"), "left_semi").groupBy("operator_name").agg(F.sum("n").alias("total")).where("total >= 45")


@query("select brand, count(distinct operator_name) as operators from operator_stores where brand <> 'Brand#11' and operator_name in (select operator_name from operator_stores where brand = 'Brand#11' and operator_type not in ('franchisor', 'direct')) group by 1")
def affiliate_brands(s, d):
    return matching.affiliates(_os(s, d), "Brand#11")


@query("""select official_url, min(place_id) as place_id, count(distinct place_id) as n from stores where official_url <> '' group by 1 having count(distinct place_id) = 1""")
def unique_url_join_keys(s, d):
    out = matching.unique_key(domain.stores(s, d), "official_url", "place_id")
    return out.withColumn("n", F.lit(1).cast("long"))


@query(""", c as (select prefecture as key, corporate_number, corporate_number::bigint * 13 % 97 as score from registry where process <> '71'),
r as (select *, row_number() over (partition by key order by score desc, corporate_number) as r, lead(score) over (partition by key order by score desc, corporate_number) as nx from c)
select key, corporate_number, round(score / 100.0, 4)::double as score from r where r = 1 and (nx is null or score - nx >= 3)""")
def ambiguity_resolution(s, d):
    c = domain.registry(s, d).where("process <> '71'").select(F.col("prefecture").alias("key"), "corporate_number")
    return matching.resolve(c, "key", F.expr("cast((cast(corporate_number as bigint) * 13 % 97) / 100.0 as decimal(6,2))"), 0.03).select("key", "corporate_number", F.round(F.col("score").cast("double"), 4).alias("score"))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(f", a as (select place_id as id, lat, lng from stores where official_url = ''), b as (select place_id as id, lat, lng from stores where official_url <> '') select a.id as a_id, b.id as b_id, round({_HAV}, 2) as metres from a, b where {_HAV} <= 15000")
def proximity_join(s, d):
    st = domain.stores(s, d).withColumnRenamed("place_id", "id")
    lots = matching.near_lots(st.where("official_url = ''"), st.where("official_url <> ''"), 15000.0)
    return matching.pairs_of(lots.withColumn("metres", F.round("metres", 2)))


@query(f", a as (select place_id as id, lat, lng from stores where official_url = ''), b as (select place_id as id, lat, lng from stores where official_url <> ''), p as (select a.id as a_id, b.id as b_id, {_HAV} as m from a, b where {_HAV} <= 20000) select a_id, arg_min(b_id, (m, b_id)) as b_id, round(min(m), 2) as metres from p group by 1")
def nearest_anchor(s, d):
    st = domain.stores(s, d).withColumnRenamed("place_id", "id")
    return matching.nearest(st.where("official_url = ''"), st.where("official_url <> ''"), 20000.0).withColumn("metres", F.round("metres", 2))


@query(f", a as (select place_id as id, lat, lng from stores), b as (select place_id as id, lat, lng from stores where prefecture = 'NATION_5') select distinct a.id from a, b where {_HAV} <= 2000")
def cover_map(s, d):
    st = domain.stores(s, d).select(F.col("place_id").alias("id"), "lat", "lng", "prefecture")
    return matching.covered(st, st.where("prefecture = 'NATION_5'"), 2000.0).select("id")


@query(f", x as (select place_id as id, brand, lat, lng from stores) select a.id as a_id, b.id as b_id, a.brand, case when {_HAV} <= 1500 then 'DUPLICATE' else 'DOMINANT' end as relation from x a join x b on a.brand = b.brand and a.id < b.id where {_HAV} <= 15000")
def pair_classification(s, d):
    st = domain.stores(s, d).withColumnRenamed("place_id", "id")
    return matching.classify_pairs(st, 1500.0, 15000.0)


@query(""", k as (select distinct lower(replace(name, '#', '')) as k from registry), g as (select k, unnest(list_distinct(list_transform(range(1, length(k)), lambda i: k[i:i + 1]))) as g from k), z as (select k, count(*) as n from g group by 1),
p as (select a.k as a, b.k as b, count(*) as c from g a join g b on a.g = b.g and a.k <> b.k group by all), s as (select a, b, round(case when contains(a, b) or contains(b, a) then 0.9 else c / (za.n + zb.n - c) end, 4) as score from p join z za on za.k = a join z zb on zb.k = b)
select a, max(score) as score, arg_min(b, (-score, b)) as b from s where score >= 0.5 group by a""")
def fuzzy_best_match(s, d):
    k = domain.registry(s, d).select(F.lower(F.replace("name", F.lit("#"), F.lit(""))).alias("k")).distinct()
    return matching.best_among(k, "k", 0.5)


# -- coverage and audit ------------------------------------------------------------------------

_COV = ", f as (select place_id, 1 as known, max((corporate_number <> '')::int) as verified from operator_stores where operator_type not in ('franchisor', 'direct') group by 1)"
_COVS = "count(distinct place_id) as stores, coalesce(sum(known), 0)::bigint as known, coalesce(sum(verified), 0)::bigint as verified, round(coalesce(sum(known), 0) / count(distinct place_id), 4) as known_ratio, round(coalesce(sum(verified), 0) / count(distinct place_id), 4) as verified_ratio"


@query(f"{_COV} select brand, {_COVS} from stores left join f using (place_id) group by 1")
def coverage_per_brand(s, d):
    return audit.coverage_by(domain.stores(s, d), _os(s, d), ["brand"])


@query(f"""{_COV}, c as (select prefecture, brand, {_COVS} from stores left join f using (place_id) group by all)
select n_name as prefecture, b.brand, coalesce(stores, 0) as stores, coalesce(known, 0) as known, coalesce(verified, 0) as verified, coalesce(known_ratio, 0) as known_ratio, coalesce(verified_ratio, 0) as verified_ratio from nation cross join (select unnest(['Brand#11', 'Brand#22', 'Brand#3', 'Brand#4', 'Brand#99']) as brand) b left join c on c.prefecture = n_name and c.brand = b.brand""")
def coverage_dense_grid(s, d):
    return audit.dense_coverage(domain.stores(s, d), _os(s, d), read(s, d, "nation").select(F.col("n_name").alias("prefecture")), [*TARGETS, "Brand#99"])


@query(""", b as (select concat(brand, regexp_extract(name, ' #[0-9]+$', 0)) as brand, prefecture from stores), m as (select x.brand, n_name from (select distinct brand from b) x cross join nation except select brand, prefecture from b)
select x.brand, coalesce(string_agg(n_name, ' / ' order by n_name), '') as missing from (select distinct brand from b) x left join m using (brand) group by 1""")
def missing_prefectures(s, d):
    """Areas without a store, by brand and series, as there are few stores of a series."""
    areas = [r[0] for r in read(s, d, "nation").select("n_name").collect()]  # 25 rows
    series = F.concat("brand", F.regexp_extract("name", " #[0-9]+$", 0))
    return audit.missing_areas(domain.stores(s, d).withColumn("brand", series), areas)


@query("select operator_name, count(distinct brand) as brands, count(*) as rows from operator_stores group by 1 having max(corporate_number) = '' and count(distinct brand) >= 8")
def cross_brand_pollution(s, d):
    return audit.pollution(_os(s, d), 8)


@query(", p as (select operator_name from operator_stores group by 1 having max(corporate_number) = '' and count(distinct brand) >= 8) select count(*) as rows, count(distinct operator_name) as operators from operator_stores where operator_name not in (select operator_name from p)")
def purge_polluted(s, d):
    os = _os(s, d)
    return audit.purge(os, audit.pollution(os, 8)).agg(F.count("*").alias("rows"), F.count_distinct("operator_name").alias("operators"))


@query(", t as (select distinct operator_name, brand from arrivals where operator_type = 'franchisee'), f as (select distinct operator_name, brand from operator_stores where operator_type = 'franchisee') select count(*) as truth, count(f.brand) as hits, count(*) - count(f.brand) as misses, round(count(f.brand) / count(*), 4) as recall from t left join f using (operator_name, brand)")
def truth_recall(s, d):
    a = domain.arrivals(s, d)
    return audit.truth_recall(a.where("operator_type = 'franchisee'"), writes.merge_operator_stores(a).where("operator_type = 'franchisee'"), ["operator_name", "brand"])


@query(", f as (select prefecture, count(*) as found from stores where official_url = '' group by 1), r as (select prefecture, count(*) as n from stores where phone = '' group by 1) select prefecture, n, coalesce(found, 0) as found, round(coalesce(found, 0) / n, 3) as recall from r left join f using (prefecture) where n > 0")
def recall_by_area(s, d):
    st = domain.stores(s, d)
    return audit.area_recall(st.where("official_url = ''").groupBy("prefecture").agg(F.count("*").alias("n")), st.where("phone = ''").groupBy("prefecture").agg(F.count("*").alias("n")), "prefecture")


@query("select case when official_url = '' then 'no_url' when phone = '' then 'no_phone' when regexp_matches(name, '#9') then 'blocked_name' else 'accepted' end as reason, count(*) as n from stores group by 1")
def acceptance_chain(s, d):
    rows = audit.first_reason(domain.stores(s, d), [("no_url", F.col("official_url") == ""), ("no_phone", F.col("phone") == ""), ("blocked_name", F.col("name").rlike("#9"))])
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


# -- scalars -----------------------------------------------------------------------------------


@query("""select o_orderkey, concat_ws(':', parts[1], len(parts)) as head, case when first is null then '' else first end as number from (select o_orderkey, list_filter(list_transform(case when contains(v, ' / ') then string_split(v, ' / ') when contains(v, ';') then string_split(v, ';') else [v] end, lambda x: trim(x)), lambda x: x <> '') as parts,
list_filter(parts, lambda x: regexp_full_match(x, '\\d{13}'))[1] as first from (select o_orderkey, case when o_orderkey % 3 = 0 then concat(o_orderpriority, ' / ', lpad(o_orderkey::varchar, 13, '0')) when o_orderkey % 3 = 1 then concat(lpad(o_custkey::varchar, 13, '1'), ';', o_orderstatus) else o_orderpriority end as v from orders))""", plain=True)
def multi_value_split(s, d):
    v = read(s, d, "orders").select("o_orderkey", F.expr("case when o_orderkey % 3 = 0 then concat(o_orderpriority, ' / ', lpad(cast(o_orderkey as string), 13, '0')) when o_orderkey % 3 = 1 then concat(lpad(cast(o_custkey as string), 13, '1'), ';', o_orderstatus) else o_orderpriority end").alias("v"))
    parts = text.split_values("v")
    return v.select("o_orderkey", F.concat_ws(":", F.element_at(parts, 1), F.size(parts)).alias("head"), text.first_number("v").alias("number"))


@query("""select p_partkey, round(case when contains(a, b) or contains(b, a) then 1.0 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end, 4) as edit, jaccard_bigram as jaccard from (select p_partkey, lower(p_name) as a, lower(p_type) as b, round((select count(*) from (select unnest(ga) intersect select unnest(gb))) / (select count(*) from (select unnest(ga) union select unnest(gb))), 4) as jaccard_bigram from (select *, list_distinct(list_transform(range(1, length(p_name)), lambda i: lower(p_name)[i:i + 1])) as ga, list_distinct(list_transform(range(1, length(p_type)), lambda i: lower(p_type)[i:i + 1])) as gb from part))""", plain=True)
def name_similarities(s, d):
    a, b = F.lower("p_name"), F.lower("p_type")
    edit = F.when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return read(s, d, "part").select("p_partkey", F.round(edit, 4).alias("edit"), F.round(text.bigram_jaccard(a, b), 4).alias("jaccard"))


@query(f"select b.place_id, round({_HAV}, 2) as sphere, round(sqrt(pow((b.lng - a.lng) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 110540.0, 2)), 2) as flat from stores b, (select 35.68::double as lat, 139.76::double as lng) a")
def distances(s, d):
    lat, lng = F.lit(35.68), F.lit(139.76)
    return domain.stores(s, d).select("place_id", F.round(geo.haversine_m(lat, lng, F.col("lat"), F.col("lng")), 2).alias("sphere"), F.round(geo.flat_m(lat, lng, F.col("lat"), F.col("lng")), 2).alias("flat"))


@query("select place_id from stores where lat > 33 and lat <= 37 and lng > 133 and lng <= 139 and (lng < 136 or lat > 35)")
def point_in_polygon(s, d):
    shape = [(33.0001, 133.0001), (37.0001, 133.0001), (37.0001, 139.0001), (35.0001, 139.0001), (35.0001, 135.9999), (33.0001, 135.9999)]
    return domain.stores(s, d).where(geo.in_polygon(F.col("lat"), F.col("lng"), shape)).select("place_id")


# -- pages and documents -----------------------------------------------------------------------

_ANCHOR = """'<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""


@query(f"select page_id, (unnest(range(len(h)))) as pos, unnest(h) as href, trim(regexp_replace(unnest(l), '<[^>]+>', '', 'g')) as label from (select page_id, regexp_extract_all(html, {_ANCHOR}, 1) as h, regexp_extract_all(html, {_ANCHOR}, 2) as l from pages)", plain=True)
def page_links(s, d):
    return evidence.links(read(s, d, "pages"))


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^(?:map|maps|store|stores|shop|m)\\.', 'www.') as root from pages", plain=True)
def page_titles(s, d):
    return read(s, d, "pages").select("page_id", evidence.title(F.col("html")).alias("title"), evidence.host(F.col("url")).alias("host"), evidence.domain_root(F.col("url")).alias("root"))


@query("""select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as t from pages)""", plain=True)
def page_text(s, d):
    t = evidence.plain_text(F.col("html"))
    return read(s, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


@query("select place_id, host, root from (select place_id, lower(regexp_extract(official_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host, regexp_replace(host, '^www\\.', '') as root from stores where official_url <> '' and not contains(official_url, 'example3'))")
def foreign_domain_filter(s, d):
    st = domain.stores(s, d).where((F.col("official_url") != "") & ~F.contains("official_url", F.lit("example3")))
    h = evidence.host(F.col("official_url"))
    return st.select("place_id", h.alias("host"), F.regexp_replace(h, r"^www\.", "").alias("root"))


# -- streams -----------------------------------------------------------------------------------


def _typed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all", plain=True)
def stream_dedupe(s, d):
    rows = streams.drain(streams.running_dedupe(streams.file_stream(s, f"{d}/events.parquet").select("user_id", "event_type"), ["user_id", "event_type"]), "dedupe")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("select time_bucket(interval 1 hour, ts::timestamp) as start, time_bucket(interval 1 hour, ts::timestamp) + interval 1 hour as end, event_type, count(*) as n from events group by all", plain=True)
def stream_tumbling(s, d):
    return streams.drain(streams.windowed(_typed(streams.file_stream(s, f"{d}/events.parquet")), "1 hour"), "tumbling", "complete")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1", plain=True)
def stream_upsert(s, d):
    rows = streams.file_stream(s, f"{d}/events.parquet").select("user_id", "event_type", "event_id")
    return streams.upsert_sink(rows, ["user_id"], ["event_id"])
