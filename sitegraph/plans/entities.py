"""Registered queries over Japanese names, addresses and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import japan, text
from ..operators import registry, stores
from . import jp
from .catalog import query
from .domain import read

#: Other spellings of brands.
ALIASES = {"Curves": "カーブス", "MOS": "モスバーガー", "HARD OFF": "ハードオフ", "キッズデュオ": "Kids Duo", "コメダ珈琲店": "コメダ珈琲"}


def japanese(sql: str, recursive: bool = False):
    """Register a query whose SQL goes on from the Japanese tables."""
    return query((jp.JP_SQL.replace("with ", "with recursive ", 1) if recursive else jp.JP_SQL) + sql, plain=True)


def _alias_case(value: str) -> str:
    return f"case {value} " + " ".join(f"when '{a}' then '{b}'" for a, b in ALIASES.items()) + f" else {value} end"


# -- names -----------------------------------------------------------------------------------------


@japanese(" select operator_id, display, lower(display) as canonical, lower(core) as core from jp_operators")
def company_name_keys(s, d):
    return jp.operators(s, d).select("operator_id", text.operator_name("raw_name").alias("display"), text.canonical_key("raw_name").alias("canonical"), text.core_key(text.operator_name("raw_name")).alias("core"))


_NAMES = "case operator_id % 9 when 0 then '' when 1 then concat('第', lpad(operator_id::varchar, 6, '1'), '号') when 2 then concat('お客さま', core) when 3 then '株式会社ぐるなび' when 4 then concat(core, '東京都港区赤坂1丁目') when 5 then concat('採用キャリア採用', core) when 6 then concat(core, '本部オフィス') when 7 then concat('医療法人', display) else display end"


@japanese(" select operator_id, operator_id % 9 < 7 as garbage, operator_id % 9 in (3, 8) as may_run from jp_operators")
def garbage_names(s, d):
    """Names with every kind of debris."""
    rows = jp.operators(s, d).withColumn("n", F.expr(_NAMES.replace("::varchar", "").replace("operator_id, 6", "cast(operator_id as string), 6")))
    return rows.select("operator_id", text.structural_garbage("n").alias("garbage"), text.may_run_stores("n").alias("may_run"))


@japanese(" select a.operator_id as a, b.operator_id as b, a.core = b.core as same from jp_operators a join jp_operators b on b.operator_id = a.operator_id + 770 or b.operator_id = a.operator_id + 1")
def same_companies(s, d):
    """Whether two spellings mean one company: neighbours don't, those that share a core do."""
    o = jp.operators(s, d).select("operator_id", text.operator_name("raw_name").alias("n"))
    other = o.select(F.explode(F.array(F.col("operator_id") - 770, F.col("operator_id") - 1)).alias("a"), F.col("operator_id").alias("b"), F.col("n").alias("m"))
    return o.withColumnRenamed("operator_id", "a").join(other, "a").select("a", "b", text.operators_match(F.col("n"), F.col("m")).alias("same"))


@japanese(" select operator_id, case when operator_id % 3 = 0 then display when operator_id % 3 = 1 then concat(display, core) else 'ABC' end as head from jp_operators")
def japanese_heads(s, d):
    v = F.expr("case when operator_id % 3 = 0 then concat(display, ' ABC FOODS INC.') when operator_id % 3 = 1 then concat(display, ' ', core, ' Co. Ltd') else 'ABC Foods' end")
    return jp.operators(s, d).select("operator_id", text.japanese_head(v).alias("head"))


_BRANDS = "concat(case o_orderkey % 5 when 0 then 'Curves・モスバーガー' when 1 then 'MOS、カーブス,カーブス' when 2 then 'HARD OFF/Kids Duo／X' when 3 then ' x ' else '' end, case when o_orderkey % 2 = 0 then '、 キッズデュオ ' else '' end)"


@query(f"""with p as (select o_orderkey, unnest(string_split(replace(replace(replace(replace({_BRANDS}, '・', ','), '、', ','), '／', ','), '/', ','), ',')) as x, unnest(range(10)) as i from orders),
q as (select o_orderkey, {_alias_case('trim(x)')} as b, min(i) as i from p where trim(x) <> '' and upper(trim(x)) <> 'X' group by 1, 2)
select o.o_orderkey, coalesce(string_agg(b, '|' order by i), '') as brands from orders o left join q using (o_orderkey) group by 1""", plain=True)
def brand_lists(s, d):
    return read(s, d, "orders").select("o_orderkey", F.array_join(text.brand_list(F.expr(_BRANDS), ALIASES), "|").alias("brands"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'カーブス' when 1 then 'ABC(DEF)|DEF|ABC|GHI' when 2 then 'カーブス|XYZ' else p_name end as variants from part", plain=True)
def brand_variant_rows(s, d):
    v = F.expr("case p_partkey % 4 when 0 then 'Curves' when 1 then 'ABC(DEF)/GHI' when 2 then 'Curves／XYZ' else p_name end")
    return read(s, d, "part").select("p_partkey", F.array_join(text.brand_variants(v, ALIASES), "|").alias("variants"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey * 1000 when o_orderkey % 3 = 1 then (o_custkey // 1) * 1000 else 0 end::bigint as yen from orders", plain=True)
def thousand_yen_values(s, d):
    v = read(s, d, "orders").select("o_orderkey", F.expr("case when o_orderkey % 3 = 0 then format_number(o_custkey, 0) when o_orderkey % 3 = 1 then concat(o_custkey, '.75') else 'X' end").alias("v"))
    return v.select("o_orderkey", text.thousand_yen("v").alias("yen"))


@japanese(" select place_id, case when url = '' then '' when contains(url, 'example3') then concat('https://www.example3.co.jp/s/', place_id % 700, '/') else url end as url from jp_stores")
def official_urls(s, d):
    st = jp.stores(s, d)
    shown = F.when(F.contains("url", F.lit("example3")), F.concat(F.rtrim("url", F.lit("/")), F.when(F.col("place_id") % 2 == 0, "?x=1").otherwise("/#top"))).otherwise(F.col("url"))
    return st.select("place_id", text.canonical_url(shown, "example3", "https://www.example3.co.jp").alias("url"))


# -- addresses -------------------------------------------------------------------------------------


@japanese(" select place_id, plain_address as normal, pref, city, substr(plain_address, length(pref) + length(city) + 1) as rest from jp_stores")
def parsed_addresses(s, d):
    return jp.stores(s, d).select("place_id", japan.parse_address("address").alias("a")).select("place_id", "a.normal", "a.pref", "a.city", "a.rest")


@japanese(" select place_id, pref, concat(city, case when town like '%町' then town else '' end) as city, case when town like '%町' then '' else town end as town, pref as anywhere from jp_stores")
def loose_place_parts(s, d):
    """City and town by loose patterns, whose city goes on to the last ward or town that eight characters allow."""
    p = japan.place_parts("address")
    return jp.stores(s, d).select("place_id", p["pref"].alias("pref"), p["city"].alias("city"), p["town"].alias("town"), japan.prefecture_in("address").alias("anywhere"))


@japanese(""", k as (select *, concat(pref, city, town, place_id % 9 + 1) as head, place_id % 20 + 1 as mid, substr(concat(place_id % 30 + 1, case when place_id % 4 = 2 then '203' else '' end), 1, 3) as last from jp_stores)
select place_id, concat_ws('-', head, mid, last) as key, concat_ws('-', head, mid) as block, head as first_block from k""")
def address_keys(s, d):
    """Keys of addresses; as blanks go first, the number of a flat behind a blank runs into the last number."""
    return jp.stores(s, d).select("place_id", japan.address_key("address").alias("key"), japan.address_key("address", 2).alias("block"), japan.address_key("address", 1).alias("first_block"))


@japanese(""", k as (select place_id, core, list_distinct(list_filter([phone, replace(phone, '-', ''), replace(name, ' ', ''), core, concat(core, '店'), concat(pref, city, town, place_id % 9 + 1), concat(regexp_replace(city, '^.*?[市区]', ''), town)], lambda x: length(x) >= 2)) as k from jp_stores)
select place_id, core, array_to_string(list_sort(k), '|') as keys from k""")
def store_key_rows(s, d):
    keys = japan.store_keys("name", "address", "phone", list(jp.BRANDS))
    return jp.stores(s, d).select("place_id", japan.store_core("name", list(jp.BRANDS)).alias("core"), F.array_join(F.array_sort(keys), "|").alias("keys"))


@japanese(" select place_id, case when place_id % 3 = 0 then pref when place_id % 3 = 1 then '長野県' when place_id % 4 = 0 then '三重県' else '' end as prefecture, case when pref in ('北海道', '沖縄県') then 12.5 when pref in ('東京都', '大阪府', '神奈川県', '福岡県') then 3.0 else 5.0 end::double as cell_km from jp_stores")
def resolved_prefectures(s, d):
    st = jp.stores(s, d)
    blank = F.lit("")
    own = F.when(F.col("place_id") % 3 == 0, F.col("plain_address")).otherwise(blank)
    kept = F.when(F.col("place_id") % 3 == 1, "長野県").otherwise(blank)
    found = F.when(F.col("place_id") % 4 == 0, "三重県").otherwise(blank)
    return st.select("place_id", japan.resolve_prefecture(own, kept, found, F.lit(None)).alias("prefecture"), F.round(japan.cell_km("pref", 5.0), 4).alias("cell_km"))


@japanese(" select place_id, (lat between 24 and 29.2 and lng between 122 and 132 or lat between 28 and 46 and lng between 129 and 146.5) and place_id % 5 <> 1 as inside from (select place_id, lat - 5 as lat, lng + 8 as lng from jp_stores)")
def stores_in_japan(s, d):
    tag = F.expr("case place_id % 5 when 0 then 'jp' when 1 then 'KR' when 2 then '日本国' else null end")
    return jp.stores(s, d).select("place_id", japan.in_japan(F.col("lat") - 5, F.col("lng") + 8, tag).alias("inside"))


# -- registry --------------------------------------------------------------------------------------

_ASKED = """, asked as (select distinct case operator_id % 7 when 0 then name when 1 then raw when 2 then substr(name, 1, 8) when 3 then substr(name, 3, 6) when 4 then concat(' ', name) when 5 then 'ない会社' else '' end as name
  from (select operator_id, display as name, raw_name as raw from jp_operators)), n as (select distinct trim(name) as name from asked where trim(name) <> ''),
a as (select * from jp_registry where process in ('01', '11', '12', '13', '21', '22', '31')),
k as (select name, lower(trim(regexp_replace(replace(replace(replace(replace(replace(name, '㈱', '株式会社'), '(株)', '株式会社'), '㈲', '有限会社'), '　', ' '), '社 ', '社'), '[。]+$', ''))) as key from n)"""
_HITS = """, h as (select n.name, a.corporate_number, 1 as tier from n join a using (name) union all select k.name, a.corporate_number, 2 from k join a on a.normalized_name = k.key
  union all select n.name, a.corporate_number, 3 from n join a on starts_with(a.name, n.name) union all select k.name, a.corporate_number, 4 from k join a on starts_with(a.normalized_name, k.key) union all select n.name, a.corporate_number, 5 from n join a on contains(a.name, n.name))"""


def _asked(s, d):
    return jp.operators(s, d).select(F.expr("case operator_id % 7 when 0 then display when 1 then raw_name when 2 then substr(display, 1, 8) when 3 then substr(display, 3, 6) when 4 then concat(' ', display) when 5 then 'ない会社' else '' end").alias("name"))


@japanese(_ASKED + _HITS + " select name, min(corporate_number) as corporate_number, tier from h where tier = (select min(tier) from h g where g.name = h.name) group by name, tier")
def registry_cascade(s, d):
    """The first of five tiers with a hit, by name."""
    return registry.cascade(_asked(s, d), jp.registry(s, d))


@japanese(_ASKED + ", r as (select name, normalized_name, corporate_number, process in ('01', '11', '12', '13', '21', '22', '31') as alive from jp_registry) select k.name, arg_min(r.name, (not alive, r.name <> k.name, corporate_number)) as registry_name, arg_min(corporate_number, (not alive, r.name <> k.name, corporate_number)) as corporate_number from k join r on r.normalized_name = k.key group by 1")
def registry_exact(s, d):
    return registry.exact_verified(_asked(s, d).select(F.trim("name").alias("name")).where("name <> ''"), jp.registry(s, d))


@japanese(_ASKED + _HITS.replace("h as (", "h1 as (") + """, f as (select name, min(tier) as tier from h1 group by 1), a2 as (select * from jp_registry), left2 as (select * from n where name not in (select name from f)), k2 as (select * from k where name not in (select name from f)),
h2 as (select n.name, a.corporate_number, 1 as tier from left2 n join a2 a using (name) union all select k.name, a.corporate_number, 2 from k2 k join a2 a on a.normalized_name = k.key union all select n.name, a.corporate_number, 3 from left2 n join a2 a on starts_with(a.name, n.name) union all select k.name, a.corporate_number, 4 from k2 k join a2 a on starts_with(a.normalized_name, k.key) union all select n.name, a.corporate_number, 5 from left2 n join a2 a on contains(a.name, n.name)),
b as (select h1.*, true as alive from h1 join f using (name, tier) union all select h2.*, false from h2 join (select name, min(tier) as tier from h2 group by 1) using (name, tier))
select b.name, arg_min(corporate_number, (r.name <> b.name, corporate_number)) as corporate_number, min(tier) as tier, bool_or(alive) as alive from b join jp_registry r using (corporate_number) group by 1""")
def franchisor_records(s, d):
    """Companies that no longer exist only where no other is found."""
    return registry.franchisor_record(_asked(s, d).select(F.trim("name").alias("name")).where("name <> ''").distinct(), jp.registry(s, d))


_BARE = ", n as (select distinct core as name from jp_operators), c as (select n.name, corporate_number, r.name as registry_name, prefecture, city, street from n join jp_registry r on r.name in (n.name, concat('株式会社', n.name), concat(n.name, '株式会社')) where process = '01')"


@japanese(_BARE + " select name, corporate_number, prefecture from c")
def hydration_candidates(s, d):
    return registry.hydration_candidates(jp.operators(s, d).select(F.col("core").alias("name")).distinct(), jp.registry(s, d)).select("name", "corporate_number", "prefecture")


@japanese(_BARE + """, w as (select core as name, min(prefecture) as wanted from jp_operators where operator_id % 3 = 0 group by 1),
p as (select c.*, wanted, bool_or(c.prefecture = wanted) over (partition by c.name) as held from c join w using (name))
select name, corporate_number, prefecture from p where not held or prefecture = wanted qualify row_number() over (partition by name order by corporate_number) <= 6""")
def prefecture_preferred(s, d):
    names = jp.operators(s, d).where("operator_id % 3 = 0").groupBy(F.col("core").alias("name")).agg(F.min("prefecture").alias("prefecture"))
    return registry.prefecture_preferred(names, jp.registry(s, d))


_SCORE = "case when pref <> '' and pref = c.prefecture then 50 else 0 end + case when hq <> '' and contains(replace(hq, '-', ''), replace(c.city, '-', '')) then 20 else 0 end + case when hq <> '' and (contains(replace(hq, '-', ''), replace(c.street, '-', '')) or contains(replace(concat(c.prefecture, c.city, c.street), '-', ''), replace(hq, '-', ''))) then 30 else 0 end"


@japanese(_BARE + f""", x as (select core as name, arg_max(prefecture, (prefecture <> '', hq <> '', length(hq), hq, prefecture)) as pref, arg_max(hq, (prefecture <> '', hq <> '', length(hq), hq, prefecture)) as hq
  from (select core, case when operator_id % 5 = 0 then '' else prefecture end as prefecture, case when operator_id % 4 = 0 then '' else concat(prefecture, city, street) end as hq from jp_operators where operator_id % 3 = 0) group by 1),
z as (select c.name, corporate_number, c.prefecture, coalesce(pref, '') as pref, coalesce(hq, '') as hq, {_SCORE} as score from c left join x on x.name = c.name),
y as (select *, count(*) over (partition by name) as n, max(score) over (partition by name) as top, row_number() over (partition by name order by score desc, corporate_number) as r from z),
t as (select *, sum((score = top)::int) over (partition by name) as tied from y),
u as (select *, case when n = 1 and pref <> '' and pref <> prefecture then 'prefecture_mismatch' when n = 1 then 'accepted_unique' when top >= 50 and tied = 1 then 'accepted_disambiguated' else 'ambiguous' end as status from t where r = 1)
select name, status, case when starts_with(status, 'accepted') then corporate_number end as corporate_number from u""")
def hydration_matches(s, d):
    o = jp.operators(s, d)
    ctx = o.where("operator_id % 3 = 0").select(F.col("core").alias("name"), F.expr("case when operator_id % 5 = 0 then '' else prefecture end").alias("prefecture"), F.expr("case when operator_id % 4 = 0 then '' else concat(prefecture, city, street) end").alias("head_office"))
    found = registry.hydration_candidates(o.select(F.col("core").alias("name")).distinct(), jp.registry(s, d))
    return registry.selected_matches(found, ctx).select("name", "status", "corporate_number")


@japanese(""", s as (select operator_id as id, display as operator_name, case when operator_id % 6 = 0 then lpad((operator_id + operator_id % 4)::varchar, 13, '0') else '' end as num, case when operator_id % 2 = 0 then prefecture else '' end as pref, case when operator_id % 4 = 0 then city else '' end as city from jp_operators),
g as (select id, operator_name, num, r.name as registry_name, case when r.name is null then 'houjin_corp_number_missing' else 'houjin_corp_number' end as status from s left join jp_registry r on r.corporate_number = num where num <> ''),
c as (select s.id, s.operator_name, s.pref, s.city, r.corporate_number, r.prefecture as rp, r.city as rc, r.name as rn, process = '01' as alive from s join jp_registry r on r.name = s.operator_name where num = ''),
b as (select * from c where alive or id not in (select id from c where alive)),
m as (select *, count(*) over w as n, count_if(pref <> '' and rp = pref) over w as np, count_if(pref <> '' and rp = pref and city <> '' and starts_with(rc, city)) over w as nc, bool_or(alive) over w as any_alive from b window w as (partition by id)),
k as (select *, case when nc > 0 then pref <> '' and rp = pref and city <> '' and starts_with(rc, city) when np > 0 then pref <> '' and rp = pref when pref <> '' and city <> '' then false else true end as keep from m),
f as (select id, any_value(operator_name) as operator_name, any_value(n) as n, count_if(keep) as l, min(corporate_number) as sole, min(case when keep then corporate_number end) as chosen, any_value(any_alive) as al from k group by 1),
q as (select s.id, s.operator_name, case when f.n = 1 then sole when l = 1 then chosen else '' end as corporate_number, case when f.n is null then 'houjin_no_match' when f.n = 1 then concat('houjin_unique_name', case when al then '' else '_inactive_fallback' end) when l = 1 then concat('houjin_context_match', case when al then '' else '_inactive_fallback' end) else 'houjin_ambiguous' end as status from s left join f using (id) where num = '')
select id, operator_name, num as corporate_number, status from g union all select id, operator_name, corporate_number, status from q where not starts_with(status, 'houjin_no_match') union all select id, operator_name, '' , 'houjin_no_match' from q where status = 'houjin_no_match'
""")
def verified_source_rows(s, d):
    """Rows of sources whose company is found by number, by name, or by name and place."""
    rows = jp.operators(s, d).selectExpr("operator_id as id", "display as operator_name", "case when operator_id % 6 = 0 then lpad(cast(operator_id + operator_id % 4 as string), 13, '0') else '' end as corporate_number", "case when operator_id % 2 = 0 then prefecture else '' end as prefecture", "case when operator_id % 4 = 0 then city else '' end as city")
    return registry.verified_rows(rows, jp.registry(s, d)).select("id", "operator_name", "corporate_number", "status")


@japanese(""", seeds as (select distinct case when operator_id % 3 = 0 then display when operator_id % 3 = 1 then concat(' ', display) else 'ない会社' end as name from jp_operators where operator_id % 2 = 0),
ops as (select lower(replace(display, ' ', '')) as k, case when operator_id % 4 = 0 then '' else lpad(operator_id::varchar, 13, '0') end as num from jp_operators where operator_id % 6 = 0),
o as (select k, min(case when num <> '' then num end) as num, count(*) as n from ops group by 1), r as (select normalized_name as key, count(distinct corporate_number) as m, min(corporate_number) as num from jp_registry group by 1)
select s.name, case when o.n >= 1 then coalesce(o.num, '') when r.m = 1 then r.num else '' end as corporate_number, case when o.n = 1 then 'operator_company_match' when o.n > 1 then 'operator_company_multiple' when r.m = 1 then 'houjin_exact' when r.m > 1 then 'houjin_ambiguous' else '' end as note
from seeds s left join o on o.k = lower(replace(s.name, ' ', '')) left join r on r.key = lower(trim(s.name))""")
def resolved_seeds(s, d):
    o = jp.operators(s, d)
    seeds = o.where("operator_id % 2 = 0").selectExpr("case when operator_id % 3 = 0 then display when operator_id % 3 = 1 then concat(' ', display) else 'ない会社' end as name")
    known = o.where("operator_id % 6 = 0").selectExpr("display as name", "case when operator_id % 4 = 0 then '' else lpad(cast(operator_id as string), 13, '0') end as corporate_number")
    return registry.seed_resolved(seeds, known, jp.registry(s, d))


@japanese(""", st as (select place_id, pref, city, concat(town, case when place_id % 2 = 0 then (place_id % 9 + 1)::varchar else '' end) as town from jp_stores), r as (select * from jp_registry where process = '01'),
n as (select place_id, count(corporate_number) as n, min(corporate_number) as num from st left join r on r.prefecture = st.pref and r.city = st.city and starts_with(r.street, st.town) group by 1)
select place_id, n, case when n = 1 then num else '' end as corporate_number, case when n = 1 then 'single_match' when n > 1 then concat('multi_match(', n, ')') else 'no_match' end as reason from n""")
def companies_at_stores(s, d):
    """Companies in the street of a store; every second store's town has its block."""
    st = jp.stores(s, d).selectExpr("place_id", "named_struct('pref', pref, 'city', city, 'town', concat(town, case when place_id % 2 = 0 then cast(place_id % 9 + 1 as string) else '' end)) as parts")
    return registry.by_location(st, jp.registry(s, d))


@japanese(""", c as (select distinct brand, case operator_id % 8 when 0 then concat('株式会社', brand) when 1 then concat('株式会社', brand, 'ホールディングス') when 2 then concat(brand, '不動産株式会社') when 3 then concat('株式会社', brand, '渋谷店') when 4 then concat(brand, '協議会') when 5 then concat(brand, 'ジャパン') when 6 then core else brand end as name, operator_id % 13 as z
  from (select operator_id, core, case operator_id % 6 when 0 then 'カーブス' when 1 then 'モスバーガー' when 2 then '業務スーパー' when 3 then 'コメダ珈琲' when 4 then 'ハードオフ' else 'Kids Duo' end as brand from jp_operators)),
s as (select brand, name, case when contains(name, '協議会') then -1000 else 10 * contains(name, brand)::int + 5 * regexp_matches(name, 'ホールディングス|ジャパン')::int + starts_with(name, '株式会社')::int + 20 * (name = concat('株式会社', brand))::int - 15 * contains(name, '不動産')::int - 15 * (contains(name, '渋谷店'))::int end as score from c where z < 9)
select brand, arg_min(name, (-score, length(name), name)) as name, max(score) as score from s group by 1 having max(score) >= 15""")
def guessed_franchisors(s, d):
    kinds = "case operator_id % 8 when 0 then concat('株式会社', brand) when 1 then concat('株式会社', brand, 'ホールディングス') when 2 then concat(brand, '不動産株式会社') when 3 then concat('株式会社', brand, '渋谷店') when 4 then concat(brand, '協議会') when 5 then concat(brand, 'ジャパン') when 6 then core else brand end"
    c = jp.operators(s, d).where("operator_id % 13 < 9").withColumn("brand", F.expr(jp.choose("operator_id", jp.BRANDS)))
    return registry.guessed_franchisor(c.select("brand", F.expr(kinds).alias("name")).distinct(), "brand", "name")


@japanese(", c as (select distinct prefecture as wanted, display as name from jp_operators) select wanted, arg_min(name, (length(name), name)) as name from c group by 1")
def shortest_names(s, d):
    return registry.shortest_or_exact(jp.operators(s, d).select(F.col("prefecture").alias("wanted"), F.col("display").alias("name")).distinct(), "wanted", "name")


_CAND = "select r.prefecture as key, '山田商事ア' as query, r.name, r.corporate_number, ((r.corporate_number::bigint * 7 % 89) / 100.0)::double as score, r.prefecture, r.city, case when contains(r.prefecture, '県') then r.prefecture else '東京都' end as hp, case when r.prefecture = '沖縄県' then '那覇市' else 'ない市' end as hc from jp_registry r where process = '01'"


@japanese(f""", c as ({_CAND}), e as (select *, case when name = query then 3.0 else 0.0 end + case when prefecture = hp then 1.0 else 0.0 end as extra, prefecture = hp and city = hc as here from c),
p as (select *, round(least(score + extra * 0.1, 1.0), 9) as points from e),
r as (select *, row_number() over w as r, lead(points) over w as nx from p window w as (partition by key order by here desc, case when here then 0.0 else points end desc, corporate_number))
select key, corporate_number, case when extra >= 3 then 'exact' when extra >= 1 then 'partial' else 'ambiguous' end as level from r where r = 1 and (here or nx is null or round(points - nx, 9) >= 0.1)""")
def resolved_candidates(s, d):
    r = jp.registry(s, d).where("process = '01'")
    c = r.select(F.col("prefecture").alias("key"), F.lit("山田商事ア").alias("query"), "name", "corporate_number", F.expr("cast(cast(corporate_number as bigint) * 7 % 89 as double) / 100").alias("score"), "prefecture", "city", F.expr("case when contains(prefecture, '県') then prefecture else '東京都' end").alias("hint_prefecture"), F.expr("case when prefecture = '沖縄県' then '那覇市' else 'ない市' end").alias("hint_city"))
    return registry.resolved(c, "key")


@japanese(""", l as (select regexp_replace(phone, '[^0-9]', '', 'g') as p, min(name) as name, 0 as src from jp_stores where phone <> '' and place_id % 5 = 0 group by 1 union all select regexp_replace(phone, '[^0-9]', '', 'g'), min(brand), 1 from jp_stores where phone <> '' and place_id % 2 = 0 group by 1)
select place_id, arg_min(l.name, l.src) as operator_name, min(l.src) as source from jp_stores s join l on l.p = regexp_replace(s.phone, '[^0-9]', '', 'g') where s.phone <> '' group by 1""")
def phone_operators(s, d):
    st = jp.stores(s, d)
    first = st.where("phone <> '' and place_id % 5 = 0").groupBy("phone").agg(F.min("name").alias("operator_name"))
    second = st.where("phone <> '' and place_id % 2 = 0").groupBy(F.replace("phone", F.lit("-"), F.lit(" ")).alias("phone")).agg(F.min("brand").alias("operator_name"))
    return registry.phone_operators(st, [first, second])


# -- stores ----------------------------------------------------------------------------------------


@japanese(", u as (select url from jp_stores where url <> '' and place_id % 4 <> 1 group by 1), j as (select s.place_id, s.url, u.url is not null as listed, row_number() over (partition by s.url order by place_id) as nth from jp_stores s left join u using (url)) select place_id, case when not listed then 'not_in_official_list' else 'duplicate_official_url' end as reason from j where not listed or nth > 1")
def not_official_stores(s, d):
    st = jp.stores(s, d).withColumnRenamed("url", "official_url")
    return stores.not_official(st, st.where("official_url <> '' and place_id % 4 <> 1").select("official_url"))


@japanese(" select place_id, name from jp_stores where not contains(name, 'カーブス') and not contains(url, 'example7.')")
def false_positive_stores(s, d):
    return stores.false_positives(jp.stores(s, d).withColumnRenamed("url", "official_url"), ["カーブス", "EXAMPLE7."]).select("place_id", "name")


@japanese(""", o as (select (place_id % 700)::varchar as slug, min(plain_address) as address, concat('https://www.example', min(place_id) % 40, '.co.jp/s/', place_id % 700, '/') as url from jp_stores where place_id % 700 < 200 group by 1, place_id % 700),
h as (select slug, place_id, 0 as how from o join jp_stores s on s.url <> '' and contains(s.url, concat('/', o.slug, '/')) union all select slug, place_id, 1 from o join jp_stores s on s.url = o.url union all select slug, place_id, 1 from o join jp_stores s on s.plain_address = o.address)
select slug, arg_min(place_id, (how, place_id)) as place_id, case when min(how) = 0 then 'slug' else 'url_or_address' end as how from h group by 1""")
def official_store_matches(s, d):
    st = jp.stores(s, d)
    o = st.where("place_id % 700 < 200").groupBy((F.col("place_id") % 700).cast("string").alias("slug")).agg(F.min("plain_address").alias("address"), F.min("place_id").alias("p")).select("slug", "address", F.concat(F.lit("https://www.example"), (F.col("p") % 40).cast("string"), F.lit(".co.jp/s/"), "slug", F.lit("/")).alias("url"))
    return stores.official_matches(o, st.select("place_id", F.col("url").alias("official_url"), F.col("plain_address").alias("address")))


@japanese(""", p as (select place_id as page_id, case place_id % 4 when 0 then core when 1 then substr(core, 1, 3) when 2 then '' else concat(core, '前') end as core, case when place_id % 3 = 0 then plain_address else '' end as address from jp_stores where place_id % 50 < 8),
s as (select place_id, core, plain_address from jp_stores where place_id % 40 < 3),
h as (select p.page_id, s.place_id, address <> '' and (contains(address, plain_address) or contains(plain_address, address)) as near from p join s on p.core <> '' and (contains(p.core, s.core) or contains(s.core, p.core))),
t as (select page_id, count(*) as n, count_if(near) as na, min(place_id) as one, min(case when near then place_id end) as nid from h group by 1),
r as (select p.page_id, n, na, one, nid, case when p.core = '' then 'store_core_missing' when n is null then 'store_not_found' when na = 1 then '' when na > 1 then 'store_address_ambiguous' when n = 1 then '' else 'store_name_ambiguous' end as reason from p left join t using (page_id))
select page_id, case when reason = '' then case when na = 1 then nid else one end end as place_id, reason from r""")
def pages_matched_to_stores(s, d):
    st = jp.stores(s, d)
    p = st.where("place_id % 50 < 8").selectExpr("place_id as page_id", "case place_id % 4 when 0 then core when 1 then substr(core, 1, 3) when 2 then '' else concat(core, '前') end as core", "case when place_id % 3 = 0 then plain_address else '' end as address")
    return stores.matched_pages(p, st.where("place_id % 40 < 3").select("place_id", "core", F.col("plain_address").alias("address")))


@japanese(", c as (select distinct plain_address as key, brand as operator_name from jp_stores where place_id % 5 = 0) select distinct place_id, c.operator_name from jp_stores s join c on c.key = s.plain_address")
def stores_by_address_key(s, d):
    st = jp.stores(s, d)
    found = st.where("place_id % 5 = 0").select(F.col("brand").alias("operator_name"), japan.address_key("address").alias("key"))
    return stores.by_address_key(st.select("place_id", japan.address_key("address").alias("key")), found)


@japanese(", t as (select operator_id as id, case operator_id % 5 when 0 then display when 1 then core when 2 then 'カーブス株式会社' when 3 then '株式会社本部フーズ' else '' end as op, case when operator_id % 2 = 0 then concat('合同会社', core) else '' end as owner from jp_operators) select id, case when op <> '' and id % 5 = 0 then op when owner <> '' then owner end as operator_name from t where id % 5 = 0 or owner <> ''")
def operator_tags(s, d):
    rows = jp.operators(s, d).selectExpr("operator_id as id", "map('operator', case operator_id % 5 when 0 then display when 1 then core when 2 then 'カーブス株式会社' when 3 then '株式会社本部フーズ' else '' end, 'owner', case when operator_id % 2 = 0 then concat('合同会社', core) else '' end) as tags")
    blocked = s.createDataFrame([("株式会社本部フーズジャパン",)], "name string")
    return stores.operator_tag(F.col("tags"), F.lit("カーブス"), blocked, rows, "id")


@japanese(", n as (select lower(display) as key, min(operator_id) as first, count(distinct operator_id) as stores, round(avg((operator_id % 10) / 10.0), 8) as mean_confidence from jp_operators group by 1), t as (select lower(display) as key, operator_id % 3 as k, count(*) as c, min(operator_id) as f from jp_operators group by 1, 2) select n.key, stores, mean_confidence, arg_min(case k when 0 then 'franchisee' when 1 then 'direct' else 'unknown' end, (-c, f)) as operator_type from n join t using (key) group by all")
def chain_summaries(s, d):
    found = jp.operators(s, d).selectExpr("raw_name as operator_name", "operator_id as place_id", "operator_id as seq", "case operator_id % 3 when 0 then 'franchisee' when 1 then 'direct' else 'unknown' end as operator_type", "cast(operator_id % 10 as double) / 10 as confidence")
    return stores.chain_summary(found, "seq").select("key", "stores", "mean_confidence", "operator_type")


@japanese(", n as (select display as operator_name, count(distinct case when operator_id % 4 <> 0 then operator_id end) as verified, count(distinct case when operator_id % 4 = 0 then operator_id end) as unverified from jp_operators group by 1) select *, verified >= 2 as is_mega from n")
def scope_reports(s, d):
    return stores.scope_report(jp.operators(s, d).selectExpr("display as operator_name", "operator_id as place_id", "operator_id % 4 <> 0 as verified"), 2)

