"""Registered queries over links, the master table, audits and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, components, master, matching, stores, views
from ..operators.ranks import positioned
from . import domain, jp
from .catalog import TARGETS, _links, _os, query
from .domain import read
from .entities import japanese

_TWO = ["Brand#11", "Brand#22"]


# -- brands and links ----------------------------------------------------------------------------------


@query(""", w as (select operator_name, coalesce(max(case when brand = 'Brand#11' then estimated_store_count end), 0) as brand_11, coalesce(max(case when brand = 'Brand#22' then estimated_store_count end), 0) as brand_22, coalesce(max(case when brand = 'Brand#3' then estimated_store_count end), 0) as brand_3, coalesce(max(case when brand = 'Brand#4' then estimated_store_count end), 0) as brand_4 from links group by 1),
t as (select *, brand_11 + brand_22 + brand_3 + brand_4 as total, (brand_11 > 0)::int + (brand_22 > 0)::int + (brand_3 > 0)::int + (brand_4 > 0)::int as held from w)
select *, row_number() over (order by total desc, held desc, operator_name) as company_priority_rank from t""")
def master_wide_rows(s, d):
    return views.wide(_links(s, d), TARGETS)


_FILL = """, l as (select brand, case when corporate_number <> '' then corporate_number else replace(operator_name, ' ', '') end as who, operator_type as t, case when operator_type in ('franchisor', 'direct') then estimated_store_count * (length(operator_name) + estimated_store_count % 7) else estimated_store_count end as n from links),
h as (select brand, max(n) as expected from l where t in ('franchisor', 'direct') group by 1), p as (select brand, who, max(case when t = 'franchisee' then n end) as fr, max(n) as cand from l where t in ('franchisee', 'unknown') group by all),
f as (select b.brand, coalesce(any_value(expected), 0) as expected, coalesce(sum(fr), 0)::bigint as franchisee, coalesce(sum(cand), 0)::bigint as candidate, count(fr) as operators from (select distinct brand from l) b left join h using (brand) left join p using (brand) group by 1),
g as (select *, case when expected <= 0 then 'no_franchisor_total' when operators = 0 then 'empty' when franchisee * 100 / expected > 120 then 'overfilled_review' when franchisee * 100 / expected < 25 then 'very_low' when franchisee * 100 / expected < 50 then 'low' when franchisee * 100 / expected < 80 then 'medium' else 'covered' end as status, round(franchisee * 100 / nullif(expected, 0), 1) as fill_pct from f),
k as (select *, case when status = 'overfilled_review' then 'REVIEW_OVERFILL' when status = 'no_franchisor_total' then 'P4_NEED_TOTAL' when status = 'empty' and expected >= 100 then 'P0_FIND_OFFICIAL_LIST' when expected >= 300 and status in ('very_low', 'low') then 'P0_EXPAND' when expected >= 50 and status in ('very_low', 'low') then 'P1_EXPAND' when status = 'medium' then 'P2_EXPAND' else 'P3_MONITOR' end as priority from g)"""


def _fill_links(s: SparkSession, d: str) -> DataFrame:
    """Links in which headquarters count more stores than any franchisee."""
    n = F.col("estimated_store_count")
    return _links(s, d).withColumn("estimated_store_count", F.when(F.col("operator_type").isin("franchisor", "direct"), n * (F.length("operator_name") + n % 7)).otherwise(n))


@query(f"{_FILL} select brand, expected, franchisee, candidate, operators, fill_pct, status, priority from k")
def brand_fill_rate(s, d):
    return views.fill_rate(_fill_links(s, d))


@query(f"{_FILL} select brand, priority, row_number() over (order by case priority when 'P0_FIND_OFFICIAL_LIST' then 0 when 'P0_EXPAND' then 1 when 'P1_EXPAND' then 2 when 'P2_EXPAND' then 3 when 'REVIEW_OVERFILL' then 4 when 'P3_MONITOR' then 5 else 6 end, expected desc, coalesce(fill_pct, 9999), brand) as position from k")
def fill_priorities(s, d):
    return master.fill_order(views.fill_rate(_fill_links(s, d))).select("brand", "priority", "position")


_EVIDENCE_LINKS = """, el as (select brand, case when seq % 2 = 0 then operator_name else concat(substr(operator_name, 1, 8), ' ', substr(operator_name, 9)) end as operator_name, case when seq % 3 = 0 then corporate_number else '' end as corporate_number, place_id % 6 as estimated_store_count, operator_type,
  case seq % 4 when 0 then 'pipeline' when 1 then 'jfa' when 2 then 'manual_megajii_2026_04_24' else 'other' end as source, case when place_id % 2 = 0 then '' else 'https://e' end as source_url, case when place_id % 5 = 0 then 'hq' else '' end as head_office, case when place_id % 3 = 0 then concat('chain_discovery ', seq) else concat('note ', place_id) end as note, place_id * 10 + seq as id from arrivals)"""


def _evidence_links(s: SparkSession, d: str) -> DataFrame:
    """Several rows for a brand and operator, in two spellings of the name."""
    return domain.arrivals(s, d).selectExpr(
        "brand", "case when seq % 2 = 0 then operator_name else concat(substr(operator_name, 1, 8), ' ', substr(operator_name, 9)) end as operator_name", "case when seq % 3 = 0 then corporate_number else '' end as corporate_number", "place_id % 6 as estimated_store_count", "operator_type",
        "case seq % 4 when 0 then 'pipeline' when 1 then 'jfa' when 2 then 'manual_megajii_2026_04_24' else 'other' end as source", "case when place_id % 2 = 0 then '' else 'https://e' end as source_url", "case when place_id % 5 = 0 then 'hq' else '' end as head_office", "case when place_id % 3 = 0 then concat('chain_discovery ', seq) else concat('note ', place_id) end as note", "place_id * 10 + seq as id",
    )


@query(f"""{_EVIDENCE_LINKS}, w as (select * from el where not (source = 'pipeline' and operator_type = 'unknown' and source_url = '' and contains(note, 'chain_discovery')))
select brand, replace(operator_name, ' ', '') as name_key, id, source, estimated_store_count from w qualify row_number() over (partition by brand, replace(operator_name, ' ', '') order by estimated_store_count > 0 desc, estimated_store_count desc, case source when 'manual_megajii_2026_04_24' then 60 when 'pipeline' then 50 when 'jfa' then 40 else 0 end desc, corporate_number <> '' desc, head_office <> '' desc, source_url <> '' desc, note desc, id) = 1""")
def link_best_rows(s, d):
    """The strongest link of each brand and operator."""
    return master.best_links(_evidence_links(s, d), "id").select("brand", "name_key", "id", "source", "estimated_store_count")


@query(f"{_EVIDENCE_LINKS}, o as (select brand, operator_name, count(*) as n, count_if(operator_type = 'franchisor') as f, string_agg(note, '|' order by id) filter (where note like '%;%') as patched from (select brand, operator_name, id, case when brand = 'Brand#11' and operator_name = 'Operator#000000001' then 'franchisor' else operator_type end as operator_type, case when brand = 'Brand#11' and operator_name = 'Operator#000000001' then concat(note, '; by hand') else note end as note from el) group by 1, 2) select brand, operator_name, n, f, coalesce(patched, '') as patched from o")
def overridden_links(s, d):
    patch = s.createDataFrame([("Brand#11", "Operator#000000001", "franchisor", "by hand")], "brand string, operator_name string, operator_type string, note string")
    rows = master.overridden(_evidence_links(s, d), patch, ["operator_type"])
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.contains("note", F.lit(";")), F.struct("id", "note")))), lambda x: x["note"]), "|")
    return rows.groupBy("brand", "operator_name").agg(F.count("*").alias("n"), F.count_if(F.col("operator_type") == "franchisor").alias("f"), notes.alias("patched"))


@japanese(""", l as (select operator_id as link_id, case when operator_id % 9 = 0 then concat('お客', core) when operator_id % 4 = 0 then core else display end as name, case when operator_id % 3 = 0 then number else '' end as number, case when operator_id % 5 = 0 then 'jfa' else 'pipeline' end as source from jp_operators)
select link_id from l where source = 'pipeline' and (starts_with(name, 'お客') or (number = '' and lower(name) in (select lower(name) from l where source = 'pipeline' and number <> '')))""")
def garbage_link_ids(s, d):
    rows = jp.operators(s, d).selectExpr("operator_id as link_id", "case when operator_id % 9 = 0 then concat('お客', core) when operator_id % 4 = 0 then core else display end as operator_name", "case when operator_id % 3 = 0 then number else '' end as corporate_number", "case when operator_id % 5 = 0 then 'jfa' else 'pipeline' end as source")
    return master.garbage_links(rows)


_SOURCE_ROWS = ", r as (select operator_id as id, case when operator_id % 2 = 0 then 'A' else 'B' end as brand, display as name, case when operator_id % 4 = 0 then number else '' end as number, concat('https://s', operator_id % 3) as url, operator_id % 7 as n, case when operator_id % 3 = 0 then city else '' end as head, concat('店', operator_id % 5) as store from jp_operators)"


def _source_rows(s: SparkSession, d: str) -> DataFrame:
    return jp.operators(s, d).selectExpr("operator_id as id", "case when operator_id % 2 = 0 then 'A' else 'B' end as brand", "display as operator_name", "case when operator_id % 4 = 0 then number else '' end as corporate_number", "concat('https://s', operator_id % 3) as source_url", "'p' as parser", "'franchisee' as operator_type", "operator_id % 7 as estimated_store_count", "case when operator_id % 3 = 0 then city else '' end as head_office", "'' as prefecture", "array(concat('店', operator_id % 5)) as store_names")


@japanese(_SOURCE_ROWS + ", g as (select brand, case when number <> '' then number else name end as who, url, arg_min(name, id) as operator_name, coalesce(arg_min(case when number <> '' then number end, id), '') as corporate_number, coalesce(arg_min(case when head <> '' then head end, id), '') as head_office, max(n) as estimated_store_count, array_to_string(list_sort(list_distinct(list(store))), '|') as store_names from r group by 1, 2, 3) select brand, url as source_url, operator_name, corporate_number, head_office, estimated_store_count, store_names from g")
def merged_source_rows(s, d):
    out = master.merged_source_rows(_source_rows(s, d), "id")
    return out.select("brand", "source_url", "operator_name", "corporate_number", "head_office", "estimated_store_count", F.array_join(F.array_sort("store_names"), "|").alias("store_names"))


@japanese(_SOURCE_ROWS + " select brand, name as operator_name, greatest(n - 2, 0) as estimated_store_count, concat_ws('; ', nullif(head, ''), case when id % 2 = 0 then 'verified' end, concat('stores=', store), case when id % 5 = 0 then concat('address=', id) end) as note from r")
def source_row_links(s, d):
    """Links as they are written, with the parts of their notes that there are."""
    rows = _source_rows(s, d).withColumns({"estimated_store_count": F.col("estimated_store_count") - 2, "note": F.col("head_office"), "verification_status": F.expr("case when id % 2 = 0 then 'verified' end"), "store_address": F.expr("case when id % 5 = 0 then cast(id as string) else '' end")})
    return master.link_of_source_rows(rows, "official_franchisee_page").select("brand", "operator_name", "estimated_store_count", "note")


@japanese(", o as (select core as name, max(case when operator_id % 2 = 0 then prefecture end) as industry, max(city) as url from jp_operators where operator_id % 3 = 0 group by 1), n as (select core as name, arg_max(case when operator_id % 4 <> 0 then street end, operator_id) filter (where operator_id % 4 <> 0) as industry, arg_max(display, operator_id) as url from jp_operators where operator_id % 2 = 0 group by 1) select coalesce(o.name, n.name) as name, coalesce(n.industry, o.industry) as industry, coalesce(n.url, o.url) as url from o full join n on o.name = n.name")
def upserted_brands(s, d):
    """Filled values of new rows over the old ones, by name."""
    o = jp.operators(s, d)
    old = o.where("operator_id % 3 = 0").groupBy(F.col("core").alias("name")).agg(F.max(F.expr("case when operator_id % 2 = 0 then prefecture end")).alias("industry"), F.max("city").alias("url"))
    new = o.where("operator_id % 2 = 0").selectExpr("core as name", "case when operator_id % 4 <> 0 then street else '' end as industry", "display as url", "operator_id as seq")
    return master.overwritten(old, new, ["name"], ["industry", "url"], "seq")


@japanese(""", old as (select core as name, '' as num, min(city) as head from jp_operators where operator_id % 3 = 0 group by 1 union all select min(display), lpad((operator_id % 60)::varchar, 13, '0'), min(prefecture) from jp_operators where operator_id % 5 = 0 group by operator_id % 60),
nn as (select lpad((operator_id % 90)::varchar, 13, '0') as num, arg_max(core, operator_id) as name, arg_max(street, operator_id) as head from jp_operators where operator_id % 4 = 0 group by 1), np as (select core as name, arg_max(street, operator_id) as head from jp_operators where operator_id % 4 = 1 group by 1),
kn as (select * from old where num <> ''), bl as (select * from old where num = ''), met as (select coalesce(nn.name, kn.name) as name, kn.num, coalesce(nn.head, kn.head) as head from kn left join nn using (num)),
rest as (select *, num = min(num) over (partition by name) as taker from nn where num not in (select num from kn)), added as (select rest.name, rest.num, coalesce(rest.head, bl.head) as head from rest left join bl on rest.taker and rest.name = bl.name),
free as (select * from bl where name not in (select name from rest)), plain as (select coalesce(free.name, np.name) as name, '' as num, coalesce(np.head, free.head) as head from free full join np on free.name = np.name)
select name, num as corporate_number, head as head_office from met union all select name, num, head from added union all select * from plain""")
def upserted_operators(s, d):
    """By number, else by name among those without one, else added."""
    o = jp.operators(s, d)
    blank = o.where("operator_id % 3 = 0").groupBy(F.col("core").alias("name")).agg(F.lit("").alias("corporate_number"), F.min("city").alias("head_office"))
    known = o.where("operator_id % 5 = 0").groupBy(F.expr("lpad(cast(operator_id % 60 as string), 13, '0')").alias("corporate_number")).agg(F.min("display").alias("name"), F.min("prefecture").alias("head_office"))
    new = o.where("operator_id % 4 < 2").selectExpr("core as name", "case when operator_id % 4 = 0 then lpad(cast(operator_id % 90 as string), 13, '0') else '' end as corporate_number", "street as head_office", "operator_id as seq")
    return master.upsert_operators(blank.unionByName(known), new, ["head_office"], "seq").select("name", "corporate_number", "head_office")


@query("select case when coalesce(operation_type, case when is_franchise = 1 then 'franchisee' else 'direct' end) = 'franchisee' then coalesce(nullif(franchisee_name, ''), operator_name) else operator_name end as operator_name, place_id, coalesce(operation_type, case when is_franchise = 1 then 'franchisee' else 'direct' end) as operator_type, confidence from judgements")
def bridged_judgements(s, d):
    """Rows of operators and stores that judgements bring."""
    rows = domain.judgements(s, d).withColumns({"is_franchise": F.col("is_franchise") == 1, "franchisor_name": F.lit("")})
    return master.bridged(rows)


@query(f"{_EVIDENCE_LINKS}, c as (select *, case when corporate_number <> '' then corporate_number else lower(operator_name) end as who from el), b as (select who, count(distinct brand) as brands from c group by 1), x as (select who, estimated_store_count, count(*) as same from c group by all) select id, brands as scope_brands, case when source = 'manual_megajii_2026_04_24' and brands > 1 and same > 1 then 'operator_total_repeated_not_brand_specific' when source = 'manual_megajii_2026_04_24' then 'operator_declared_total_single_brand_or_unverified_basis' else 'source_estimated_or_store_matched_count' end as count_basis from c join b using (who) join x using (who, estimated_store_count)")
def link_count_basis(s, d):
    return master.count_basis(_evidence_links(s, d), "manual_megajii_2026_04_24").select("id", F.col("scope_brands").cast("long").alias("scope_brands"), "count_basis")


@query(", p as (select brand, count(*) as rows, count_if(operator_type = 'franchisee') as franchisees, count_if(operator_type = 'franchisor') as franchisors, count_if(operator_type = 'franchisee' and corporate_number <> '') as verified, max(estimated_store_count) as max_count from links group by 1), s as (select distinct p_brand as brand from part union select 'Brand#99') select brand, coalesce(rows, 0) as rows, coalesce(franchisees, 0) as franchisees, coalesce(franchisors, 0) as franchisors, coalesce(verified, 0) as verified, coalesce(max_count, 0) as max_count, case when rows is null then 'seed_only' when franchisees = 0 then 'franchisor_only' when verified = 0 then 'unverified' else 'evidenced' end as status from s left join p using (brand)")
def brand_summaries(s, d):
    seeds = read(s, d, "part").select(F.col("p_brand").alias("brand")).unionByName(s.createDataFrame([("Brand#99",)], "brand string"))
    return master.brand_summary(seeds, _links(s, d))


@query(", s as (select distinct brand from links where brand < 'Brand#3') select brand, false as from_links from s union all select brand, true from (select distinct brand from links where operator_type = 'franchisee') where brand not in (select brand from s)")
def appended_brands(s, d):
    links = _links(s, d)
    seeds = links.where("brand < 'Brand#3'").select("brand").distinct()
    return master.appended_brands(seeds, links, text.brand_match_key("brand")).select("brand", "from_links")


@query("""select brand, count(*) as rows, count_if(corporate_number <> '') as verified, sum(estimated_store_count)::bigint as sum_count, max(estimated_store_count) as max_count, arg_min(operator_name, (-estimated_store_count, operator_name)) as largest_operator,
case when count_if(corporate_number <> '') = count(*) then 'all_verified' when count_if(corporate_number <> '') > 0 then 'partly_verified' else 'unverified' end as basis from links group by 1""")
def all_brand_index(s, d):
    return views.brand_index(_links(s, d))


# -- consolidation and the master table ------------------------------------------------------------------

_SPELT = """, sp as (select operator_id as id, case when operator_id % 2 = 0 then core else concat(substr(core, 1, 2), ' ', substr(core, 3)) end as name, case when operator_id % 3 = 0 then lpad((operator_id % 400)::varchar, 13, '0') else '' end as num, concat('B', operator_id % 4) as brand, operator_id % 9 as n from jp_operators),
pr as (select distinct name as node, concat('n:', replace(name, ' ', '')) as key from sp union select distinct name, concat('c:', num) from sp where num <> ''), ed as (select distinct a.node as a, b.node as b from pr a join pr b using (key)), rc(a, b) as (select a, b from ed union select rc.a, ed.b from rc join ed on rc.b = ed.a), cm as (select a as node, min(b) as comp from rc group by 1)"""


def _spelt(s: SparkSession, d: str) -> DataFrame:
    return jp.operators(s, d).selectExpr("operator_id as id", "case when operator_id % 2 = 0 then core else concat(substr(core, 1, 2), ' ', substr(core, 3)) end as operator_name", "case when operator_id % 3 = 0 then lpad(cast(operator_id % 400 as string), 13, '0') else '' end as corporate_number", "concat('B', operator_id % 4) as brand", "operator_id % 9 as estimated_store_count")


@japanese(_SPELT + ", pb as (select comp, brand, max(n) as n from sp join cm on cm.node = sp.name group by all), nm as (select comp, string_agg(distinct name, ' / ' order by name) as names, max(num) as corporate_number from sp join cm on cm.node = sp.name group by 1) select pb.comp, sum(n)::bigint as total_stores, count(*) as brand_count, any_value(names) as names, any_value(corporate_number) as corporate_number from pb join nm using (comp) group by 1", recursive=True)
def consolidated_operators(s, d):
    """Operators that share a number, or a name without blanks, however indirectly."""
    return components.consolidate(_spelt(s, d))


@japanese(_SPELT + ", nb as (select comp, min(case when num <> '' then concat('CORP::', num) end) as bucket from sp join cm on cm.node = sp.name group by 1) select id, bucket from sp join cm on cm.node = sp.name join nb using (comp) where bucket is not null", recursive=True)
def operator_buckets(s, d):
    """The bucket of each row that has one with a corporate number; names without blanks, as the canonical key keeps blanks."""
    rows = _spelt(s, d).withColumn("operator_name", F.replace("operator_name", F.lit(" "), F.lit("")))
    return master.bucketed(rows).where(F.startswith("bucket", F.lit("CORP::"))).select("id", "bucket")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """Links, stores of the pipeline and stores of recruitment pages, a row each; a bucket is an operator's name."""
    links = _links(s, d).selectExpr("operator_name as bucket", "operator_name", "corporate_number", "brand", "'link' as kind", "cast(null as bigint) as store_id", "estimated_store_count as store_count", "case when brand = 'Brand#11' then estimated_store_count * 9 end as reported_total", "case when brand = 'Brand#22' then 3L end as reported_brands", "operator_type as operator_kind", "source", "concat('https://l/', brand) as source_url")
    pipe = _os(s, d).selectExpr("operator_name as bucket", "operator_name", "corporate_number", "brand", "'pipeline' as kind", "place_id as store_id", "case when place_id % 50 = 0 then 'flag' end as risk_flag", "concat('s', place_id % 3) as sample_store")
    found = domain.judgements(s, d).where("operation_type = 'franchisee'").selectExpr("operator_name as bucket", "operator_name", "'Brand#11' as brand", "'recruitment' as kind", "place_id as store_id", "case when place_id % 4 = 0 then 'https://r' end as url", "'seen' as evidence_status", "place_id % 40 = 0 as accepted")
    out = links.unionByName(pipe, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    for c in ("priority_rank", "priority_tier", "quality_tier", "sample_url", "note"):
        out = out.withColumn(c, F.when(F.col("bucket").endswith("7"), F.concat(F.lit(c[:2]), F.col("brand"))) if c == "note" else F.lit(None).cast("string"))
    return out


_EVIDENCE = """, ev as (select operator_name as bucket, brand, 'link' as kind, null::bigint as sid, estimated_store_count as n, case when brand = 'Brand#11' then estimated_store_count * 9 end as rt, case when brand = 'Brand#22' then 3 end as rb, operator_type as ok, corporate_number as num, null as flag, null as url, source, concat('https://l/', brand) as surl, null as sample, null as es, null as acc from links
  union all select operator_name, brand, 'pipeline', place_id, null, null, null, null, corporate_number, case when place_id % 50 = 0 then 'flag' end, null, null, null, concat('s', place_id % 3), null, null from operator_stores
  union all select operator_name, 'Brand#11', 'recruitment', place_id, null, null, null, null, null, null, case when place_id % 4 = 0 then 'https://r' end, null, null, null, 'seen', place_id % 40 = 0 from judgements where operation_type = 'franchisee'),
bc as (select bucket, brand, greatest(coalesce(max(n), 0), count(distinct case when kind = 'pipeline' then sid end), count(distinct case when kind = 'recruitment' then sid end)) as n from ev group by all),
tt as (select bucket, greatest(coalesce(max(rt), 0), (select sum(n) from bc where bc.bucket = ev.bucket), count(distinct case when kind = 'pipeline' then sid end), count(distinct case when kind = 'recruitment' then sid end))::bigint as total_stores, greatest(coalesce(max(rb), 0), (select count(*) from bc where bc.bucket = ev.bucket), count(distinct case when kind = 'pipeline' then brand end), count(distinct case when kind = 'recruitment' then brand end))::bigint as brand_count from ev group by 1)"""


@query(f"{_EVIDENCE} select * from tt")
def master_totals(s, d):
    """Operators of any evidence appear, of whichever side."""
    return master.totals(_evidence(s, d))


def _sets(brand: str) -> str:
    t = brand.replace("#", "_").lower()
    one = lambda c, n: f"coalesce(string_agg(distinct {c}, ' / ' order by {c}) filter (where brand = '{brand}' and coalesce({c}, '') <> ''), '') as {n}_{t}"
    return ", ".join([f"coalesce(max(case when brand = '{brand}' then bn end), 0) as stores_{t}", f"'' as rank_{t}", f"'' as tier_{t}", f"'' as quality_{t}", one("es", "evidence"), one("flag", "risk"), one("source", "sources"), one("surl", "source_urls"), one("sample", "sample_stores"), f"'' as sample_urls_{t}", f"coalesce(max(case when brand = '{brand}' and bucket like '%7' then concat('no', brand) end), '') as notes_{t}"])


@query(f"""{_EVIDENCE}, fx as (select bucket, max(coalesce(num, '')) <> '' as has, bool_or(coalesce(ok, '') = 'franchisor') as hq, bool_or(flag is not null) as fl, bool_or(coalesce(acc, false)) as ac, bool_or(url is not null) as ur, min(nullif(num, '')) as num, string_agg(distinct num, ' / ' order by num) filter (where num <> '') as nums, len(list_distinct(list(url) || list(surl))) as urls, {', '.join(_sets(b) for b in _TWO)} from (select ev.*, bc.n as bn from ev join bc using (bucket, brand)) group by 1),
q as (select tt.*, fx.* exclude (bucket), case when has or ac then 'A_houjin_verified' when ur then 'C_candidate_unverified' else 'D_pipeline_only_unverified_review' end as best from tt join fx using (bucket) where total_stores >= 2)
select bucket, bucket as operator_name, total_stores, brand_count, best as quality_best_tier, case when total_stores >= 100 then 'P0_100plus' when total_stores >= 50 then 'P1_50plus' when total_stores >= 20 then 'P2_20plus' when total_stores >= 10 then 'P3_10plus' else 'P4_2plus' end as priority_segment, case when hq then 'franchisor_or_direct_review' when fl then 'review_required' when best like 'D%' then 'pipeline_review' when not has then 'unverified_review' else 'verified' end as risk_level, coalesce(num, '') as primary_corporate_number, coalesce(nums, '') as corporate_numbers,
  case when fl then 'flag' else '' end as risk_flags_all, {', '.join(f"{n}_{b.replace('#', '_').lower()}" for b in _TWO for n in ('stores', *master.SETS))}, (select string_agg(concat(brand, ':', n), ';' order by -n, brand) from bc where bc.bucket = q.bucket) as brands_breakdown,
  row_number() over (order by total_stores desc, brand_count desc, case substr(best, 1, 1) when 'A' then 40 when 'C' then 20 else 10 end desc, bucket) as company_priority_rank from q""")
def master_rows(s, d):
    """The master table with eleven columns for each of two brands."""
    return master.master_rows(_evidence(s, d), _TWO).drop("all_evidence_url_count", "all_evidence_urls")


@query(f"{_EVIDENCE} select *, 'operator_total_stores_est_below_260' as exclude_reason from tt where total_stores < 260")
def excluded_operators(s, d):
    return master.excluded_rows(_evidence(s, d), 260)


@query(f"{_EVIDENCE} select bucket, len(list_distinct(list(url) || list(surl))) as all_evidence_url_count, array_to_string(list_sort(list_distinct(list_filter(list(url) || list(surl), lambda x: x is not null))), ' / ') as all_evidence_urls from ev group by 1")
def evidence_urls(s, d):
    """The union of all URLs that speak for an operator."""
    return master.master_rows(_evidence(s, d), _TWO, least=0).select("bucket", F.col("all_evidence_url_count").cast("long").alias("all_evidence_url_count"), "all_evidence_urls")


# -- stores and audits -----------------------------------------------------------------------------------


@query("select place_id, brand, confidence, row_number() over (order by place_id) as nth from operator_stores where operator_name = 'Operator#000000007'")
def stores_of_operator(s, d):
    rows = stores.by_operator(_os(s, d), "Operator#000000007", "place_id").select("place_id", "brand", "confidence")
    return positioned(rows, [F.asc("place_id")], "nth")


@query(", n as (select place_id, count(operator_name) as links from operator_stores group by 1) select official_url, arg_min(place_id, (-coalesce(links, 0), not starts_with(place_id::varchar, '7'), place_id)) as place_id, max(coalesce(links, 0)) as links from stores left join n using (place_id) where official_url <> '' group by 1")
def best_places_of_urls(s, d):
    return stores.best_place_of_url(domain.stores(s, d), _os(s, d), "7")


@query("select place_id, phone from stores where official_url <> '' and place_id not in (select place_id from operator_stores where discovered_via = 'per_store' and operator_type = 'franchisee')")
def enrichment_candidates(s, d):
    return stores.enrichment_candidates(domain.stores(s, d), _os(s, d)).select("place_id", "phone")


@query("select place_id, brand from stores where brand in ('Brand#11', 'Brand#23') and official_url <> '' and place_id not in (select place_id from operator_stores where operator_name <> '' and operator_type not in ('franchisor', 'direct') and corporate_number <> '')")
def page_research_targets(s, d):
    return stores.page_research_targets(domain.stores(s, d), _os(s, d), ["Brand#11", "Brand#23"]).select("place_id", "brand")


@query("select operator_type, count(*) as n from (select case when brand = 'Brand#11' and operator_name in ('Operator#000000001', 'Operator#000000002', 'Operator#000000003') then 'franchisor' else operator_type end as operator_type from operator_stores) group by 1")
def marked_masters(s, d):
    return stores.marked_masters(_os(s, d), "Brand#11", [f"Operator#00000000{i}" for i in (1, 2, 3)]).groupBy("operator_type").agg(F.count("*").alias("n"))


@query(", m as (select place_id as old, place_id - place_id % 10 as new from stores where place_id % 10 in (1, 2)), c as (select operator_name, new as place_id from operator_stores join m on m.old = place_id where old <> new) select operator_name, place_id from operator_stores union select operator_name, place_id from c")
def remapped_operator_stores(s, d):
    st = domain.stores(s, d)
    mapping = st.where("place_id % 10 in (1, 2)").select(F.col("place_id").alias("old"), (F.col("place_id") - F.col("place_id") % 10).alias("new"))
    return stores.remapped(_os(s, d), mapping).select("operator_name", "place_id")


@query(", f as (select place_id from stores where lat < 33), h as (select place_id from stores where place_id in (select place_id from f) and contains(prefecture, '_1')) select operator_name, count(distinct place_id) as stores from operator_stores where place_id in (select place_id from h) group by 1")
def operators_of_found_stores(s, d):
    st = domain.stores(s, d)
    return stores.operators_of_found(st.where("lat < 33").select("place_id"), st, _os(s, d), F.contains("prefecture", F.lit("_1")))


_MAP = """, old as (select place_id, brand, lat, lng from stores where place_id % 3 <> 0), new as (select case when place_id % 15 = 0 then place_id + 1 else place_id end as place_id, brand, lat + 0.0004 * (place_id % 4) as lat, lng from stores where place_id % 3 = 0),
o as (select * from new where place_id not in (select place_id from old)), d as (select o.* from o where not exists (select 1 from old b where b.brand = o.brand and sqrt(pow((b.lng - o.lng) * 111320.0 * cos(radians((o.lat + b.lat) / 2)), 2) + pow((b.lat - o.lat) * 110540.0, 2)) <= 120))"""


@query(f"{_MAP}, p as (select a.place_id as a, b.place_id as b from d a join d b on a.brand = b.brand and a.place_id < b.place_id and sqrt(pow((b.lng - a.lng) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 110540.0, 2)) <= 120) select place_id, brand from d where place_id not in (select b from p where a not in (select b from p))")
def new_map_stores(s, d):
    """Stores of a map that are none of the known ones, nor of each other."""
    st = domain.stores(s, d)
    found = st.where("place_id % 3 = 0").selectExpr("case when place_id % 15 = 0 then place_id + 1 else place_id end as place_id", "brand", "lat + 0.0004D * (place_id % 4) as lat", "lng")
    return stores.new_map_stores(found, st.where("place_id % 3 <> 0")).select("place_id", "brand")


_AUDIT = ", r as (select operator_name, case when operator_name like '%3' then 0 else count(*) end as registered from operator_stores group by 1), t as (select operator_name, place_id as top_id from operator_stores where operator_name not like '%5'), m as (select place_id as top_id, place_id as bottom_id from stores where place_id % 3 = 0)"


@query(f"{_AUDIT}, x as (select operator_name, count(distinct t.top_id) as found, count(distinct m.bottom_id) as matched from t left join m using (top_id) group by 1) select operator_name, registered, coalesce(found, 0) as found, coalesce(matched, 0) as matched, case when registered > 0 then round(coalesce(matched, 0) * 100.0 / registered, 2) else 0 end::double as coverage_pct, found is null as missing from r left join x using (operator_name)")
def audited_operators(s, d):
    """Coverage of registered operators; missing ones are those that a search does not find."""
    coverage, _, missing = stores.audit(*_audit_tables(s, d))
    return coverage.join(missing.withColumn("missing", F.lit(True)), "operator_name", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


def _audit_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    os, st = _os(s, d), domain.stores(s, d)
    registered = os.groupBy("operator_name").agg(F.count("*").alias("registered")).withColumn("registered", F.when(F.col("operator_name").endswith("3"), 0).otherwise(F.col("registered")))
    top = os.where(~F.col("operator_name").endswith("5")).select("operator_name", F.col("place_id").alias("top_id"))
    matched = st.where("place_id % 3 = 0").select(F.col("place_id").alias("top_id"), F.col("place_id").alias("bottom_id"))
    return registered, top, matched, st.select("place_id", "name")


@query("select place_id, name from stores where place_id % 3 <> 0")
def unclaimed_stores(s, d):
    return stores.audit(*_audit_tables(s, d))[1]


@query(""", c as (select operator_name, brand, place_id, concat('S', place_id % 40) as store, concat('u', place_id % 9) as url, case place_id % 4 when 0 then 'evidence_rejected' when 1 then 'houjin_no_exact_match' when 2 then 'blocked_franchisor:x' else '' end as why, confidence::double as conf, false as acc, '' as num from operator_stores where operator_type = 'unknown' and place_id % 4 <> 2 or operator_name like '%9' and operator_type = 'unknown'),
a as (select operator_name, 'Brand#11' as brand, place_id, concat('S', place_id % 40) as store, null as url, '' as why, 0.0 as conf, true as acc, place_id::varchar as num from judgements where operation_type = 'franchisee' and place_id % 5 = 0), u as (select * from c union all select * from a),
w as (select operator_name, why, count(*) as n from u where why <> '' group by all), y as (select operator_name, string_agg(concat(why, ':', n), ' / ' order by -n, why) as reject_reasons from w group by 1),
g as (select operator_name, count(distinct brand) as brand_count, string_agg(distinct brand, ' / ' order by brand) as brands, count(distinct place_id) as candidate_stores, count(distinct url) as candidate_urls, count(distinct case when acc then place_id end) as accepted_stores, round(max(conf), 2) as max_confidence, count_if(starts_with(why, 'blocked')) as blocked_rows, array_to_string(list_sort(list_distinct(list(store)))[1:6], ' / ') as sample_stores from u group by 1)
select g.*, coalesce(reject_reasons, '') as reject_reasons, case when operator_name like '%4' or blocked_rows > 0 then 'franchisor_or_hq_candidate' when accepted_stores > 0 then 'verified' else 'candidate_unverified' end as status from g left join y using (operator_name)""")
def recruitment_ranking(s, d):
    os = _os(s, d)
    c = os.where("operator_type = 'unknown' and (place_id % 4 <> 2 or operator_name like '%9')").selectExpr("operator_name", "brand", "place_id", "concat('S', place_id % 40) as store_name", "concat('u', place_id % 9) as url", "'page' as source_type", "case place_id % 4 when 0 then 'evidence_rejected' when 1 then 'houjin_no_exact_match' when 2 then 'blocked_franchisor:x' else '' end as reject_reason", "cast(confidence as double) as confidence")
    a = domain.judgements(s, d).where("operation_type = 'franchisee' and place_id % 5 = 0").selectExpr("operator_name", "'Brand#11' as brand", "place_id", "concat('S', place_id % 40) as store_name", "cast(place_id as string) as corporate_number")
    hq = os.where("operator_name like '%4'").select(F.col("operator_name").alias("name")).distinct()
    out = stores.recruitment_ranking(c, a, hq)
    return out.select("operator_name", *[F.col(c).cast("long").alias(c) for c in ("brand_count", "candidate_stores", "candidate_urls", "accepted_stores", "blocked_rows")], "brands", "max_confidence", "sample_stores", "reject_reasons", "status")


@query(""", dl as (select operator_name, corporate_number, case when brand < 'Brand#3' then concat(repeat('x', (estimated_store_count % 5)::int), brand) else '' end as head, case when brand like '%1' then brand else '' end as web, case when brand like '%3' then '東京都' else '' end as pref, brand, operator_type, estimated_store_count as n from links where operator_type not in ('franchisor', 'direct') and operator_name not like '%8'),
g as (select case when corporate_number <> '' then corporate_number else concat('NAME::', operator_name) end as who, * from dl), i as (select who, min(operator_name) as operator_name, max(corporate_number) as num, arg_min(head, (-length(head), brand)) as head, coalesce(arg_min(case when web <> '' then web end, brand) filter (where web <> ''), '') as website, coalesce(max(pref), '') as pref from g group by 1),
p as (select who, brand, max(n) as n from g group by all), s as (select who, count(*) as brand_count, sum(n)::bigint as total_stores from p group by 1)
select i.operator_name, num as corporate_number, head as head_office, website, case when pref <> '' then pref else coalesce(r.prefecture, '') end as prefecture, brand_count, total_stores from i join s using (who) left join registry r on r.corporate_number = num""")
def operator_directory(s, d):
    """Operators with the longest head office and the first filled website."""
    links = _links(s, d).selectExpr("operator_name", "corporate_number", "case when brand < 'Brand#3' then concat(repeat('x', cast(estimated_store_count % 5 as int)), brand) else '' end as head_office", "case when brand like '%1' then brand else '' end as website", "case when brand like '%3' then '東京都' else '' end as prefecture", "brand", "operator_type", "estimated_store_count", "brand as seq")
    blocked = _links(s, d).where("operator_name like '%8'").select(F.col("operator_name").alias("name")).distinct()
    return stores.directory(links, domain.registry(s, d), blocked=blocked).drop("brands")


@query(f"{_EVIDENCE_LINKS} select operator_name, brand, max(estimated_store_count) as stores, string_agg(distinct source, ' / ' order by source) as sources, coalesce(string_agg(distinct source_url, ' / ' order by source_url) filter (where source_url <> ''), '') as source_urls, count(*) as n from el group by 1, 2")
def directory_components(s, d):
    links = _evidence_links(s, d)
    return stores.directory_components(links).drop("notes").join(links.groupBy("operator_name", "brand").agg(F.count("*").alias("n")), ["operator_name", "brand"])


@query(""", a as (select place_id as id, case place_id % 3 when 0 then 'Brand#11' else brand end as brand, concat('https://www.example', place_id % 4, '.com') as site, case place_id % 5 when 0 then 'https://other.example/a' when 1 then concat('https://example', place_id % 4, '.com/news/1') else concat('https://www.example', place_id % 4, '.com/b#x') end as href, case when place_id % 7 = 0 then '採用情報' else 'menu' end as label, operator_hint as operator from stores),
e as (select distinct operator_name as operator, brand from operator_stores), o as (select distinct operator, brand, site, replace(href, '#x', '') as href, label from a), f as (select * from o qualify row_number() over (partition by operator, brand, href, site order by label) = 1)
select f.operator, f.brand, f.site, f.href, case when e.operator is not null then 'existing_link' when contains(f.href, 'other.') then 'external_link_review' when label = '採用情報' or contains(f.href, 'news') then 'review_link_not_auto_applied' else 'accepted' end as status from f left join e using (operator, brand)""")
def reviewed_brand_links(s, d):
    st = domain.stores(s, d)
    anchors = st.selectExpr("operator_hint as operator", "concat('https://www.example', place_id % 4, '.com') as site", "concat('https://www.example', place_id % 4, '.com') as page_url", "case place_id % 3 when 0 then 'Brand#11' else brand end as brand", "case place_id % 5 when 0 then 'https://other.example/a' when 1 then concat('https://example', place_id % 4, '.com/news/1') else concat('https://www.example', place_id % 4, '.com/b#x') end as href", "case when place_id % 7 = 0 then '採用情報' else 'menu' end as label")
    existing = _os(s, d).select(F.col("operator_name").alias("operator"), "brand")
    return stores.reviewed_brand_links(anchors, existing).select("operator", "brand", "site", "href", "status")


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
_BRANDS = [("Brand#11", "wide", None, None, None), ("Brand#22", "wide", 3000.0, None, 9000.0), ("Brand#33", "none", None, None, 500.0)]


@query(f", t(brand, least, most) as (values ('Brand#11', 1500.0, 12000.0), ('Brand#22', 3000.0, 9000.0), ('Brand#33', 0.0, 500.0)), x as (select place_id as id, brand, lat, lng from stores), p as (select a.id as a_id, b.id as b_id, a.brand, {_HAV} as m from x a join x b on a.brand = b.brand and a.id < b.id) select a_id, b_id, p.brand, case when m < coalesce(least, 50) then 'DUPLICATE' when m <= coalesce(most, 2000) then 'DOMINANT' else 'INDEPENDENT' end as relation from p left join t using (brand) where m <= 12000")
def territory_pairs(s, d):
    """Pairs of a brand's stores by the brand's own distances, or its industry's."""
    industries = s.createDataFrame([("wide", "territory", 1500.0, 5000.0, 12000.0)], "industry string, strategy string, dominant_min_m double, dominant_typical_m double, territory_max_m double")
    brands = s.createDataFrame(_BRANDS, "brand string, industry string, dominant_min_m double, dominant_typical_m double, territory_max_m double")
    st = domain.stores(s, d).withColumnRenamed("place_id", "id")
    return matching.classify_pairs(st, radii=matching.territories(brands, industries))


@query("select * from (values ('Brand#11', 'wide', 'territory', 1500.0::double, 5000.0::double, 12000.0::double), ('Brand#22', 'wide', 'territory', 3000.0, 5000.0, 9000.0), ('Brand#33', 'none', 'unknown', 0.0, 0.0, 500.0)) t(brand, industry, strategy, dominant_min_m, dominant_typical_m, territory_max_m)", plain=True)
def brand_territories(s, d):
    industries = s.createDataFrame([("wide", "territory", 1500.0, 5000.0, 12000.0)], "industry string, strategy string, dominant_min_m double, dominant_typical_m double, territory_max_m double")
    return matching.territories(s.createDataFrame(_BRANDS, "brand string, industry string, dominant_min_m double, dominant_typical_m double, territory_max_m double"), industries)


@query(", a as (select distinct operator_name, brand from arrivals where seq = 1), s as (select operator_name, string_agg(distinct brand, ' / ' order by brand) as brands from operator_stores group by 1) select a.operator_name, a.brand, contains(concat(' / ', s.brands, ' / '), concat(' / ', a.brand, ' / ')) as known from a join s using (operator_name)")
def known_brands(s, d):
    """Whether an operator's brand is among those that it has already."""
    have = _os(s, d).groupBy("operator_name").agg(F.collect_set("brand").alias("brands"))
    asked = domain.arrivals(s, d).where("seq = 1").select("operator_name", "brand").distinct()
    return asked.join(have, "operator_name").select("operator_name", "brand", F.array_contains("brands", F.col("brand")).alias("known"))


@query("select place_id, name from stores where brand = 'Brand#23' and official_url <> '' order by name, place_id limit 30")
def research_stores(s, d):
    return stores.research_stores(domain.stores(s, d), "Brand#23", 30).select("place_id", "name")


@query("select place_id, brand, name, address, lat, lng, official_url from stores where brand = 'Brand#41'")
def bottom_up_stores(s, d):
    st = domain.stores(s, d).withColumn("official_url", F.expr("nullif(official_url, '')"))
    return stores.bottom_up(st, "Brand#41")


_TRUTH = ", t as (select operator_name, brand from arrivals where discovered_via = 'per_store' and seq <= 2), f as (select operator_name, brand from arrivals where discovered_via = 'chain_discovery' and seq >= 5)"


def _truth(part: str, name: str) -> str:
    return f"select '{part}' as part, count(*) as truth, count_if(hit) as hits, round(count_if(hit) / count(*), 4) as recall, coalesce(array_to_string((list(name order by name) filter (where not hit))[1:20], ' | '), '') as misses from (select {name} as name, bool_or({name} in (select {name} from f)) as hit from t group by 1)"


@query(f"{_TRUTH} {_truth('brand', 'brand')} union all {_truth('operator', 'operator_name')} union all " + _truth("link", "concat_ws('/', operator_name, brand)"))
def truth_report(s, d):
    """How much of a truth is found, by brand, operator and link, with what is missed."""
    a = domain.arrivals(s, d)
    return audit.truth_report(a.where("discovered_via = 'per_store' and seq <= 2"), a.where("discovered_via = 'chain_discovery' and seq >= 5"), {"brand": ["brand"], "operator": ["operator_name"], "link": ["operator_name", "brand"]})


@query(", f as (select prefecture, count(*) as found from stores where official_url = '' group by 1), r as (select prefecture, count(*) as n from stores where phone = '' group by 1) select coalesce(sum(found), 0)::bigint as found, sum(n)::bigint as n, round(coalesce(sum(found), 0) / sum(n), 3) as recall from r left join f using (prefecture) where n > 0")
def overall_recall(s, d):
    st = domain.stores(s, d)
    return audit.overall_recall(st.where("official_url = ''").groupBy("prefecture").agg(F.count("*").alias("n")), st.where("phone = ''").groupBy("prefecture").agg(F.count("*").alias("n")), "prefecture")
