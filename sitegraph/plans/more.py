"""Further registered queries: consolidation, filters, rankings, sets and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import components, evidence, extract, matching, writes
from ..streaming import events as streams
from . import domain
from .catalog import _ANCHOR, _links, _os, query
from .domain import read


@query(""", p as (select operator_hint as node, official_url as key from stores where official_url <> ''),
e as (select distinct a.node as a, b.node as b from p a join p b using (key)), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select a as node, min(b) as comp from r group by a""", recursive=True)
def connected_operators(s, d):
    st = domain.stores(s, d).where("official_url <> ''")
    return components.components(st.select(F.col("operator_hint").alias("node"), F.col("official_url").alias("key")))


@query(""", k as (select place_id, name, official_url, lower(translate(name, ' -', '')) as key, 'brand#25' as want from stores),
j as (select *, (select count(*) from (select unnest(list_transform(range(1, length(key)), lambda i: key[i:i + 1])) intersect select unnest(list_transform(range(1, length(want)), lambda i: want[i:i + 1])))) as c, len(list_distinct(list_transform(range(1, length(key)), lambda i: key[i:i + 1]))) as ka, len(list_distinct(list_transform(range(1, length(want)), lambda i: want[i:i + 1]))) as kb from k),
s as (select *, case when contains(key, want) or contains(want, key) then 1.0 else greatest(c / (ka + kb - c), 1 - levenshtein(key, want) / greatest(length(key), length(want))) end as alike from j)
select decision, count(*) as n from (select case when contains(official_url, 'example7.') then 'foreign_domain' when contains(name, 'Brand#25') then 'substring' when contains(key, want) then 'normalized' when alike >= 0.85 then 'similar' when alike < 0.2 then 'unlike' when starts_with(key, 'brand') then 'prefix' when contains(key, 'nation_3') then 'conflict' else 'default' end as decision from s) group by 1""")
def strict_brand_filter(s, d):
    return extract.brand_filter(domain.stores(s, d), "Brand#25", ["example7."], ["NATION_3"]).groupBy("decision").agg(F.count("*").alias("n"))


@query("select case when row_number() over (partition by official_url order by place_id) > 1 then 'duplicate' when brand not in ('Brand#11', 'Brand#12') then 'brand' when lat < 35 then 'outside' else 'kept' end as reason, count(*) as n from stores where official_url <> '' group by 1".replace("select case", "select reason, count(*) as n from (select case").replace("end as reason, count(*) as n from stores where official_url <> '' group by 1", "end as reason from stores where official_url <> '') group by 1"))
def search_metrics(s, d):
    from pyspark.sql import Window

    st = domain.stores(s, d).where("official_url <> ''").withColumn("r", F.row_number().over(Window.partitionBy("official_url").orderBy("place_id")))
    reason = F.when(F.col("r") > 1, "duplicate").when(~F.col("brand").isin("Brand#11", "Brand#12"), "brand").when(F.col("lat") < 35, "outside").otherwise("kept")
    return st.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(", y as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by all), r as (select *, row_number() over (partition by o_custkey order by y desc) as r from y) select o_custkey, max(case when r = 1 then y end) as year_1, max(case when r = 1 then n end) as n_1, max(case when r = 2 then y end) as year_2, max(case when r = 2 then n end) as n_2 from r where r <= 2 group by 1")
def latest_year_pair(s, d):
    from pyspark.sql import Window

    y = read(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    r = y.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("y")))).where("r <= 2")
    return r.groupBy("o_custkey").agg(*[F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{n}_{k}") for k in (1, 2) for c, n in (("y", "year"), ("n", "n"))])


@query("select operator_name, string_agg(distinct brand, ' / ' order by brand) as brands from operator_stores group by 1")
def joined_values(s, d):
    return _os(s, d).groupBy("operator_name").agg(text.join_values(F.collect_list("brand")).alias("brands"))


@query("select place_id, name from stores order by name, place_id limit 50 offset 100")
def limit_offset(s, d):
    return domain.stores(s, d).select("place_id", "name").orderBy("name", "place_id").offset(100).limit(50)


@query(", t as (select distinct operator_name, brand from arrivals where discovered_via = 'per_store'), f as (select distinct operator_name, brand from arrivals where discovered_via = 'chain_discovery') select 'both' as part, count(*) as n from (select * from t intersect select * from f) union all select 'truth_only', count(*) from (select * from t except select * from f) union all select 'found_only', count(*) from (select * from f except select * from t)")
def key_sets(s, d):
    a = domain.arrivals(s, d)
    t, f = (a.where(F.col("discovered_via") == v).select("operator_name", "brand").distinct() for v in ("per_store", "chain_discovery"))
    side = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["operator_name", "brand"], "full")
    got = side.agg(F.count_if(F.expr("t = 1 and f = 1")).alias("both"), F.count_if(F.col("f").isNull()).alias("truth_only"), F.count_if(F.col("t").isNull()).alias("found_only"))
    return got.unpivot([], ["both", "truth_only", "found_only"], "part", "n")


@query(", u as (select operator_name, min(corporate_number) as known from arrivals where corporate_number <> '' group by 1 having count(distinct corporate_number) = 1) select place_id, j.operator_name, coalesce(u.known, '') as corporate_number from judgements j left join u using (operator_name)")
def hydrate_numbers(s, d):
    rows = domain.judgements(s, d).select("place_id", "operator_name", F.lit("").alias("corporate_number"))
    known = domain.arrivals(s, d).where("corporate_number <> ''").select("operator_name", "corporate_number")
    return matching.hydrate(rows, known, "operator_name", "corporate_number").select("place_id", "operator_name", "corporate_number")


@query(f"""with l as (select page_id, unnest(range(len(h))) as pos, unnest(h) as href, unnest(t) as label from (select page_id, regexp_extract_all(html, {_ANCHOR}, 1) as h, regexp_extract_all(html, {_ANCHOR}, 2) as t from pages)),
s as (select *, round((case when contains(lower(label), 'the') then 0.5 else 0 end) + (case when contains(lower(label), 'an') then 0.2 else 0 end) + (case when contains(lower(href), 'er') then 0.3 else 0 end), 4)::double as score from (select page_id, pos, href, trim(regexp_replace(label, '<[^>]+>', '', 'g')) as label from l))
select page_id, max(score) as score, arg_min(href, (-score, pos)) as href from s where score >= 0.3 group by 1""", plain=True)
def best_page_link(s, d):
    return extract.best_link(evidence.links(read(s, d, "pages")), {"the": 0.5, "an": 0.2}, {"er": 0.3}, 0.3)


@query()
def layered_store_match(s, d):
    st = domain.stores(s, d).select(F.col("place_id").alias("id"), "prefecture", F.regexp_extract("address", r"City\d+", 0).alias("city"), "address", "lat", "lng")
    moved = st.where("id % 3 <> 0").withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10**9))
    return matching.layered_match(st, moved, 0.95, 50.0).groupBy("layer").agg(F.count("*").alias("n"))


@query("select w as start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 30 minute, ts::timestamp), time_bucket(interval 30 minute, ts::timestamp) - interval 30 minute]) as w from events) group by all", plain=True)
def stream_sliding(s, d):
    rows = streams.file_stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.windowed(rows, "1 hour", "30 minutes"), "sliding", "complete").select("start", "event_type", "n")


@query("with g as (select user_id, ts::timestamp as ts, case when lag(ts::timestamp) over (partition by user_id order by ts) + interval 30 minute > ts::timestamp then 0 else 1 end as head from events), k as (select *, sum(head) over (partition by user_id order by ts rows unbounded preceding) as k from g) select min(ts) as start, user_id, count(*) as n from k group by user_id, k", plain=True)
def session_windows(s, d):
    rows = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, "30 minutes")


@query("select user_id, max(ts::timestamp) as last_seen from events group by 1 having max(ts::timestamp) >= (select max(ts::timestamp) from events) - interval 3 day", plain=True)
def cache_within_ttl(s, d):
    rows = read(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = rows.agg(F.max("ts").alias("newest"))
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.join(F.broadcast(newest), F.expr("last_seen >= newest - interval 3 days")).drop("newest")  # newest: one row


@query("select operator_name, brand, arg_max(operator_type, (seq, place_id, operator_type)) as operator_type from arrivals where discovered_via = 'chain_discovery' group by 1, 2")
def accepted_discoveries(s, d):
    return domain.arrivals(s, d).where("discovered_via = 'chain_discovery'").groupBy("operator_name", "brand").agg(F.max_by("operator_type", F.struct("seq", "place_id", "operator_type")).alias("operator_type"))


@query("select doc_id, length(text) as n from documents qualify row_number() over (partition by substr(text, 1, 200) order by doc_id) = 1", plain=True)
def evidence_once(s, d):
    rows = read(s, d, "documents").select("doc_id", F.length("text").alias("n"), F.substring("text", 1, 200).alias("head"))
    return writes.first_wins(rows, ["head"], ["doc_id"]).select("doc_id", "n")
