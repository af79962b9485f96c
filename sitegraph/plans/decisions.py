"""Registered queries over evidence, pages, gates and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, japan
from ..operators import decide, evidence, extract, judge
from . import jp
from .catalog import _ANCHOR, query
from .domain import read
from .entities import japanese

_C = jp.core("o_custkey")
_K = "concat(" + jp.choose("o_orderkey", tuple(a[2] for a in jp.AREAS)) + ", cast(o_orderkey % 400 as string))"


def _from_orders(s: SparkSession, d: str, **columns: str) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_orderkey as place_id", *[f"{e} as {n}" for n, e in columns.items()])


# -- decisions ---------------------------------------------------------------------------------------

_SNIPPETS = [
    f"case o_orderkey % 7 when 0 then concat('当サイトの運営会社: 株式会社', {_C}, '、お気軽に') when 1 then concat('全店直営です。株式会社', {_C}, ' の店舗') when 2 then '直営店舗のご案内' when 3 then concat('株式会社', {_C}, ' はマスターフランチャイジーです') when 4 then concat('株式会社', {_C}, '、本日') when 5 then 'アクセス案内' else concat({_C}, '株式会社が経営') end",
    f"case when o_orderkey % 7 = 4 then concat('株式会社', {_C}, 'ビー。') else concat('ようこそ', {_K}) end",
    f"case when o_orderkey % 7 = 4 then concat('本日は株式会社', {_C}, 'ビー 2024年') else concat('ようこそ', {_K}) end",
]


@query(f"""select o_orderkey as place_id, case o_orderkey % 7 when 0 then concat('株式会社', {_C}) when 1 then concat('株式会社', {_C}) when 3 then concat('株式会社', {_C}) when 4 then concat('株式会社', {_C}, 'ビー') when 6 then concat({_C}, '株式会社') else '' end as operator_name,
  case o_orderkey % 7 when 0 then 'franchisee' when 3 then 'franchisor' when 4 then 'unknown' when 5 then 'unknown' else 'direct' end as operator_type, case o_orderkey % 7 when 0 then 0.9 when 1 then 0.85 when 2 then 0.6 when 3 then 0.65 when 4 then 0.5 when 5 then 0.0 else 0.85 end::double as confidence from orders""", plain=True)
def store_decisions(s, d):
    """Who runs a store, from three snippets each; the company that two of them name comes before the one that one names."""
    rows = _from_orders(s, d, a=_SNIPPETS[0], b=_SNIPPETS[1], c=_SNIPPETS[2])
    each = rows.select("place_id", F.posexplode(F.array("a", "b", "c")).alias("seq", "snippet")).withColumns({"url": F.lit("u"), "reason": F.when((F.col("place_id") % 7 == 6) & (F.col("seq") == 0), "direct_keyword").otherwise("operator_keyword")})
    return decide.decide(each)


@query(f"select o_orderkey as place_id, array_to_string(case o_orderkey % 5 when 0 then [concat('株式会社', {_C}), '運営は株式会社'] when 1 then [concat('(株)', {_C}), concat('株式会社', {_C}, '食品')] when 2 then [concat({_C}, '株式会社')] when 3 then ['株式会社アルペン'] else [] end, '|') as names from orders", plain=True)
def extracted_companies(s, d):
    """Companies of notices: names end at particles, labels and campaigns, begin behind labels, and never run into each other."""
    t = f"case o_orderkey % 5 when 0 then concat('運営は株式会社', {_C}, 'について所在地東京都') when 1 then concat('㈱', {_C}, '、株式会社', {_C}, '食品 キャンペーン期間') when 2 then concat('会社概要 商号：', {_C}, '株式会社') when 3 then '株式会社アルペン 2026年5月1日' else '会社はありません' end"
    return _from_orders(s, d, t=t).select("place_id", F.array_join(decide.company_names(F.col("t")), "|").alias("names"))


@query("""with p as (select doc_id, text, string_split(text, 'the') as parts from documents where text is not null), e as (select doc_id, text, parts, unnest(range(1, len(parts))) as i from p),
a as (select doc_id, text, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 3)::int as pos from e)
select doc_id, pos, trim(regexp_replace(substr(text, greatest(pos - 200, 0) + 1, pos + 200 - greatest(pos - 200, 0)), '\\s+', ' ', 'g')) as snippet from a""", plain=True)
def keyword_snippets(s, d):
    """Every occurrence of a keyword with what stands around it."""
    return decide.occurrences(read(s, d, "documents"), "doc_id", "text", ("the",), "word").select("doc_id", "pos", "snippet")


_LINKS = f"select page_id, unnest(range(len(h))) as pos, unnest(h) as href, trim(regexp_replace(unnest(l), '<[^>]+>', '', 'g')) as label from (select page_id, regexp_extract_all(html, {_ANCHOR}, 1) as h, regexp_extract_all(html, {_ANCHOR}, 2) as l from pages)"


@query(f"""with l as ({_LINKS}), m as (select l.page_id, url, href, case when pos % 3 = 0 then concat('会社概要 ', label) when pos % 3 = 1 then label else '' end as label from l join pages using (page_id)),
t as (select page_id, url, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then concat(regexp_extract(url, '^([^:]+:)', 1), href) when starts_with(href, '/') then concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), href) else concat(regexp_extract(url, '^([^?#]*/)[^/]*$', 1), href) end as target
  from m where starts_with(label, '会社概要') or regexp_matches(label, 'About|Corporate|Company'))
select distinct page_id, target as about_url from t where lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) = lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) and regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) <> ''""", plain=True)
def about_page_links(s, d):
    pages = read(s, d, "pages")
    links = evidence.links(pages).withColumn("label", F.expr("case when pos % 3 = 0 then concat('会社概要 ', label) when pos % 3 = 1 then label else '' end"))
    return decide.about_links(links, pages)


@japanese(" select place_id, case when url = '' then '' when contains(url, '//www') then regexp_replace(url, '/s/.*$', '/') else concat(regexp_replace(url, '/s/.*$', '/'), '|', regexp_replace(regexp_replace(url, '/s/.*$', '/'), '//(map|shop)', '//www')) end as roots from jp_stores")
def root_pages(s, d):
    return jp.stores(s, d).select("place_id", F.array_join(decide.root_candidates(F.col("url")), "|").alias("roots"))


_HTML = f"""case o_orderkey % 9 when 0 then concat('<p>運営会社：株式会社', {_C}, '</p>') when 1 then concat('<p>運営 ', {_C}, '株式会社</p>') when 2 then concat('<p>店舗運営者: 有限会社', {_C}, '</p>') when 3 then concat('<p>事業主：株式会社', {_C}, '</p>') when 4 then concat('<p>会社名 株式会社', {_C}, '</p>')
  when 5 then concat('<p>株式会社', {_C}, '</p>') when 6 then concat('<p>運営会社：株式会社ダスキン</p><p>加盟店：株式会社', {_C}, '</p>') when 7 then '<p>案内</p>' else concat('<p>社 名：', {_C}, '合同会社</p>') end"""
_LABEL = f"case o_orderkey % 9 when 1 then concat({_C}, '株式会社') when 2 then concat('有限会社', {_C}) when 7 then '' when 8 then concat({_C}, '合同会社') else concat('株式会社', {_C}) end"


@query(f"select o_orderkey as place_id, {_LABEL} as name, case o_orderkey % 9 when 0 then '運営会社' when 1 then '運営' when 2 then '店舗運営者' when 3 then '事業主' when 4 then '社名' when 5 then 'bare' when 6 then '加盟店' when 8 then '社名' end as label, case o_orderkey % 9 when 0 then 0.9 when 1 then 0.85 when 2 then 0.85 when 3 then 0.75 when 4 then 0.7 when 5 then 0.4 when 6 then 0.75 when 8 then 0.7 end::double as confidence, lpad(o_orderkey::varchar, 13, '0') as corporate_number from orders where o_orderkey % 9 <> 7", plain=True)
def labelled_operators(s, d):
    rows = _from_orders(s, d, html=f"concat({_HTML}, '<p>法人番号：', lpad(cast(o_orderkey as string), 13, '0'), '</p>')")
    return rows.select("place_id", decide.labelled_operator(F.col("html")).alias("x")).where("x is not null").select("place_id", "x.name", "x.label", "x.confidence", "x.corporate_number")


# -- gates -------------------------------------------------------------------------------------------

_JOB = f"""case o_orderkey % 6 when 0 then '' when 1 then concat('アルバイト募集 ', {_K}) when 2 then concat('株式会社', {_C}, ' の案内 ', {_K}) when 3 then concat('求人 会社名 株式会社', {_C}, ' 勤務地 ', {_K}) when 4 then concat('求人 株式会社', {_C}, ' 勤務地 ', {_K}) else concat('求人 会社名 株式会社', {_C}, ' ', repeat('あ', 2000), {_K}) end"""


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """A candidate for each store, with its keys and a page's text."""
    rows = _from_orders(s, d, candidate=f"concat('株式会社', {_C})", text=_JOB, k="o_custkey")
    keys = jp.stores(s, d).select("place_id", japan.store_keys("name", "address", "phone", list(jp.BRANDS)).alias("store_keys"))
    return rows.join(keys, "place_id")


@query(f"select o_orderkey as place_id, o_orderkey % 6 = 3 as found, case o_orderkey % 6 when 0 then 'empty_html' when 1 then 'operator_missing' when 2 then 'not_job_or_recruit_page' when 3 then '' when 4 then 'operator_without_employer_label' else 'store_key_not_near_operator' end as reason, case when o_orderkey % 6 in (3, 4) then {_K} else '' end as store_key, case when o_orderkey % 6 = 3 then '会社名' else '' end as label from orders", plain=True)
def recruitment_pages(s, d):
    seen = decide.recruitment_evidence(F.col("text"), F.col("candidate"), F.col("store_keys"))
    return _jobs(s, d).select("place_id", seen.alias("x")).select("place_id", "x.found", "x.reason", "x.store_key", "x.label")


@query(f"""with c as (select o_orderkey as place_id, concat('株式会社', {_C}) as candidate, o_orderkey % 6 as t, o_custkey % 4 = 0 as known, o_orderkey % 11 = 0 as blocked, o_orderkey % 13 = 0 as none from orders)
select place_id, case when t = 3 and not blocked and not none and known then candidate end as operator_name, t = 3 and not blocked and not none and known as accepted,
  case when none then 'no_candidates' when blocked then concat('blocked_franchisor:', candidate) when t = 0 then 'empty_html' when t = 1 then 'operator_missing' when t = 2 then 'not_job_or_recruit_page' when t = 4 then 'operator_without_employer_label' when t = 5 then 'store_key_not_near_operator' when not known then 'houjin_no_exact_match' else '' end as reject_reason from c""", plain=True)
def recruitment_decisions(s, d):
    """The chain of gates for candidates of recruitment pages."""
    rows = _jobs(s, d).withColumns({
        "candidate": F.when(F.col("place_id") % 13 != 0, F.col("candidate")), "confidence": F.lit(0.5), "blocked": F.col("place_id") % 11 == 0,
        "registry_name": F.when(F.col("k") % 4 == 0, F.col("candidate")), "registry_number": F.when(F.col("k") % 4 == 0, "1"),
    })
    return decide.recruitment_decision(rows, ["place_id"]).select("place_id", "operator_name", "accepted", "reject_reason")


@query(f"""with c as (select o_orderkey as place_id, o_orderkey % 6 as t, o_orderkey % 7 as v, o_orderkey % 10 as u, o_custkey % 4 = 0 as known from orders)
select place_id, case when u = 0 then 'gate1_no_operator' when u = 1 then 'gate1_no_evidence_urls' when t in (0, 1, 5) then 'gate2_no_cooccurrence' when v = 0 then 'gate3_critic_no: not the employer of the store' when v = 1 then 'gate3_critic_: ' when not known then 'gate4_no_exact_match' else '' end as reject_reason,
  u not in (0, 1) and t not in (0, 1, 5) and v > 1 and known as accepted from c""", plain=True)
def four_gates(s, d):
    rows = _jobs(s, d)
    rows = rows.withColumns({
        "registry_name": F.when(F.col("k") % 4 == 0, F.col("candidate")), "candidate": F.when(F.col("place_id") % 10 == 0, "").otherwise(F.col("candidate")), "urls": F.when(F.col("place_id") % 10 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("u"))),
        "verdict": F.expr("case place_id % 7 when 0 then 'no' when 1 then null else 'yes' end"), "verdict_reason": F.expr("case place_id % 7 when 0 then 'not the employer of the store' else '' end"),
    })
    return decide.store_research(rows, "place_id").select("place_id", "reject_reason", "accepted")


@query(f"""with c as (select o_orderkey as place_id, o_orderkey % 9 as l, {_LABEL} as name, o_orderkey % 50 as e, o_orderkey % 4 as k, o_custkey % 3 = 0 as known from orders),
r as (select *, case when e = 0 then 'fetch_error:timeout' when e = 1 then 'empty_html' when l = 7 then 'no_operator_label' when l = 5 then 'operator_label_not_explicit' when name = '株式会社佐藤フーズイ' then 'blocked_franchisor' when k = 0 then 'store_key_missing_in_page' when not known then 'houjin_no_exact_match' else '' end as reject_reason from c)
select place_id, reject_reason, case when known or e <> 1 then name else '' end as operator_name, case when reject_reason = '' then 0.84 else 0.0 end::double as confidence from r""", plain=True)
def page_acceptances(s, d):
    """The chain of gates for a store's own page."""
    rows = _from_orders(s, d, html=f"case when o_orderkey % 50 = 1 then '' else {_HTML} end", text=f"case when o_orderkey % 4 = 0 then 'ようこそ' else concat('店舗 ', {_K}) end", fetch_error="case when o_orderkey % 50 = 0 then 'timeout' end", registry_name=f"case when o_custkey % 3 = 0 then {_LABEL} end")
    keys = jp.stores(s, d).select("place_id", japan.store_keys("name", "address", "phone", list(jp.BRANDS)).alias("store_keys"))
    out = decide.page_acceptance(rows.join(keys, "place_id").withColumn("blocked_names", F.array(F.lit("株式会社佐藤フーズイ"))))
    return out.select("place_id", "reject_reason", "operator_name", "confidence")


@japanese(" select place_id, concat(case when place_id % 3 = 0 then '' when place_id % 2 = 0 then concat(url, '|https://a.example/b') else url end) as urls from jp_stores")
def useful_urls(s, d):
    """Evidence URLs without blank ones, repeats and result pages."""
    a = F.array("url", F.lit(" "), F.lit("https://www.google.co.jp/search?q=a"), "url", F.lit("http://search.yahoo.co.jp/x"), F.expr("case when place_id % 3 <> 0 and place_id % 2 = 0 then ' https://a.example/b ' end"), F.lit("https://www.bing.com/search?q=b"))
    return jp.stores(s, d).select("place_id", F.array_join(decide.useful_urls(a), "|").alias("urls"))


# -- judgements --------------------------------------------------------------------------------------

_KIND = "case o_orderkey % 6 when 0 then 'direct' when 1 then 'franchisee' when 2 then 'mixed' when 3 then 'unknown' when 4 then 'Other' end"
_FEE, _SOR, _OP = f"case when o_orderkey % 4 = 0 then {_C} else '' end", "case when o_orderkey % 5 = 0 then '本部' else '' end", "case when o_orderkey % 3 = 0 then '運営' else '' end"


@query(f"""with j as (select o_orderkey as place_id, {_KIND} as t, o_orderkey % 2 = 0 as f, {_FEE} as fee, {_SOR} as sor, {_OP} as op from orders),
k as (select *, case when t in ('direct', 'franchisee', 'mixed') then t when f then 'franchisee' else 'direct' end as kind, coalesce(nullif(op, ''), nullif(fee, ''), sor) as named from j)
select place_id, kind as operation_type, kind <> 'direct' as is_franchise, named as operator_name, case when fee = '' and sor = '' and kind = 'franchisee' then named else fee end as franchisee_name, case when fee = '' and sor = '' and kind = 'direct' then named else sor end as franchisor_name from k""", plain=True)
def derived_judgements(s, d):
    rows = _from_orders(s, d, operation_type=_KIND, is_franchise="o_orderkey % 2 = 0", franchisee_name=_FEE, franchisor_name=_SOR, operator_name=_OP)
    return judge.derived(rows)


def _worker(s: SparkSession, d: str, shift: int) -> DataFrame:
    return _from_orders(s, d, operation_type=f"case (o_orderkey + {shift}) % 3 when 0 then 'direct' when 1 then 'franchisee' else 'mixed' end", franchisor_name=f"case when (o_orderkey + {shift}) % 4 = 0 then '' else concat('株式会社', {_C}) end", franchisee_name=f"case when (o_orderkey + {shift * 5}) % 5 = 0 then '' else concat('株式会社', {jp.core('o_custkey + ' + str(shift * 770))}) end", confidence=f"cast((o_orderkey * {shift + 3}) % 100 as double) / 100")


_WORKERS = ", ".join(f"""{n} as (select o_orderkey as place_id, case (o_orderkey + {k}) % 3 when 0 then 'direct' when 1 then 'franchisee' else 'mixed' end as t, case when (o_orderkey + {k}) % 4 = 0 then '' else concat('株式会社', {_C}) end as sor,
  case when (o_orderkey + {k * 5}) % 5 = 0 then '' else concat('株式会社', {jp.core('o_custkey + ' + str(k * 770))}) end as fee, ((o_orderkey * {k + 3}) % 100) / 100.0 as c from orders)""" for n, k in (("a", 0), ("b", 1)))


@query(f"""with {_WORKERS}, v as (select a.place_id, a.t as ta, b.t as tb, a.sor as asor, b.sor as bsor, a.fee as afee, b.fee as bfee, a.c as ac, b.c as bc, case a.place_id % 6 when 0 then 'both_wrong' when 1 then 'prefer_a' when 2 then 'prefer_b' when 3 then 'agree_both' else 'uncertain' end as v, case a.place_id % 6 when 4 then 'b' when 5 then 'a' end as side, case when a.place_id % 7 = 0 then 0.2 when a.place_id % 7 = 1 then -0.3 else 0.0 end as adj from a join b using (place_id)),
w as (select *, v = 'both_wrong' as wrong, v = 'prefer_a' or coalesce(side, '') = 'a' as l, v = 'prefer_b' or coalesce(side, '') = 'b' as r from v)
select place_id, case when wrong then 'unknown' when r and not l then tb else ta end as operation_type, case when wrong then '' when r and not l then bsor else asor end as franchisor_name, case when wrong then '' when r and not l then bfee else afee end as franchisee_name,
  round(case when wrong then greatest(0.0, least(ac, bc) * 0.5 + adj) else greatest(0.0, least(1.0, case when l then ac when r then bc else least(ac, bc) end + adj)) end, 6)::double as confidence from w""", plain=True)
def panel_verdicts(s, d):
    """Two workers and a critic."""
    critic = _from_orders(s, d, verdict="case o_orderkey % 6 when 0 then 'both_wrong' when 1 then 'prefer_a' when 2 then 'prefer_b' when 3 then 'agree_both' else 'uncertain' end", preferred_side="case o_orderkey % 6 when 4 then 'b' when 5 then 'a' end", adjustment="case when o_orderkey % 7 = 0 then 0.2D when o_orderkey % 7 = 1 then -0.3D else 0.0D end")
    return judge.panel(_worker(s, d, 0), _worker(s, d, 1), critic)


_AGREED = f"""with {_WORKERS}, j as (select a.place_id, (a.sor = b.sor) as s1, (a.fee = b.fee) as s2, a.t = b.t as k, a.t, least(a.c, b.c) as low, a.sor as asor, a.fee as afee, b.sor as bsor, b.fee as bfee from a join b using (place_id))"""


@query(f"{_AGREED} select place_id, s1 and s2 as operator_agreement, k as type_agreement, case when s1 and s2 and k then t else 'unknown' end as operation_type, case when s1 and s2 and k then coalesce(nullif(asor, ''), bsor) else '' end as franchisor_name, case when s1 and s2 and k then coalesce(nullif(afee, ''), bfee) else '' end as franchisee_name, round(case when s1 and s2 and k then low else low * 0.5 end, 6)::double as confidence from j", plain=True)
def compared_readings(s, d):
    """Two readings: their operators agree if both are blank or mean one company."""
    return judge.compared(_worker(s, d, 0), _worker(s, d, 1))


@query(f"{_AGREED} select count(*) as n, round(avg((s1 and s2)::int), 6) as operator_agreement, round(avg(k::int), 6) as type_agreement, round(avg((s1 and s2 and k)::int), 6) as full_agreement from j", plain=True)
def agreement_rates(s, d):
    return judge.agreement(judge.compared(_worker(s, d, 0), _worker(s, d, 1)))


@query(f"""with e as (select o_orderkey as place_id, o_orderkey % 6 as p, o_orderkey % 5 as a, o_orderkey % 17 = 0 as none from orders)
select place_id, not none and (p = 1 or a in (1, 2)) as confirmed, case when none then 0.0 when p = 1 then 0.1 when a in (1, 2) then 0.05 else 0.0 end::double as boost, case when none then 'no_expected_operator' when p = 1 then 'primary_match' when a in (1, 2) then 'alt_match' when p in (2, 3) then 'mismatch' else 'no_evidence' end as reason from e""", plain=True)
def cross_verifications(s, d):
    expected = _from_orders(s, d, expected=f"case when o_orderkey % 17 = 0 then '' else concat('株式会社', {_C}) end")
    primary = _from_orders(s, d, observed=f"case o_orderkey % 6 when 1 then concat({_C}, '株式会社') when 2 then '株式会社ベツモノ' when 3 then '有限会社ベツ' else '' end")
    others = _from_orders(s, d, observed=f"case o_orderkey % 5 when 1 then {_C} when 2 then concat('株式会社', {_C}) when 3 then '株式会社ソト' else '' end", seq="0")
    return judge.cross_verified(expected, primary, others)


@japanese(""", n as (select distinct display as name from jp_operators) select name, case when w is not null then 'web_api' when c is not null then 'csv' when g is not null then 'gbiz' else '' end as source, coalesce(w, c, g, '') as corporate_number from n
left join (select display as name, min(number) as w from jp_operators where operator_id % 7 = 0 group by 1) using (name) left join (select name, min(corporate_number) as c from jp_registry group by 1) using (name) left join (select display as name, min(concat('G', operator_id)) as g from jp_operators where operator_id % 3 = 0 group by 1) using (name)""")
def first_existing_sources(s, d):
    o = jp.operators(s, d)
    web = o.where("operator_id % 7 = 0").select(F.col("display").alias("name"), F.col("number").alias("corporate_number"))
    gbiz = o.where("operator_id % 3 = 0").select(F.col("display").alias("name"), F.concat(F.lit("G"), F.col("operator_id").cast("string")).alias("corporate_number"))
    return judge.first_existing(o.select(F.col("display").alias("name")), {"web_api": web, "csv": jp.registry(s, d).select("name", "corporate_number"), "gbiz": gbiz})


@japanese(""", p as (select display as name, case operator_id % 3 when 0 then 'site' when 1 then 'registry' else 'jfa' end as source, case when operator_id % 4 = 0 then '' else prefecture end as prefecture, case when operator_id % 5 = 0 then null else city end as city, number from jp_operators),
f as (select name, min(case when prefecture <> '' then struct_pack(r := case source when 'registry' then 0 when 'site' then 1 end, v := prefecture) end) filter (where source in ('registry', 'site')) as p, min(case when city <> '' then struct_pack(r := case source when 'jfa' then 0 when 'registry' then 1 else 2 end, v := city) end) as c, min(case when number <> '' then struct_pack(r := case source when 'jfa' then 0 when 'registry' then 1 else 2 end, v := number) end) as n from p group by 1)
select name, coalesce(p.v, '') as prefecture, coalesce(c.v, '') as city, coalesce(n.v, '') as number, round(((p.v is not null)::int + (c.v is not null)::int + (n.v is not null)::int) / 3.0, 4)::double as confidence from f""")
def merged_profiles(s, d):
    rows = jp.operators(s, d).selectExpr("display as name", "case operator_id % 3 when 0 then 'site' when 1 then 'registry' else 'jfa' end as source", "case when operator_id % 4 = 0 then '' else prefecture end as prefecture", "case when operator_id % 5 = 0 then null else city end as city", "number")
    return judge.merged_profile(rows, "name", {"": ["jfa", "registry", "site"], "prefecture": ["registry", "site"]}, ["prefecture", "city", "number"])


_CLAIM = ["case o_orderkey % 8 when 0 then '' when 1 then 'null' else concat('https://e.example/', o_orderkey) end", "case o_orderkey % 7 when 0 then '' when 1 then repeat('x', 51) when 2 then '推測です' else '全国20店舗' end", "case when o_orderkey % 6 = 0 then '' else '株式会社A' end", "case o_orderkey % 5 when 0 then 'gmaps_cluster' when 1 then 'rumour' when 2 then '' else 'official' end"]


@query(f"""with c as (select o_orderkey as place_id, {_CLAIM[0]} as u, {_CLAIM[1]} as t, {_CLAIM[2]} as n, {_CLAIM[3]} as s, ((o_orderkey % 100) / 100.0) as c from orders),
f as (select *, u in ('', 'null') as a, length(t) = 0 or length(t) > 50 as b, n = '' as m, contains(concat(u, n, t), '推測') as p, s = 'gmaps_cluster' as g, s = 'rumour' as k from c),
r as (select *, case when a then 'source_url_empty' else '' end as r1 from f), r2 as (select *, case when b then 'source_text_invalid' else r1 end as r2 from r), r3 as (select *, case when m then 'corporate_name_missing' else r2 end as r3 from r2), r4 as (select *, case when p then 'refuse_phrase_found' else r3 end as r4 from r3)
select place_id, round(case when a or b then 0.0 else c * case when p then 0.5 else 1.0 end * case when g then 0.8 else 1.0 end end, 6)::double as confidence, a or b or m or k as rejected, g as review,
  array_to_string(list_filter([case when a then 'source_url_empty: source_url_empty' end, case when b then 'source_text_invalid: source_text_invalid' end, case when m then 'corporate_name_missing: corporate_name_missing' end, case when p then 'refuse_phrases_present: refuse_phrase_found' end, case when g and r4 <> '' then concat('gmaps_requires_l3: ', r4) end, case when k then 'unknown_source_rejected: unknown_source: "rumour" not in source_priority' end], lambda x: x is not null), '|') as violations from r4""", plain=True)
def checked_claims(s, d):
    rows = _from_orders(s, d, source_url=_CLAIM[0], source_text=_CLAIM[1], corporate_name=_CLAIM[2], count_source=_CLAIM[3], confidence="cast(o_orderkey % 100 as double) / 100")
    return judge.claims_checked(rows, ["official", "gmaps_cluster"], ["推測", "不明"]).select("place_id", "confidence", "rejected", "review", F.array_join("violations", "|").alias("violations"))


_GOLD = {"operation_type": "case o_orderkey % 7 when 0 then 'direct' when 1 then 'franchisee' when 2 then 'mixed' when 3 then 'unknown' when 4 then '' when 5 then 'chain' else 'direct' end", "franchisee_name": "case o_orderkey % 5 when 0 then '' when 1 then '(株)A' else '株式会社B' end", "franchisor_name": "case o_orderkey % 4 when 0 then '' when 1 then '㈱C' else '株式会社D' end", "is_franchise": "o_orderkey % 3 = 0", "brand": "case when o_orderkey % 11 = 0 then '' else 'b' end", "name": "case when o_orderkey % 13 = 0 then '' else concat('n', o_orderkey) end", "official_url": "case o_orderkey % 9 when 0 then 'ftp://x' when 1 then '' else 'https://x' end"}


@query("with g as (select case when o_orderkey % 500 = 3 then 3 else o_orderkey end as place_id, " + ", ".join(f"{e} as {n}" for n, e in _GOLD.items()) + """ from orders), h as (select *, row_number() over (partition by place_id order by name, official_url) > 1 as again from g)
select place_id, rule, count(*) as n from (select place_id, unnest(list_filter([case when again then 'duplicate_place_id' end, case when operation_type = '' then 'operation_type_empty' end, case when operation_type = 'chain' then 'operation_type_invalid' end, case when operation_type = 'direct' and franchisee_name <> '' then 'franchisee_with_direct' end, case when operation_type in ('franchisee', 'mixed') and franchisor_name = '' then 'franchisor_missing' end,
  case when operation_type <> '' and is_franchise <> (operation_type <> 'direct') then 'is_franchise_mismatch' end, case when contains(franchisor_name, '㈱') or contains(franchisee_name, '(株)') then 'company_name_style' end, case when brand = '' then 'brand_empty' end, case when name = '' then 'name_empty' end, case when official_url = 'ftp://x' then 'url_scheme' end], lambda x: x is not null)) as rule from h) group by all""", plain=True)
def validation_rules(s, d):
    """Every rule of a golden table that a row breaks."""
    rows = read(s, d, "orders").selectExpr("case when o_orderkey % 500 = 3 then 3 else o_orderkey end as place_id", *[f"{e} as {n}" for n, e in _GOLD.items()])
    return judge.golden_issues(rows, "place_id").groupBy("place_id", "rule").agg(F.count("*").alias("n"))


@query("with r as (select o_orderkey % 4 as t, o_custkey % 3 as g, case when o_orderkey % 5 = 0 then 'a' else 'b' end as x, case when o_orderkey % 2 = 0 then 'a' else 'b' end as y from orders), k as (select case t when 0 then 'direct' when 1 then 'franchisee' when 2 then 'unknown' end as t, case g when 0 then 'direct' when 1 then 'franchisee' else 'unknown' end as g, x, y from r) select count(*) as n, count_if(coalesce(t = g and (t <> 'franchisee' or x = y), false)) as right, round(count_if(coalesce(t = g and (t <> 'franchisee' or x = y), false)) / count(*), 4) as accuracy from k", plain=True)
def classification_accuracy(s, d):
    """Types, and of franchises the operator too."""
    rows = read(s, d, "orders").selectExpr("case o_orderkey % 4 when 0 then 'direct' when 1 then 'franchisee' when 2 then 'unknown' end as truth_type", "case o_custkey % 3 when 0 then 'direct' when 1 then 'franchisee' else 'unknown' end as guess_type", "case when o_orderkey % 5 = 0 then 'a' else 'b' end as truth_operator", "case when o_orderkey % 2 = 0 then 'a' else 'b' end as guess_operator")
    return judge.classification_accuracy(rows)


@query("select o_custkey, round(case when count_if(o_orderkey % 7 = 0) = 0 then 1.0 else count(*) / count_if(o_orderkey % 7 = 0) end, 6)::double as recall, least(2.0 * pow(1.5, o_custkey % 9), 20.0)::double as delay from orders group by 1", plain=True)
def recall_rates(s, d):
    per = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("found"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("actual"))
    return per.select("o_custkey", F.round(judge.recall_rate(F.col("found"), F.col("actual")), 6).alias("recall"), judge.retry_delay(F.col("o_custkey") % 9, 2.0, 1.5, 20.0).alias("delay"))


# -- figures on pages --------------------------------------------------------------------------------

_MONEY = "case o_orderkey % 5 when 0 then concat('売上高: 2024年3月期 ', 100 + o_orderkey % 900, '億円<br>売上高: 2023年3月期 ', 50 + o_orderkey % 900, '億円') when 1 then concat('令和6年3月期 売上高：', 200 + o_orderkey % 700, '百万円 平成31年3月期 売上高：', 300 + o_orderkey % 600, '百万円') when 2 then concat('売上高 約 ', 150 + o_orderkey % 500, ',000 千円') when 3 then '売上高: 5億円 売上高: 99兆円 売上高：3千円' else '売上なし' end"


@query("""with m as (select o_orderkey as place_id, o_orderkey % 5 as k, o_orderkey from orders)
select place_id, case k when 0 then '2024年3月期' when 1 then '令和6年3月期' else '' end as observed_at, case k when 0 then (100 + o_orderkey % 900) * 100000000 when 1 then (200 + o_orderkey % 700) * 1000000 when 2 then (150 + o_orderkey % 500) * 1000000 when 3 then 500000000 end::bigint as current_yen,
  case k when 0 then (50 + o_orderkey % 900) * 100000000 when 1 then (300 + o_orderkey % 600) * 1000000 else 0 end::bigint as previous_yen from m where k < 4""", plain=True)
def revenue_pairs(s, d):
    """Revenues of the two latest periods that a page names."""
    return extract.revenue_pair(_from_orders(s, d, t=_MONEY), "place_id", "t")


_REPORT = """case o_orderkey % 6 when 0 then concat('株式会社A', chr(10), 'FC店　RC店　合 計', chr(10), '2022年度 10 20 30', chr(10), '2024年度 1,', 100 + o_orderkey % 800, ' 50 1,', 150 + o_orderkey % 800) when 1 then concat('店舗数推移 直営 加盟店', chr(10), '2023/3 2024/9', chr(10), 'ブランド', 10 + o_orderkey % 90, ' 5 7 12')
  when 2 then concat('教室数推移 フランチャイズ 直営 合計', chr(10), '2023年度 ', 10 + o_orderkey % 50, ' 5 ', 15 + o_orderkey % 50, chr(10), '2024年度 1 2 99') when 3 then concat('2023年8月 店舗数 900 店舗 2025年8月 店舗数 1,', 100 + o_orderkey % 800, ' 店舗') when 4 then concat('2024年3月末日現在 現在は ', 100 + o_orderkey % 800, ' 店舗です') else '' end"""


@query("""select o_orderkey as place_id, case o_orderkey % 6 when 0 then 'fc_rc_total_table' when 1 then 'brand_store_count_row' when 2 then 'year_store_count_table' when 3 then 'history_store_count' when 4 then 'current_store_count_sentence' else '' end as method, case o_orderkey % 6 when 0 then '2024年度' when 1 then '2024-09' when 2 then '2023年度' when 3 then '2025-08' when 4 then '2024-03' else '' end as observed_at,
  case o_orderkey % 6 when 0 then 1000 + 100 + o_orderkey % 800 when 1 then 7 when 2 then 10 + o_orderkey % 50 else 0 end::int as fc, case o_orderkey % 6 when 0 then 50 when 1 then 5 when 2 then 5 else 0 end::int as rc, case o_orderkey % 6 when 0 then 1000 + 150 + o_orderkey % 800 when 1 then 12 when 2 then 15 + o_orderkey % 50 when 3 then 1000 + 100 + o_orderkey % 800 when 4 then 100 + o_orderkey % 800 else 0 end::int as total from orders""", plain=True)
def disclosed_counts(s, d):
    rows = _from_orders(s, d, t=_REPORT, brand="concat('ブランド', 10 + o_orderkey % 90)")
    return rows.select("place_id", extract.disclosed_counts(F.col("t"), F.col("brand")).alias("x")).select("place_id", "x.*")


_MEMBER = f"concat('会社案内', chr(10), case o_orderkey % 3 when 0 then concat('代表者：代表取締役社長 山田 太郎', chr(10)) when 1 then concat('代表　佐藤', o_orderkey % 50, '。', chr(10)) else '' end, '所在地: ', {_K}, '  1-2', chr(10), '資本金 ', 10 + o_orderkey % 90, '百万円', chr(10), 'URL： https://e.example/', o_orderkey, chr(10), '業種：', case when o_orderkey % 2 = 0 then '飲食' else '小売業、' end)"


@query(f"select o_orderkey as place_id, case o_orderkey % 3 when 0 then '山田 太郎' when 1 then concat('佐藤', o_orderkey % 50) else '' end as representative, case when o_orderkey % 3 = 0 then '代表取締役社長' else '' end as representative_title, concat({_K}, ' 1-2') as headquarters_address, concat(10 + o_orderkey % 90, '百万円') as capital_stock, concat('https://e.example/', o_orderkey) as website_url, case when o_orderkey % 2 = 0 then '飲食' else '小売業' end as industry from orders", plain=True)
def member_pages(s, d):
    return _from_orders(s, d, t=_MEMBER).select("place_id", extract.member_fields(F.col("t")).alias("x")).select("place_id", "x.*").drop("established")


@query(f"select o_orderkey as place_id, case o_orderkey % 4 when 0 then concat('株式会社', {_C}) when 1 then concat('株式会社', {_C}, 'ビー') else '' end as company, case when o_orderkey % 3 = 0 then 1000 + o_orderkey % 999 else 0 end as stores from orders", plain=True)
def official_site_fields(s, d):
    t = f"concat(case o_orderkey % 4 when 0 then concat('商号： 株式会社', {_C}) when 1 then concat('株式会社エー 株式会社', {_C}, 'ビー 株式会社', {_C}, 'ビー') when 2 then concat('株式会社', {_C}) else '案内' end, case o_orderkey % 3 when 0 then concat(' 店舗数は1,', lpad(cast(o_orderkey % 999 as string), 3, '0'), '店舗') when 1 then ' 全国 99999 店舗' else '' end)"
    return _from_orders(s, d, t=t).select("place_id", extract.site_company(F.col("t")).alias("company"), extract.site_store_count(F.col("t")).alias("stores"))


# -- cells -------------------------------------------------------------------------------------------

_BOX = (35.0, 139.0, 36.0, 140.5)


@query("""with p(k) as (select 20.0 / 111.32), w(k) as (select 20.0 / (111.32 * cos(radians(35.5)))), g as (select i, j, 35.0 + i * p.k as south, 139.0 + j * w.k as west, least(35.0 + i * p.k + p.k, 36.0) as north, least(139.0 + j * w.k + w.k, 140.5) as east from (select unnest(range(6)) as i), (select unnest(range(7)) as j), p, w),
c as (select *, (south + north) / 2 as clat, (west + east) / 2 as clng from g), v as (select *, unnest([{'a': clat, 'o': clng}, {'a': south, 'o': west}, {'a': south, 'o': east}, {'a': north, 'o': west}, {'a': north, 'o': east}]) as s from c),
h as (select i, j, s.a > 35.1 and s.a <= 35.9 and s.o > 139.2 and s.o <= 140.3 as inside from v), k as (select i, j from h group by all having bool_or(inside))
select concat('cell-', lpad((row_number() over (order by i, j) - 1)::varchar, 5, '0')) as id, round(south, 9) as south, round(west, 9) as west, round(north, 9) as north, round(east, 9) as east, round(20 * sqrt(2) / 2 * 1000, 6) as radius_m from c join k using (i, j)""", plain=True)
def grid_split(s, d):
    cells = geo.split_box(s.range(1), 20.0, 35.0, 36.0, 139.0, 140.5, [(35.10000001, 139.20000001), (35.90000001, 139.20000001), (35.90000001, 140.30000001), (35.10000001, 140.30000001)])
    return cells.select("id", *[F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")], F.round("radius_m", 6).alias("radius_m"))


@query("with q(k, s, w) as (values ('NE', 0.5, 0.5), ('NW', 0.5, 0.0), ('SE', 0.0, 0.5), ('SW', 0.0, 0.0)) select concat('root-', a.k, '-', b.k) as id, (35 + a.s + b.s / 2)::double as south, (139 + a.w + b.w / 2)::double as west, (35 + a.s + b.s / 2 + 0.25)::double as north, (139 + a.w + b.w / 2 + 0.25)::double as east, round(0.5 * sqrt(pow(0.25 * 111320, 2) + pow(0.25 * 111320 * cos(radians(35 + a.s + b.s / 2 + 0.125)), 2)), 4) as radius_m from q a, q b", plain=True)
def quadtree_levels(s, d):
    one = s.createDataFrame([("root", 35.0, 139.0, 36.0, 140.0)], "id string, south double, west double, north double, east double")
    cells = geo.quarter(geo.quarter(one))
    return cells.withColumn("radius_m", F.round(geo.half_diagonal_m(*[F.col(c) for c in ("south", "west", "north", "east")]), 4))


@japanese(""", g as (select unnest(range(7)) as d), c as (select d, unnest(range((1 << d)::int)) as i from g), k as (select c.d, c.i, j.i as j from c join c j using (d)),
e as (select *, 30 + i * 10.0::double / (1 << d) as south, 130 + j * 12.0::double / (1 << d) as west, 10.0::double / (1 << d) as h, 12.0::double / (1 << d) as w from k where d <= 5),
n as (select d, least(floor((lat - 30) / (10.0::double / (1 << d))), (1 << d) - 1)::bigint as i, least(floor((lng - 130) / (12.0::double / (1 << d))), (1 << d) - 1)::bigint as j, count(*) as n from jp_stores, g where lat between 30 and 40 and lng between 130 and 142 group by all),
b as (select e.*, coalesce(n.n, 0) as n, 0.5 * sqrt(pow(h * 111320, 2) + pow(w * 111320 * cos(radians(south + h / 2)), 2)) as radius, (south + h / 2 < 31.5) as covered from e left join n using (d, i, j)),
t as (select *, case when radius > 47500 and d < 5 then 'too_wide' when covered then 'covered' when n >= 20 and d < 5 then 'split' else 'searched' end as step from b),
u as (select t.*, d as dd from t), o as (select t.*, (select bool_and(y.step in ('split', 'too_wide')) from t y where y.d < t.d and y.i = t.i >> (t.d - y.d) and y.j = t.j >> (t.d - y.d)) as reached from t)
select d as depth, round(south, 9) as south, round(west, 9) as west, n, step from o where coalesce(reached, true)""")
def adaptive_cells(s, d):
    """Every cell that an adaptive search over the stores comes to; the south is covered already."""
    pts = jp.stores(s, d).select("lat", "lng")
    whole = [(29.0, 129.0), (41.0, 129.0), (41.0, 143.0), (29.0, 143.0)]
    cells = geo.adaptive_cells(pts, (30.0, 130.0, 40.0, 142.0), whole, F.col("lat") < 31.5, deepest=5)
    return cells.select("depth", F.round("south", 9).alias("south"), F.round("west", 9).alias("west"), "n", "step")


@japanese(", c as (select lat as south, lng as west, lat + 0.5 as north, lng + 0.5 as east from jp_stores where place_id % 97 = 0), k as (select (least(north, 36.0) - greatest(south, 35.0)) as h, (least(east, 140.0) - greatest(west, 139.0)) as w from c) select round(coalesce(sum(case when h > 0 and w > 0 then h * w end), 0.0), 9) as coverage from k")
def box_coverage(s, d):
    c = jp.stores(s, d).where("place_id % 97 = 0").selectExpr("lat as south", "lng as west", "lat + 0.5 as north", "lng + 0.5 as east")
    return geo.box_coverage(c, 35.0, 139.0, 36.0, 140.0).select(F.round("coverage", 9).alias("coverage"))

