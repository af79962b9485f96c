"""Registered queries over links and stores on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from . import jp
from .catalog import query
from .decisions import _C, _from_orders
from .entities import ALIASES, japanese

#: Four links of a page of every store: label and target.
_LINKS = [
    ("case place_id % 4 when 0 then '店舗一覧' when 1 then '事業内容' when 2 then 'Curves 港' else 'FC募集' end", "case place_id % 3 when 0 then '/stores/' when 1 then concat('list', place_id % 7, '.html#top') else concat('https://www.example', place_id % 5, '.jp/fc/') end"),
    ("case place_id % 5 when 0 then 'KITTO MOSAIC' when 1 then 'アルバイト募集 オーナー' when 2 then 'ブランド モスバーガー' else 'shop' end", "case place_id % 2 when 0 then '/franchise/' else '//other.example/brand/' end"),
    ("'フランチャイズ'", "case place_id % 6 when 0 then 'mailto:a@b' when 1 then '/owner/x.pdf' else '/recruit/owner' end"),
    ("'店舗一覧'", "case place_id % 3 when 0 then '/stores/' else '/brand/' end"),
]
_URL = "concat('https://www.example', cast(place_id % 5 as string), '.jp/', case when place_id % 2 = 0 then 'a/' else '' end)"
_SQL = ", l as (" + " union all ".join(f"select place_id as page_id, {_URL} as url, {i} as pos, {h} as href, {t} as label from jp_stores" for i, (t, h) in enumerate(_LINKS)) + """),
t as (select *, regexp_replace(case when regexp_matches(href, '^[a-z]+:') then href when starts_with(href, '//') then concat('https:', href) when starts_with(href, '/') then concat(regexp_extract(url, '^(https://[^/]+)', 1), href) else concat(url, href) end, '#.*$', '') as target from l)"""
_HOST = "regexp_extract({0}, '^https://([^/]+)', 1)"


def _links(s: SparkSession, d: str) -> DataFrame:
    rows = jp.stores(s, d).selectExpr("place_id as page_id", f"{_URL} as url", "array(" + ", ".join(f"named_struct('href', {h}, 'label', {t})" for t, h in _LINKS) + ") as x")
    return rows.select("page_id", "url", F.posexplode("x").alias("pos", "y")).select("page_id", "url", "pos", "y.href", "y.label")


@japanese(_SQL + " select page_id, target, min(pos) as pos from t where regexp_matches(label, '店舗|shop') and target <> url group by 1, 2")
def store_list_links(s, d):
    return pages.store_list_links(_links(s, d))


@japanese(_SQL + f", k as (select page_id, target, min(pos) as pos from t where not starts_with(href, 'mailto:') and {_HOST.format('url')} = {_HOST.format('target')} and not regexp_matches(target, '\\.pdf$') and rtrim(target, '/') <> rtrim(url, '/') and regexp_matches(lower(concat(label, ' ', href)), '事業|ブランド|運営|店舗|サービス|フランチャイズ|business|brand|service|shop') group by 1, 2) select page_id, target, pos from k qualify row_number() over (partition by page_id order by pos) <= 2")
def business_links(s, d):
    return pages.business_links(_links(s, d), most=2)


@japanese(_SQL + " select page_id, case when contains(label, 'Curves') then 'カーブス' else 'モスバーガー' end as brand, target, label from t where contains(label, 'Curves 港') or contains(label, 'モスバーガー')")
def brand_links(s, d):
    """Links that name a brand; a Latin spelling inside another word doesn't."""
    return pages.brand_links(_links(s, d), ALIASES | {"モスバーガー": "モスバーガー"})


@japanese(_SQL + """, s as (select *, round(case when regexp_matches(label, 'FC募集') then 0.5 when regexp_matches(label, 'フランチャイズ|オーナー') then 0.2 else 0 end + case when regexp_matches(href, '/franchise/|/fc/|/recruit/owner|/owner/') then 0.3 when regexp_matches(href, 'franchise|owner|recruit') then 0.1 else 0 end, 4)::double as score from t where not starts_with(href, 'mailto:') and not contains(label, 'アルバイト'))
select page_id, arg_min(target, (-score, pos)) as target, arg_min(label, (-score, pos)) as label, max(score) as score from s where score >= 0.3 group by 1""")
def owner_links(s, d):
    """The link of a page for future franchisees."""
    return pages.owner_link(_links(s, d))


_MD = "concat('[Home](/) ', case o_orderkey % 3 when 0 then '[About Us](/about) [会社概要](/co1) [企業情報](/co2)' when 1 then concat('[Corporate](/corp', o_orderkey, ') [Store Locator](/sl)') else '[店舗検索](/s1) [店舗一覧](/s2)' end)"


@query("select o_orderkey as place_id, case o_orderkey % 3 when 0 then '/co1' when 1 then concat('/corp', o_orderkey) else '' end as company, case o_orderkey % 3 when 1 then '/sl' when 2 then '/s1' else '' end as stores from orders", plain=True)
def markdown_page_links(s, d):
    """Links to the company's and the store list's page, by tier."""
    rows = _from_orders(s, d, m=_MD)
    return rows.select("place_id", pages.tiered_link(F.col("m"), pages.COMPANY_TIERS).alias("company"), pages.tiered_link(F.col("m"), pages.STORE_LIST_TIERS).alias("stores"))


@japanese(""", a as (select place_id as page_id, plain_address as address, case when place_id % 3 = 0 then '(名称不明)' else name end as name from jp_stores), b as (select place_id, concat(plain_address, '9'), case when place_id % 2 = 0 then 'となり店' when place_id % 3 = 0 then '(名称不明)' else name end from jp_stores) select * from a union all select * from b""")
def store_candidates(s, d):
    """Addresses of a page with the last heading before them."""
    head = F.when(F.col("place_id") % 3 == 0, "").otherwise(F.concat(F.lit("<h2>"), "name", F.lit("</h2>")))
    next_head = F.when(F.col("place_id") % 2 == 0, "<h3>となり店</h3>").otherwise("")
    html = F.concat(F.lit("<style>h{}</style>"), head, F.lit("<p>〒100-0001 "), "plain_address", F.lit("</p>"), next_head, F.lit("<p>"), "plain_address", F.lit("9。</p><p>"), "plain_address", F.lit("</p>"))
    return pages.store_candidates(jp.stores(s, d).select(F.col("place_id").alias("page_id"), html.alias("html")))


_JOB = f"case o_orderkey % 5 when 0 then '' when 1 then '<h2>港店</h2>案内' else concat('<h2> 港', o_orderkey % 9, '<b>店</b></h2><p>募集企業：㈱', {_C}, '</p>') end"


@query(f"select o_orderkey as place_id, case o_orderkey % 5 when 0 then '' when 1 then '港店' else concat('港', o_orderkey % 9, ' 店') end as store_name, case when o_orderkey % 5 > 1 then concat('株式会社', {_C}) else '' end as operator_name, case when o_orderkey % 5 > 1 then '東京都港区芝浦三丁目1-2-3' else '' end as address, case o_orderkey % 5 when 0 then 'empty_html' when 1 then 'operator_label_missing' else '' end as reason from orders", plain=True)
def job_pages(s, d):
    rows = _from_orders(s, d, html=_JOB)
    plain = F.concat(F.regexp_replace("html", "<[^>]+>", " "), F.lit("\n北海道札幌市中央区大通西1\n。\n東京都港区芝浦三丁目1-2-3"))
    return rows.select("place_id", pages.job_page(F.col("html"), plain).alias("x")).select("place_id", "x.*")


@query(f"select o_orderkey as place_id, case when o_orderkey % 2 = 0 then concat('株式会社', {_C}, '|有限会社サンプル') else concat({_C}, '株式会社') end as names from orders", plain=True)
def phone_page_companies(s, d):
    t = f"case when o_orderkey % 2 = 0 then concat('株式会社', {_C}, '。株式会社ぐるなび、有限会社サンプル。株式会社', {_C}, '。') else concat('電話帳 ', {_C}, '株式会社 NTTタウンページ株式会社') end"
    return _from_orders(s, d, t=t).select("place_id", F.array_join(pages.phone_page_companies(F.col("t")), "|").alias("names"))


@japanese(" select place_id from jp_stores where brand in ('カーブス', 'モスバーガー') or place_id % 7 = 0")
def target_rows(s, d):
    """Rows of target brands, in any spelling."""
    rows = jp.stores(s, d).withColumn("brand", F.when(F.col("place_id") % 7 == 0, "Curves").otherwise(F.col("brand")))
    return pages.of_targets(rows, ["カーブス", " モスバーガー"], ALIASES).select("place_id")
