"""Links and stores on the pages of brands and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.japan import PREFECTURES
from ..functions.text import canonical_brand, operator_name, text_before
from .evidence import host

#: What links to a company's and to a store list's page say, by tier.
COMPANY_TIERS = (("会社概要", "企業情報", "会社情報"), ("運営会社", "運営", "運営元"), ("about us", "about"), ("corporate", "company"))
STORE_LIST_TIERS = (("店舗一覧", "店舗検索", "店舗情報", "ショップ一覧"), ("store locator", "stores", "shop list", "locations"))
#: Hints of links to stores and to businesses, and targets that are no pages.
STORE_HINTS = ("店舗", "店舗一覧", "店舗検索", "ショップ", "SHOPS", "STORES", "location", "Location", "Locations", "Store", "shop")
BUSINESS_HINTS = ("事業", "事業内容", "事業紹介", "ブランド", "運営", "店舗", "サービス", "フランチャイズ", "business", "brand", "service", "shop")
NO_PAGES = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".zip")
#: What links to a page for future franchisees say and hold, and what they don't, and what either is worth.
OWNER_TEXTS, OWNER_WORDS = ("加盟店募集", "フランチャイズ募集", "FC募集", "FC 募集", "オーナー募集", "フランチャイジー募集", "加盟店オーナー", "独立開業", "パートナー募集", "開業をお考えの"), ("加盟店", "フランチャイズ", "オーナー", "開業", "FC", "フランチャイジー")
OWNER_PATHS, OWNER_PARTS = ("/franchise/", "/fc/", "/recruit/owner", "/recruit/franchise", "/contract/", "/join/", "/owner/", "/partner/"), ("franchise", "owner", "recruit")
STAFF_TEXTS = ("新卒採用", "中途採用", "社員募集", "アルバイト", "パート", "求人情報")
#: Parts of names that are debris of portals.
PORTAL_PARTS = ("を展開する株式会社", "タウンページ", "食べログ", "Retty", "レッティ", "ぐるなび")
#: Labels before an employer, and patterns of addresses.
EMPLOYER = r"(?:募集者|雇用主|運営会社|会社名|企業名|法人名|募集企業|採用企業)[：:\s]*"
_FORM = r"(?:株式会社|有限会社|合同会社|㈱|㈲|\(株\)|（株）)"
_CORP = rf"(?:{_FORM}[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー 　]{{2,40}}|[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー 　]{{2,40}}{_FORM})"
JOB_ADDRESS = r"((?:北海道|東京都|大阪府|京都府|.{2,3}県)[一-龥ぁ-んァ-ヶ0-9０-９\-ーのノヶ、・\s]{5,80}[0-9０-９][^\n]{0,30})"
STORE_ADDRESS = rf"(?:〒?\d{{3}}-?\d{{4}}\s*)?((?:{'|'.join(PREFECTURES)})[^\s<>,。]{{2,80}}\d[^\s<>,。]{{0,40}})"
NAMELESS = "(名称不明)"
_any = lambda c, words: c.rlike("|".join(rf"\Q{w}\E" for w in words))


def tiered_link(markdown: Column, tiers: tuple[tuple[str, ...], ...]) -> Column:
    """Target of the first link of a Markdown text whose words belong to the first tier that any link belongs to; empty if none does."""
    link = r"\[([^\]]+)\]\(([^)\s]+)\)"
    rows = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(link), F.lit(1)).alias("t"), F.regexp_extract_all(markdown, F.lit(link), F.lit(2)).alias("u"))

    def first(tier: tuple[str, ...]) -> Column:
        return F.get(F.filter(rows, lambda x: _any(F.lower(F.trim(x["t"])), tier)), 0)["u"]

    return F.coalesce(*[first(t) for t in tiers], F.lit(""))


def absolute(url: Column, href: Column) -> Column:
    """A link's target, seen from a page, without its fragment."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    base = F.coalesce(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*/)[^/]*$", 1), F.lit("")), F.concat(site, F.lit("/")))
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, "^([^:]+:)", 1), href)).when(F.startswith(href, F.lit("/")), F.concat(site, href)).otherwise(F.concat(base, href))
    return F.regexp_replace(full, "#.*$", "")


def _targets(links: DataFrame) -> DataFrame:
    """links (page_id, url, pos, href, label) with target, the label and href trimmed."""
    rows = links.withColumns({"href": F.trim("href"), "label": F.trim(F.regexp_replace("label", r"\s+", " "))})
    return rows.withColumn("target", absolute(F.col("url"), F.col("href")))


def _first(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id", "target").orderBy("pos")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def store_list_links(links: DataFrame) -> DataFrame:
    """page_id, target, pos of links whose words hint at a list of stores, each target once, the page itself not."""
    rows = _targets(links).where(_any(F.col("label"), STORE_HINTS) & (F.col("target") != F.col("url")))
    return _first(rows).select("page_id", "target", "pos")


def business_links(links: DataFrame, most: int = 4) -> DataFrame:
    """page_id, target, pos of the first links of a page, at most a few to follow, that hint at its businesses and stay on the site; no files, fragments, mail or scripts."""
    rows = _targets(links).where((F.col("href") != "") & ~F.startswith("href", F.lit("#")) & ~F.lower("href").rlike("^(?:mailto:|tel:|javascript:)"))
    same = (host(F.col("url")) != "") & (host(F.col("url")) == host(F.col("target")))
    path = F.lower(F.regexp_extract("target", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    files = path.rlike("(?:" + "|".join(rf"\Q{x}\E" for x in NO_PAGES) + ")$")
    itself = F.rtrim("target", F.lit("/")) == F.rtrim("url", F.lit("/"))
    said = F.lower(F.concat_ws(" ", "label", "href"))
    kept = _first(rows.where(same & ~files & ~itself & _any(said, tuple(h.lower() for h in BUSINESS_HINTS))))
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("r") <= most).select("page_id", "target", "pos")


def brand_links(links: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """page_id, brand, target, label of links that name a known brand (aliases: spelling to main name), each brand and target once; Latin spellings stand between other characters than letters and digits."""
    each = None
    for a in aliases:
        word = rf"(?i)(?<![A-Za-z0-9])\Q{a}\E(?![A-Za-z0-9])" if any(c.isascii() and c.isalnum() for c in a) else rf"\Q{a}\E"
        hit = F.when(F.col("label").rlike(word), F.lit(a))
        each = [hit] if each is None else [*each, hit]
    rows = _targets(links).withColumn("alias", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    rows = rows.withColumn("brand", canonical_brand("alias", aliases))
    w = Window.partitionBy("page_id", "brand", "href").orderBy("pos")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("page_id", "brand", "target", "label")


def owner_link(links: DataFrame, least: float = 0.3) -> DataFrame:
    """page_id, target, label, score of the link of a page that best fits a page for future franchisees, of equal ones the first; links for staff don't count."""
    rows = _targets(links).where((F.col("href") != "") & (F.col("label") != "") & ~F.startswith("href", F.lit("#")) & ~F.startswith("href", F.lit("mailto:")) & ~_any(F.col("label"), STAFF_TEXTS))
    low = F.lower("href")
    score = F.when(_any(F.col("label"), OWNER_TEXTS), 0.5).when(_any(F.col("label"), OWNER_WORDS), 0.2).otherwise(0.0) + F.when(_any(low, OWNER_PATHS), 0.3).when(_any(low, OWNER_PARTS), 0.1).otherwise(0.0)
    scored = rows.withColumn("score", F.round(score, 4)).where(F.col("score") >= least)
    order = F.struct((-F.col("score")).alias("s"), "pos")
    return scored.groupBy("page_id").agg(F.min_by("target", order).alias("target"), F.substring(F.min_by("label", order), 1, 80).alias("label"), F.max("score").alias("score"))


def store_candidates(pages: DataFrame) -> DataFrame:
    """page_id, address, name of each address on a page (page_id, html), once: the last heading that stands in the 200 characters before it."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "), r"\s+", " ")
    heads = F.concat(F.regexp_extract_all("html", F.lit(r"(?i)<h[1-6][^>]*>([^<]+)</h[1-6]>"), F.lit(1)), F.regexp_extract_all("html", F.lit(r"(?i)<li[^>]*>\s*<[^>]+>([^<]+)<"), F.lit(1)))
    heads = F.filter(F.transform(heads, lambda h: F.trim(F.regexp_replace(h, r"\s+", " "))), lambda h: (h != "") & (F.length(h) < 100))
    rows = pages.select("page_id", text.alias("t"), heads.alias("heads"))
    hits, gaps = F.regexp_extract_all("t", F.lit(STORE_ADDRESS), F.lit(0)), F.split("t", STORE_ADDRESS, -1)
    each = rows.select("page_id", "heads", hits.alias("m"), F.regexp_extract_all("t", F.lit(STORE_ADDRESS), F.lit(1)).alias("a"), gaps.alias("g"))
    before = text_before(F.col("m"), F.col("g"))
    spread = each.select("page_id", "heads", F.posexplode(F.arrays_zip(F.col("a"), before.alias("b"))).alias("i", "x")).select("page_id", "heads", "i", F.regexp_replace("x.a", "[。、,.]+$", "").alias("address"), "x.b")
    near = F.filter("heads", lambda h: F.contains("b", h))
    named = spread.select("page_id", "i", "address", F.when(F.size(near) > 0, F.element_at(near, -1)).otherwise(NAMELESS).alias("name"))
    w = Window.partitionBy("page_id", "address").orderBy("i")
    return named.withColumn("r", F.row_number().over(w)).where("r = 1").select("page_id", "address", "name")


def job_page(html: Column, text: Column) -> Column:
    """struct(store_name, operator_name, address, reason) of a page that offers work in a store: its second heading's words, the employer behind a label, and the last address."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<h2[^>]*>(.*?)</h2>", 1), r"<[^>]+>", " "), r"\s+", " "))
    raw = F.regexp_extract(text, f"{EMPLOYER}({_CORP})", 1)
    who = operator_name(F.regexp_replace(raw, "^[ 「」『』【】()（）]+|[ 「」『』【】()（）]+$", ""))
    addresses = F.regexp_extract_all(text, F.lit(JOB_ADDRESS), F.lit(1))
    reason = F.when(F.coalesce(html, F.lit("")) == "", "empty_html").when(raw == "", "operator_label_missing").when(who == "", "operator_empty").otherwise("")
    ok = reason == ""
    return F.struct(name.alias("store_name"), F.when(ok, who).otherwise("").alias("operator_name"), F.when(ok & (F.size(addresses) > 0), F.trim(F.element_at(addresses, -1))).otherwise("").alias("address"), reason.alias("reason"))


def phone_page_companies(text: Column) -> Column:
    """Companies on a page that a phone number leads to, 5 to 40 characters long, in their order, without debris of portals."""
    names = F.regexp_extract_all(text, F.lit(r"((?:株式会社|有限会社|合同会社)[一-龥ぁ-んァ-ヶA-Za-z0-9・ー]{2,30}|[一-龥ァ-ヶA-Za-z0-9・ー]{2,30}(?:株式会社|有限会社|合同会社))"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n).between(5, 40) & ~_any(n, PORTAL_PARTS)))


def of_targets(rows: DataFrame, targets: list[str], aliases: dict[str, str]) -> DataFrame:
    """Rows whose brand, or the main name of its spelling, is a target; all rows without targets."""
    kept = [t.strip() for t in targets if t.strip()]
    return rows.where(F.col("brand").isin(kept) | canonical_brand("brand", aliases).isin(kept)) if kept else rows
