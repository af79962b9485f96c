"""Links, titles and text from recorded pages and documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def plain_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; single blanks."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label of each anchor."""
    hits = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.posexplode(hits).alias("pos", "a"))
    return rows.select("page_id", "pos", F.regexp_extract("a", ANCHOR, 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), r"<[^>]+>", "")).alias("label"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def domain_root(url: Column) -> Column:
    """The host under www, where it is a map or store host."""
    return F.regexp_replace(host(url), r"^(?:map|maps|store|stores|shop|m)\.", "www.")


def evidence_once(rows: DataFrame, prefix: int = 200) -> DataFrame:
    return rows.withColumn("_p", F.substring("snippet", 1, prefix)).dropDuplicates(["doc_id", "_p"]).drop("_p")
