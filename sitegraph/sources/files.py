"""Readers and writers of the files that the domain uses."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import brand_list, brand_variants, canonical_brand, canonical_key, first_filled, nz, operator_name, thousand_yen, whole_number
from ..ship import ship

PLACE = "places array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,location:struct<latitude:double,longitude:double>,websiteUri:string,nationalPhoneNumber:string,internationalPhoneNumber:string>>"
ESTAT = "GET_STATS_DATA struct<STATISTICAL_DATA:struct<DATA_INF:struct<VALUE:array<struct<`@area`:string,`@cat01`:string,`$`:string>>>>>"
GBIZ = ("corporate_number", "name", "postal_code", "location", "representative_name", "representative_title", "capital_stock", "employee_number", "business_summary", "kind", "update_date", "close_date")
#: Positions of the registry's columns.
POSITIONS = {"corporate_number": 1, "process": 2, "update_date": 4, "name": 6, "prefecture": 9, "city": 10, "street": 11}
LEAST_COLUMNS = 12
STORE_FIELDS = ["place_id", "brand", "name", "address", "lat", "lng", "official_url", "phone", "grid_cell_id", "extracted_at"]
LINK_FIELDS = ["brand_name", "industry", "operator_name", "corporate_number", "head_office", "prefecture", "operator_type", "estimated_store_count", "source", "source_url", "note"]


# -- the registry ----------------------------------------------------------------------------------


def registry_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Headerless corporate registry of a known encoding, split over tasks: rows of twelve columns or more with a number of 13 digits."""
    raw = spark.read.option("encoding", encoding).option("multiLine", True).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(30))).csv(path)
    rows = raw.where(F.col("c1").rlike(r"^\d{13}$") & F.col(f"c{LEAST_COLUMNS - 1}").isNotNull())
    return _registry(rows.select(*[F.col(f"c{i}").alias(n) for n, i in POSITIONS.items()]))


def _registry(rows: DataFrame) -> DataFrame:
    return rows.withColumn("normalized_name", canonical_key("name"))


def decode(raw: bytes, preferred: str = "") -> str:
    """Text of bytes: by a byte order mark, the preferred encoding, UTF-8 or CP932, whichever fits first; else UTF-8 with marks for what doesn't fit."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw.decode("utf-8-sig", errors="replace")
    for e in (preferred, "utf-8", "cp932", "utf-8-sig"):
        if e:
            try:
                return raw.decode(e)
            except (UnicodeDecodeError, LookupError):
                pass
    return raw.decode("utf-8", errors="replace")


def registry_files(spark: SparkSession, path: str, preferred: str = "") -> DataFrame:
    """Registry rows of CSV files of any encoding, plain or in zip archives; a file is one task's, as its encoding counts for all of it."""
    ship(spark)

    def members(content: bytes) -> Iterator[bytes]:
        if content[:2] != b"PK":
            yield content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in sorted(z.namelist()):
                if n.lower().endswith(".csv"):
                    yield z.read(n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[list[str]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in POSITIONS.values()], names=list(POSITIONS))

        for b in batches:
            for content in b.column("content").to_pylist():
                for raw in members(content):
                    held: list[list[str]] = []
                    for r in csv.reader(io.StringIO(decode(raw, preferred))):
                        if len(r) >= LEAST_COLUMNS and re.fullmatch(r"[0-9]{13}", r[1]):
                            held.append(r)
                        if len(held) >= 5000:
                            yield batch(held)
                            held = []
                    if held:
                        yield batch(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return _registry(files.mapInArrow(run, ", ".join(f"{n} string" for n in POSITIONS)))


def latest(registry: DataFrame) -> DataFrame:
    """The last update of each corporate number."""
    w = Window.partitionBy("corporate_number").orderBy(F.desc("update_date"), "name")
    return registry.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingested(old: DataFrame, new: DataFrame) -> DataFrame:
    """The kept table after new rows: theirs replace those of the same number, the last update first."""
    fresh = latest(new)
    return old.join(fresh.select("corporate_number"), "corporate_number", "left_anti").unionByName(fresh, allowMissingColumns=True)


def registry_xml(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers of the registry's web service."""
    fields = ("corporateNumber", "name", "prefectureName", "cityName", "streetNumber", "process", "updateDate")
    rows = spark.read.format("xml").option("rowTag", "corporation").schema(", ".join(f"{f} string" for f in fields)).load(path)
    t = lambda c: F.trim(nz(c))
    return rows.select(t("corporateNumber").alias("corporate_number"), t("name").alias("name"), F.concat(t("prefectureName"), t("cityName"), t("streetNumber")).alias("address"), t("process").alias("process"), t("updateDate").alias("update_date"))


def gbiz_json(spark: SparkSession, path: str) -> DataFrame:
    """Recorded company details; entries without a number go, blanks are empty."""
    schema = f"`hojin-infos` array<struct<{','.join(f'{f}:string' for f in GBIZ)}>>"
    h = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("hojin-infos").alias("h"))
    rows = h.select(*[F.trim(nz(F.col(f"h.{f}"))).alias("address" if f == "location" else f) for f in GBIZ])
    return rows.where("corporate_number <> ''")


# -- recorded answers --------------------------------------------------------------------------------


def places_json(spark: SparkSession, path: str) -> DataFrame:
    """Recorded search answers as stores; the national phone number before the international one."""
    p = spark.read.schema(PLACE).json(path).select(F.explode("places").alias("p"))
    return p.select(F.col("p.id").alias("place_id"), F.col("p.displayName.text").alias("name"), F.col("p.formattedAddress").alias("address"), F.col("p.location.latitude").alias("lat"), F.col("p.location.longitude").alias("lng"), F.col("p.websiteUri").alias("official_url"), F.coalesce("p.nationalPhoneNumber", "p.internationalPhoneNumber", F.lit("")).alias("phone"))


def osm_json(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]] | None = None, tag: tuple[str, str] | None = None) -> DataFrame:
    """Recorded map elements; ways have a centre instead of a point. Optionally those in a box (south, west, north, east) and with a tag whose value matches a pattern."""
    e = spark.read.schema("elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>").json(path).select(F.explode("elements").alias("e"))
    rows = e.select(F.concat_ws("/", "e.type", "e.id").alias("osm_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"), F.col("e.tags").alias("tags"))
    if boxes:
        inside = F.lit(False)
        for s, w, n, o in boxes:
            inside = inside | (F.col("lat").between(s, n) & F.col("lng").between(w, o))
        rows = rows.where(inside)
    return rows.where(nz(F.element_at("tags", tag[0])).rlike(tag[1])) if tag else rows


def osm_of_brand(elements: DataFrame, aliases: list[str]) -> DataFrame:
    """Elements whose name, brand or operator, in any of their languages, holds an alias, and that don't say they are another brand."""
    names = [f"{t}{k}" for t in ("name", "brand", "operator") for k in ("", ":ja", ":en")]
    held = F.lower(F.concat_ws("\n", *[F.element_at("tags", n) for n in names]))
    hit = F.lit(False)
    for a in aliases:
        hit = hit | F.contains(held, F.lit(a.lower()))
    return elements.where(hit & ~F.exists(F.map_keys("tags"), lambda k: F.startswith(k, F.lit("not:brand"))))


def estat_json(spark: SparkSession, path: str) -> DataFrame:
    """Area, industry, count of recorded statistics; what is no number counts 0."""
    v = spark.read.schema(ESTAT).json(path).select(F.explode("GET_STATS_DATA.STATISTICAL_DATA.DATA_INF.VALUE").alias("v"))
    return v.select(F.col("v.`@area`").alias("area"), F.col("v.`@cat01`").alias("industry"), F.coalesce(F.expr("try_cast(v.`$` as bigint)"), F.lit(0)).alias("n"))


def filings_json(spark: SparkSession, path: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Recorded list of filings, optionally of some document types."""
    r = spark.read.schema("results array<struct<docID:string,filerName:string,JCN:string,docTypeCode:string,docDescription:string>>").option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    rows = r.select(F.col("r.docID").alias("doc_id"), nz(F.col("r.filerName")).alias("filer"), nz(F.col("r.JCN")).alias("corporate_number"), nz(F.col("r.docTypeCode")).alias("type"), nz(F.col("r.docDescription")).alias("description"))
    return rows.where(F.col("type").isin(*types)) if types else rows


def filing_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html of each filing archive: its longest public page."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, pages = b.column("path").to_pylist(), []
            for content in b.column("content").to_pylist():
                best = b""
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        held = [i for i in z.infolist() if "PublicDoc" in i.filename and i.filename.lower().endswith((".htm", ".html"))]
                        best = z.read(max(held, key=lambda i: i.file_size)) if held else b""
                except zipfile.BadZipFile:
                    pass
                pages.append(best.decode("utf-8", errors="replace"))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(pages, pa.string())], names=["path", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, html string")


# -- hand-written tables -----------------------------------------------------------------------------


def sections_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a manual table whose comment lines switch the section: section, line, fields; no headers, blanks or X rows.

    The files are written by hand, so a file is one partition.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(F.when(F.startswith("value", F.lit("#")), F.trim(F.regexp_replace("value", "^#+", ""))), ignorenulls=True).over(order))
    fields = F.split("value", "\t")
    return rows.where((F.trim("value") != "") & ~F.startswith(F.col("value"), F.lit("#"))).select("section", "line", fields.alias("fields")).where((F.size("fields") >= 2) & (F.trim(F.col("fields")[0]) != "X"))


def manual_rows(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """Companies of the manual table by section: operators (ten fields or more, with brands) and headquarters (twelve or more, with a brand); amounts in thousands of yen."""
    lines = sections_tsv(spark, path).withColumn("head", F.contains(nz("section"), F.lit("franchisor")))
    f = lambda i: F.trim(nz(F.get("fields", F.lit(i))))
    rows = lines.where((f(0) != "") & (f(0) != "企業名"))
    low = rows.where(~F.col("head") & (F.size("fields") >= 10)).select(F.lit("megajii").alias("section"), "line", f(0).alias("name"), F.lit("").alias("brand"), f(1).alias("industry"), f(2).alias("count"), f(3).alias("representative"), f(4).alias("address"), f(5).alias("now"), f(6).alias("then"), f(8).alias("website"), f(9).alias("raw_brands"), F.lit("").alias("recruit_url"))
    low = low.where((F.col("raw_brands") != "") & (F.upper("raw_brands") != "X"))
    high = rows.where(F.col("head") & (F.size("fields") >= 12)).select(F.lit("franchisor").alias("section"), "line", f(0).alias("name"), canonical_brand(f(1), aliases).alias("brand"), f(2).alias("industry"), f(3).alias("count"), f(4).alias("representative"), f(5).alias("address"), f(6).alias("now"), f(7).alias("then"), f(9).alias("website"), f(10).alias("raw_brands"), f(11).alias("recruit_url"))
    both = low.unionByName(high.where("brand <> ''"))
    return both.select("section", "line", "name", "brand", "industry", whole_number("count").alias("store_count"), "representative", "address", thousand_yen("now").alias("revenue_current_jpy"), thousand_yen("then").alias("revenue_previous_jpy"), "website", "raw_brands", brand_list("raw_brands", aliases).alias("brands"), "recruit_url")


def imported_links(rows: DataFrame, numbers: DataFrame, source: str) -> DataFrame:
    """A link for each brand of a manual row (manual_rows); operators without a verified number (numbers: name, corporate_number) get a source of their own."""
    known = numbers.select(F.col("name").alias("operator_name"), "corporate_number")
    each = rows.where("section = 'megajii'").select(operator_name("name").alias("operator_name"), F.explode("brands").alias("brand"), "store_count").join(known, "operator_name", "left")
    return each.select("brand", "operator_name", nz("corporate_number").alias("corporate_number"), F.col("store_count").alias("estimated_store_count"), F.lit("franchisee").alias("operator_type"), F.when(nz("corporate_number") != "", F.lit(source)).otherwise(F.lit(f"{source}_unverified")).alias("source"))


def seeds_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def seed_brands(seeds: DataFrame, aliases: dict[str, str], targets: list[str], key) -> DataFrame:
    """brand, seed_brand, franchisor of seed rows (franchisor_name, brand_name): every variant, without target brands, the first of equal keys (key: Column function) of brand and franchisor."""
    rows = seeds.withColumn("seq", F.monotonically_increasing_id()).select("seq", operator_name("franchisor_name").alias("franchisor"), F.trim(nz("brand_name")).alias("seed_brand")).where("franchisor <> '' and seed_brand <> ''")
    each = rows.select("*", F.posexplode(brand_variants("seed_brand", aliases)).alias("i", "brand")).where(~F.col("brand").isin(*targets))
    w = Window.partitionBy(key(F.col("brand")), canonical_key("franchisor")).orderBy("seq", "i")
    return each.withColumn("r", F.row_number().over(w)).where("r = 1").select("brand", "seed_brand", "franchisor")


def _yaml(spark: SparkSession, path: str) -> list[dict]:
    """Documents of YAML files by hand, a few kilobytes each."""
    import yaml

    return [yaml.safe_load(r[0]) or {} for r in spark.read.text(path, wholetext=True).collect()]


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """brand, operator_name, corporate_number, head_office, estimated_store_count, kind of a registry of brands by hand: known franchisees, and brands of operators of several."""
    rows = []
    for doc in _yaml(spark, path):
        for brand, spec in (doc.get("brands") or {}).items():
            for f in (spec or {}).get("known_franchisees") or []:
                rows.append((brand, f["name"], str(f.get("corporate_number") or ""), str(f.get("head_office") or ""), int(f.get("estimated_store_count") or 0), int(f.get("estimated_store_count") or 0), "franchisee"))
        for m in doc.get("multi_brand_operators") or []:
            held = {str(b): int(n) for b, n in (m.get("brands") or {}).items() if str(n).lstrip("-").isdigit()}
            total = int(m.get("total_stores") or sum(held.values()))
            rows += [(b, str(m["name"]), str(m.get("corporate_number") or ""), str(m.get("head_office") or ""), n, total, "multi_brand") for b, n in held.items()]
    return spark.createDataFrame(rows, "brand string, operator_name string, corporate_number string, head_office string, estimated_store_count int, total_stores int, kind string")


def registry_stores(known: DataFrame, confidence: float = 0.95) -> DataFrame:
    """A placeholder store for each store of knowledge(): at least one for a franchisee; those of operators of several brands unless the operator has as many of the brand already."""
    number = F.when(nz("corporate_number") == "", "no-no").otherwise(F.col("corporate_number"))
    spread = lambda df, n: df.withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    first = spread(known.where("kind = 'franchisee'"), F.greatest("estimated_store_count", F.lit(1))).select("operator_name", "brand", F.concat_ws(":", F.lit("REG"), number, "i").alias("place_id"), F.lit("registry").alias("discovered_via"), "corporate_number").dropDuplicates(["operator_name", "place_id"])
    have = first.groupBy("operator_name", "brand").agg(F.count("*").alias("have"))
    more = known.where("kind = 'multi_brand' and estimated_store_count > 0").join(have, ["operator_name", "brand"], "left").where(F.coalesce("have", F.lit(0)) < F.col("estimated_store_count"))
    slug = F.regexp_replace("brand", "[ /]", "")
    second = spread(more, F.col("estimated_store_count")).select("operator_name", "brand", F.concat_ws(":", F.lit("REG-MBO"), number, slug, "i").alias("place_id"), F.lit("registry_mbo").alias("discovered_via"), "corporate_number")
    return first.unionByName(second).withColumns({"operator_type": F.lit("franchisee"), "confidence": F.lit(confidence)})


def brand_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """brand, pattern of a table of conflicts by hand; blank patterns go."""
    rows = [(b, str(c.get("pattern") or "")) for doc in _yaml(spark, path) for b, spec in (doc.get("brands") or {}).items() for c in (spec or {}).get("conflicts") or []]
    return spark.createDataFrame([r for r in rows if r[1].strip()], "brand string, pattern string")


def territory_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(brands, industries) of a table of distances by hand, as territories() takes them."""
    own = ("dominant_min_m", "dominant_typical_m", "territory_max_m")
    number = lambda v: None if v is None else float(v)
    brands, industries = [], []
    for doc in _yaml(spark, path):
        brands += [(b, (x or {}).get("industry", ""), *[number((x or {}).get(c)) for c in own]) for b, x in (doc.get("brands") or {}).items()]
        industries += [(i, str((x or {}).get("strategy", "unknown")), *[number((x or {}).get(c)) for c in own]) for i, x in (doc.get("industries") or {}).items()]
    numbers = ", ".join(f"{c} double" for c in own)
    return spark.createDataFrame(brands, f"brand string, industry string, {numbers}"), spark.createDataFrame(industries, f"industry string, strategy string, {numbers}")


# -- pages -------------------------------------------------------------------------------------------

_strip = lambda html: F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
#: Marks of companies and bodies, and what a line about a trade rather than a brand holds.
BODIES = ("株式会社", "有限会社", "合同会社", "一般社団法人", "公益社団法人", "（株）", "(株)", "㈱", "（有）", "(有)", "㈲")
TRADE_PHRASES = ("事業", "サービス", "の提供", "の運営", "の販売", "の開発", "の設置", "の展開", "の製造", "の輸出入", "の管理", "コンサル", "ソリューション", "等の", "及び", "並びに", "等に係る", "に関する", "マニュアル")
INDUSTRIES = ("飲食", "小売", "宿泊", "教育", "理美容", "外食", "コンビニ", "不動産", "サービス業")
LONGEST_BRAND = 40


def _quoted(words: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def _company(name: Column) -> Column:
    """Without Latin words behind it, its form written out."""
    s = F.trim(name)
    for a, b in (("（株）", "株式会社"), ("(株)", "株式会社"), ("㈱", "株式会社"), ("（有）", "有限会社"), ("(有)", "有限会社"), ("㈲", "有限会社")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+[A-Za-z0-9&.,'\-\s()]+$", ""))


def member_index(pages: DataFrame) -> DataFrame:
    """operator_name, brand, industry, url, source_url of each row of a member list (url, html), a company once a page.

    The company stands in the first cell, else in any; the second cell has the brand and behind it
    the trade, or the trade alone.
    """
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("i", "tr"))
    cells = rows.select("url", "i", "tr", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("td")).where(F.size("td") > 0)
    texts = F.transform("td", _strip)
    named = F.filter(texts, lambda t: t.rlike(_quoted(BODIES)))
    one = F.when(texts[0].rlike(_quoted(BODIES)), texts[0]).otherwise(F.get(named, 0))
    parts = F.filter(F.split(one, r"／|/|、"), lambda p: p.rlike(_quoted(BODIES)))
    name = F.substring(F.trim(F.coalesce(F.get(parts, 0), one)), 1, 100)
    lines = F.filter(F.transform(F.split(F.coalesce(F.get("td", F.lit(1)), F.lit("")), r"(?i)<br\s*/?>|\n"), _strip), lambda x: x != "")
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    trade = first.rlike(_quoted(TRADE_PHRASES)) | (F.length(first) > LONGEST_BRAND)
    rest = F.when(trade, F.substring(first, 1, 120)).otherwise(F.substring(F.array_join(F.slice(lines, 2, 1000), " "), 1, 120))
    other = F.get(F.filter(texts, lambda t: ~t.rlike(_quoted(BODIES)) & t.rlike(_quoted(INDUSTRIES))), 0)
    out = cells.select("url", "i", name.alias("raw"), F.when(trade, "").otherwise(F.substring(first, 1, 100)).alias("brand"), first_filled(rest, F.substring(other, 1, 40)).alias("industry"), F.regexp_extract("tr", r'(?is)<a\s[^>]*href="([^"]*)"', 1).alias("link")).where(nz("raw") != "")
    w = Window.partitionBy("url", "raw").orderBy("i")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select(_company(F.col("raw")).alias("operator_name"), "brand", "industry", F.col("link").alias("url"), F.col("url").alias("source_url"))


def disclosure_index(pages: DataFrame, root: str) -> DataFrame:
    """franchisor, brand, industry, pdf_url of each link to a document on a disclosure page (html), each once; comments don't count."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tables = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*class=[\"'][^\"']*tbl_kaiji[^>]*>(.*?)</table>"), F.lit(1))).alias("t"))
    rows = tables.select(_strip(F.regexp_extract("t", r"(?is)<th[^>]*thColor01[^>]*>(.*?)</th>", 1)).alias("industry"), F.explode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    cells = rows.select("industry", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("td")).where(F.size("td") >= 2)
    anchor = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    links = cells.select("industry", _strip(F.col("td")[0]).alias("raw"), F.explode(F.regexp_extract_all(F.col("td")[1], F.lit(anchor), F.lit(0))).alias("a")).where("raw not in ('', '-')")
    href, brand = F.regexp_extract("a", anchor, 1), _strip(F.regexp_extract("a", anchor, 2))
    out = links.select(_company(F.col("raw")).alias("franchisor"), brand.alias("brand"), "industry", href.alias("href")).where(F.contains(F.lower("href"), F.lit(".pdf")) & ~F.col("brand").isin("", "-"))
    return out.select("franchisor", "brand", "industry", F.when(F.col("href").rlike("^https?:"), F.col("href")).otherwise(F.concat(F.lit(root.rstrip("/")), "href")).alias("pdf_url")).distinct()


def official_list(pages: DataFrame, root: str) -> DataFrame:
    """prefecture, name, address, url, slug of each store of an official list's page (prefecture, html)."""
    card = r'(?s)<li>\s*<a\s+href="(/[^"]+/)">(.*?)</a>\s*</li>'
    rows = pages.select("prefecture", F.explode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("c")).select("prefecture", F.regexp_extract("c", card, 1).alias("href"), F.regexp_extract("c", card, 2).alias("body"))
    part = lambda c: _strip(F.regexp_extract("body", rf'(?s)<p class="{c}">(.*?)</p>', 1))
    out = rows.select("prefecture", part("name").alias("name"), part("address").alias("address"), F.concat(F.lit(root.rstrip("/")), "href").alias("url"), F.element_at(F.split(F.regexp_replace("href", "/+$", ""), "/"), -1).alias("slug"))
    return out.where("name <> '' and address <> '' and slug <> ''")


#: Headings of the part of a filing about related companies, and how long that part is at most.
RELATED_HEADINGS = ("関係会社の状況", "関係会社")
RELATED_CHARS = 15_000


def related_companies(pages: DataFrame, key: str) -> DataFrame:
    """key, name of companies in the part of a filing's page (html) about related companies, or in all of it if there is no such part, each once."""
    part = F.lit(None).cast("string")
    for h in reversed(RELATED_HEADINGS):
        part = F.when(F.contains("html", F.lit(h)), F.substring(F.col("html"), F.instr("html", h), F.lit(RELATED_CHARS))).otherwise(part)
    names = F.regexp_extract_all(_strip(F.coalesce(part, "html")), F.lit(r"((?:株式会社|有限会社|合同会社)[一-龥ぁ-んァ-ヶA-Za-z0-9・ー]{2,30}|[一-龥ァ-ヶA-Za-z0-9・ー]{2,30}(?:株式会社|有限会社|合同会社))"), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(names)).alias("name")).where(F.length("name") >= 5)


# -- sinks -------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | list[Column]) -> None:
    """One file with these fields in this order of rows, for reports; missing fields are empty."""
    df.orderBy(*order).select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields]).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_stores(stores: DataFrame, path: str, brand: str = "") -> None:
    """Stores with a fixed header, in the order in which they were found; numbers in their shortest form."""
    rows = stores.where(F.col("brand") == brand) if brand else stores
    write_csv(rows, path, STORE_FIELDS, ["extracted_at", "place_id"])


def write_links(links: DataFrame, path: str, source: str = "") -> None:
    """All links (with id), optionally of one source, the greatest counts first."""
    rows = links.where(F.col("source") == source) if source else links
    write_csv(rows, path, LINK_FIELDS, [F.desc("estimated_store_count"), F.asc("id")])


def safe_name(c: Column | str) -> Column:
    """A name that a file can bear."""
    s = F.regexp_replace(F.regexp_replace(nz(c), r'[\\/:*?"<>|]', "_"), r"^[\s.]+|[\s.]+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def write_by_brand(df: DataFrame, path: str, min_rows: int = 1) -> None:
    """A folder for each brand, by a name that files can bear, of min_rows rows or more; what lay there goes."""
    n = df.groupBy("brand").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).drop("_n")
    df.join(n, "brand", "left_semi").withColumn("folder", safe_name("brand")).write.mode("overwrite").partitionBy("folder").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_candidates(df: DataFrame, path: str, key: str, most: int = 1000) -> None:
    """A review file in YAML of a short list, ordered by key; a longer one than a person reviews is an error."""
    import yaml

    rows = df.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates to review")
    body = yaml.safe_dump({"candidates": [r.asDict(recursive=True) for r in rows]}, allow_unicode=True, sort_keys=False)
    df.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_audit(coverage: DataFrame, unknown: DataFrame, missing: DataFrame, path: str) -> None:
    """Three files beside each other: coverage by operator, stores that nobody claims, operators that were not found."""
    write_csv(coverage, path, ["operator_name", "head_office", "website", "registered", "matched", "coverage_pct", "corporate_number"], ["operator_name"])
    write_csv(unknown, f"{path}-unknown-stores", ["place_id", "name", "address", "lat", "lng", "official_url"], ["place_id"])
    write_csv(missing.withColumn("reason", F.lit("top-down search by operator returned 0 hits")), f"{path}-missing-operators", ["operator_name", "reason"], ["operator_name"])


def write_sidecars(candidates: DataFrame, attempts: DataFrame, path: str, order: list[str]) -> None:
    """What a reviewer sorts: all candidates, attempts that found nothing, candidates that were not accepted, and those that were."""
    parts = {"candidates": candidates, "failed-urls": attempts.where(~F.coalesce("found", F.lit(False))), "unverified": candidates.where(~F.coalesce("accepted", F.lit(False))), "accepted": candidates.where("accepted")}
    for name, df in parts.items():
        write_csv(df, f"{path}-{name}", df.columns, [c for c in order if c in df.columns])
