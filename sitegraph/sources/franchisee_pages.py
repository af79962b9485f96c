"""Pages on which brands and operators name who runs their stores, each kind read in its own way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.japan import PREFECTURES
from ..functions.text import nz, operator_name

#: What the pages say. Companies, brands, stores and places by name.
BRAND_OFF_COMPANY, BRAND_OFF_COUNTER = "株式会社K-ブランドオフ", "BRAND OFF買取専門店"
BRAND_OFF_PLACES = ((("仙台",), "宮城県", "仙台市"), (("弘前", "青森"), "青森県", ""), (("函館", "北海道"), "北海道", "函館市"))
KANDON, KANDON_STORE, KANDON_FULL = "韓丼", "韓丼八女店", "カルビ丼とスン豆腐専門店"
BIRION, BIRION_STORES = "ビリオンフーズハヤシ", "(?:大宮|鯖江|丸山)店"
OWNER_WINDOW = 900
CITY = ("([一-龥ぁ-んァ-ヶA-Za-z0-9]+?市(?:[一-龥ぁ-んァ-ヶA-Za-z0-9]+?区)?)", "([一-龥ぁ-んァ-ヶA-Za-z0-9]+?郡[一-龥ぁ-んァ-ヶA-Za-z0-9]+?町)", "([一-龥ぁ-んァ-ヶA-Za-z0-9]+?区)", "([一-龥ぁ-んァ-ヶA-Za-z0-9]+?町)", "([一-龥ぁ-んァ-ヶA-Za-z0-9]+?村)")
ROW = "array<struct<operator_name:string,operator_type:string,estimated_store_count:int,store_names:array<string>,store_address:string,context_prefecture:string,context_city:string,corporate_number:string,note:string>>"

_text = lambda html: F.regexp_replace(F.regexp_replace(F.regexp_replace(nz(html), r"(?is)<(script|style)[^>]*>.*?</\1>", "\n"), r"<[^>]+>", "\n"), r"[ \t]*\n\s*", "\n")
_clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ 　:：、,。]+|[ 　:：、,。]+$", "")
_unique = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ 　、,。]+|[ 　、,。]+$", "")), lambda x: x != ""))


def _row(name: Column, kind: str, count: Column, stores: Column, note: str, address: Column | None = None, pref: Column | None = None, city: Column | None = None, number: Column | None = None) -> Column:
    blank = F.lit("")
    return F.struct(name.alias("operator_name"), F.lit(kind).alias("operator_type"), count.cast("int").alias("estimated_store_count"), stores.alias("store_names"), nz(address if address is not None else blank).alias("store_address"), (pref if pref is not None else blank).alias("context_prefecture"), (city if city is not None else blank).alias("context_city"), nz(number if number is not None else blank).alias("corporate_number"), F.lit(note).alias("note"))


def _lone(holds: Column, row: Column) -> Column:
    return F.when(holds, F.array(row).cast(ROW))


def prefecture_city(address: Column) -> tuple[Column, Column]:
    """The first prefecture, in their order, that an address holds, and behind it the first city, county town, ward, town or village, in that order."""
    pref = F.coalesce(*[F.when(F.contains(address, F.lit(p)), F.lit(p)) for p in PREFECTURES], F.lit(""))
    rest = F.when(pref != "", F.substring(address, F.call_function("instr", address, pref) + F.length(pref), F.length(address))).otherwise("")
    return pref, F.coalesce(*[F.nullif(F.regexp_extract(rest, c, 1), F.lit("")) for c in CITY], F.lit(""))


def brand_profile(t: Column) -> Column:
    """The brand's own company with the number of its stores."""
    count = F.coalesce(F.regexp_extract(t, r"店舗数\s*(\d+)\s*店舗", 1).try_cast("int"), F.lit(0))
    holds = F.contains(t, F.lit(BRAND_OFF_COMPANY)) | F.contains(t, F.lit(BRAND_OFF_COMPANY.replace("株式会社", "株式会社 ")))
    return _lone(holds, _row(F.lit(BRAND_OFF_COMPANY), "franchisor", count, F.array().cast("array<string>"), "official company profile"))


def owner_voices(t: Column) -> Column:
    """A row for each owner, with the stores and the place named before the next owner; stores of the whole page if it names none there."""
    stores = lambda w: _unique(F.filter(F.regexp_extract_all(w, F.lit(r"(BRAND\s*OFF[^\n、,。]*?店)"), F.lit(1)), lambda s: F.trim(s) != BRAND_OFF_COUNTER))
    parts = F.slice(F.split(t, r"加盟者名\s*[：:]\s*(?=[^\n])"), 2, 10_000)

    def row(part: Column, i: Column) -> Column:
        window = F.when(i == F.size(parts) - 1, F.substring(part, 1, OWNER_WINDOW)).otherwise(part)
        own = stores(window)
        held = F.when(F.size(own) > 0, own).otherwise(stores(t))
        pref, city = F.lit(""), F.lit("")
        for words, p, c in reversed(BRAND_OFF_PLACES):
            here = window.rlike("|".join(words))
            pref, city = F.when(here, p).otherwise(pref), F.when(here, c).otherwise(city)
        return _row(_clean(F.regexp_extract(part, r"^([^\n]+)", 1)), "franchisee", F.greatest(F.size(held), F.lit(1)), held, "official FC owner voice", pref=pref, city=city)

    return F.filter(F.transform(parts, row).cast(ROW), lambda r: r["operator_name"] != "")


def press_release(t: Column) -> Column:
    """Operator, store and place of a release about a store that opens."""
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    who = first(r"[◇◆]\s*運営会社\s*[：:\s]*([^\n◇■<]+)", r"運営会社\s*[：:\s]*([^\n◇■<]+)")
    store = first(r"[◇◆]\s*店名\s*[：:\s]*([^\n]+)", r"店名\s*[：:\s]*([^\n]+)")
    address = F.regexp_replace(nz(first(r"[◇◆]\s*所在地\s*[：:\s]*([^\n]+)", r"所在地\s*[：:\s]*([^\n]+)")), r"\s+", "")
    pref, city = prefecture_city(address)
    return _lone(F.contains(t, F.lit(KANDON)) & who.isNotNull(), _row(_clean(nz(who)), "franchisee", F.lit(1), _unique(F.array(nz(store))), "official franchisor press release", address=address, pref=pref, city=city))


def operator_profile(t: Column) -> Column:
    """An operator's own page about its company, with its stores of the brand."""
    who, stores = _clean(F.regexp_extract(t, r"会社名\s*\n?\s*([^\n]+)", 1)), _unique(F.regexp_extract_all(t, F.lit(r"(韓丼[^\n、,。]*?店)"), F.lit(1)))
    number = F.regexp_extract(t, r"法人番号\s*\n?\s*([0-9]{13})", 1)
    return _lone(F.contains(t, F.lit(KANDON_STORE)) & (who != "") & (F.size(stores) > 0), _row(who, "franchisee", F.size(stores), stores, "official operator company profile", pref=F.lit("福岡県"), city=F.lit("八女市"), number=number))


def operator_brand_page(t: Column) -> Column:
    """An operator's page about the brand."""
    who, stores = _clean(F.regexp_extract(t, rf"(株式会社\s*{BIRION})", 1)), _unique(F.regexp_extract_all(t, F.lit(f"({BIRION_STORES})"), F.lit(1)))
    return _lone(F.contains(t, F.lit(KANDON_FULL)) & F.contains(t, F.lit(BIRION)) & (who != "") & (F.size(stores) > 0), _row(who, "franchisee", F.size(stores), stores, "official operator brand page", pref=F.lit("福井県")))


PARSERS = {"brand_off_company": brand_profile, "brand_off_fc": owner_voices, "kandon_prtimes": press_release, "haricom_company": operator_profile, "birion_company": operator_brand_page}


def franchisee_rows(pages: DataFrame) -> DataFrame:
    """Rows of evidence from pages (brand, url, parser, html), each read by its parser; unknown parsers give none."""
    t = _text(F.col("html"))
    rows = F.lit(None).cast(ROW)
    for name, parse in PARSERS.items():
        rows = F.when(F.col("parser") == name, parse(t)).otherwise(rows)
    out = pages.select("brand", F.col("url").alias("source_url"), "parser", F.explode(rows).alias("r")).select("brand", "source_url", "parser", "r.*")
    return out.withColumn("operator_name", operator_name("operator_name")).where("operator_name <> ''")
