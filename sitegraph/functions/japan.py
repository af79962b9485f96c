"""Japanese addresses, areas and store keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import brand_pattern, nfkc, normalize_address, nz

#: The prefectures, from north to south.
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県",
    "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県",
    "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県",
    "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
#: Cities whose wards count as cities.
DESIGNATED_CITIES = (
    "札幌市", "仙台市", "さいたま市", "千葉市", "横浜市", "川崎市", "相模原市", "新潟市", "静岡市", "浜松市",
    "名古屋市", "京都市", "大阪市", "堺市", "神戸市", "岡山市", "広島市", "北九州市", "福岡市", "熊本市",
)
#: Prefectures of few and of many stores, and the factors of their cells.
SPARSE = ("北海道", "岩手県", "秋田県", "青森県", "山形県", "福島県", "新潟県", "長野県", "鳥取県", "島根県", "高知県", "鹿児島県", "沖縄県")
DENSE = ("東京都", "大阪府", "神奈川県", "愛知県", "埼玉県", "千葉県", "兵庫県", "福岡県")
SPARSE_FACTOR, DENSE_FACTOR = 2.5, 0.6
#: The prefecture at the head of an address, in its loose form.
LOOSE_PREFECTURE = r"^(北海道|東京都|大阪府|京都府|.{2,3}県)"
POSTAL = r"^〒?\d{3}[-‐]?\d{4}\s*"
#: Boxes (south, west, north, east) that hold the country.
JAPAN_BOXES = ((24.0, 122.0, 29.2, 132.0), (28.0, 129.0, 46.0, 146.5))
#: Kanji digits, and characters that stand for a hyphen.
KANJI_DIGITS = ("〇零一二三四五六七八九", "00123456789")
HYPHENS = "‐‑‒–—―−ーｰ"


def prefecture_prefix(address: Column | str) -> Column:
    """The loose prefecture at the head of an address, else empty."""
    return F.regexp_extract(nz(address), LOOSE_PREFECTURE, 1)


def prefecture_in(address: Column | str) -> Column:
    """The first prefecture, in their order, that an address holds anywhere, blanks aside; else empty."""
    solid = F.regexp_replace(nz(address), r"[\s　]+", "")
    return F.coalesce(*[F.when(F.contains(solid, F.lit(p)), F.lit(p)) for p in PREFECTURES], F.lit(""))


def parse_address(raw: Column | str) -> Column:
    """struct(pref, city, rest, normal): one of the prefectures, then a city, with its ward where it is a designated one."""
    normal = normalize_address(raw)
    pref = F.regexp_extract(normal, f"^({'|'.join(PREFECTURES)})", 1)
    tail = F.substring(normal, F.length(pref) + 1, F.length(normal))
    large = F.regexp_extract(tail, f"^({'|'.join(DESIGNATED_CITIES)})", 1)
    ward = F.regexp_extract(F.substring(tail, F.length(large) + 1, F.length(tail)), r"^([^0-9０-９\-‐-―−]+?区)", 1)
    city = F.when(large != "", F.concat(large, ward)).otherwise(F.regexp_extract(tail, "^(.+?(?:市|区|郡|町|村))", 1))
    return F.struct(pref.alias("pref"), city.alias("city"), F.trim(F.substring(tail, F.length(city) + 1, F.length(tail))).alias("rest"), normal.alias("normal"))


def place_parts(raw: Column | str) -> Column:
    """struct(pref, city, town) by loose patterns; all empty without a prefecture."""
    s = F.trim(F.regexp_replace(nz(raw), POSTAL, ""))
    pref = F.regexp_extract(s, LOOSE_PREFECTURE, 1)
    tail = F.substring(s, F.length(pref) + 1, F.length(s))
    city = F.when(pref != "", F.regexp_extract(tail, "^([一-龥ぁ-んァ-ヶ]{1,8}(?:市|区|町|村))", 1)).otherwise("")
    rest = F.substring(tail, F.length(city) + 1, F.length(tail))
    town = F.when(pref != "", F.regexp_extract(rest, "^([一-龥ぁ-んァ-ヶ]{1,6})", 1)).otherwise("")
    return F.struct(pref.alias("pref"), city.alias("city"), town.alias("town"))


def block_address(raw: Column | str) -> Column:
    """Address without blanks, postal code and building, its numbers as digits between hyphens."""
    s = F.translate(F.regexp_replace(nz(raw), r"[\s　]+", ""), "０１２３４５６７８９" + KANJI_DIGITS[0], "0123456789" + KANJI_DIGITS[1])
    s = F.replace(F.regexp_replace(s, "十([0-9])", "1$1"), F.lit("十"), F.lit("10"))
    s = F.regexp_replace(s, rf"^〒?\d{{3}}[{HYPHENS}\-]?\d{{4}}", "")
    for pattern, new in ((r"(\d+)(?:丁目|番地)", "$1-"), (r"(\d+)番", "$1-"), (r"(\d+)号", "$1"), (r"(\d+)-の(\d+)", "$1-$2"), (r"(\d+)の(\d+)", "$1-$2"), (f"[{HYPHENS}]", "-"), ("-+", "-"), ("-$", ""), (r"(\d+(?:-\d+){1,3})[^\d\-].*$", "$1")):
        s = F.regexp_replace(s, pattern, new)
    return s


def address_key(raw: Column | str, levels: int = 3) -> Column:
    """Prefecture, city, town and the first numbers, at most three (address equality) or fewer (neighbouring blocks)."""
    s = block_address(raw)
    p = place_parts(s)
    head = F.concat(p["pref"], p["city"], p["town"])
    number = F.regexp_extract(F.substring(s, F.length(head) + 1, F.length(s)), rf"^(\d{{1,3}}(?:-\d{{1,3}}){{0,{levels - 1}}})", 1)
    return F.when((p["pref"] == "") | (p["city"] == ""), F.substring(s, 1, 40)).otherwise(F.concat(head, number))


def resolve_prefecture(head_office: Column, stored: Column, by_number: Column, by_name: Column) -> Column:
    """Of the head office's address, else the stored one, else the registry's by number, else by name."""
    own = F.regexp_extract(nz(head_office), f"^({'|'.join(PREFECTURES)})", 1)
    return F.coalesce(*[F.nullif(nz(c), F.lit("")) for c in (own, stored, by_number, by_name)], F.lit(""))


def cell_km(area: Column | str, km: float) -> Column:
    """Edge of the search cells of an area by the density of its stores."""
    a = F.col(area) if isinstance(area, str) else area
    return F.when(a.isin(*SPARSE), km * SPARSE_FACTOR).when(a.isin(*DENSE), km * DENSE_FACTOR).otherwise(km)


def in_japan(lat: Column, lng: Column, country: Column) -> Column:
    """In a box of the country, unless a country tag names another one."""
    tag = F.upper(F.trim(nz(country)))
    inside = F.lit(False)
    for s, w, n, e in JAPAN_BOXES:
        inside = inside | (lat.between(s, n) & lng.between(w, e))
    return inside & ((tag == "") | tag.isin("JP", "JPN") | F.contains(tag, F.lit("日本")))


def store_core(name: Column | str, brands: list[str]) -> Column:
    """A store's name without its brand before it, a remark in brackets and the word for shop behind it."""
    s = F.regexp_replace(F.regexp_replace(nz(name), r"\s+", ""), "^【[^】]+】", "")
    s = F.regexp_replace(s, brand_pattern([b.replace(" ", "") for b in brands]), "")
    return F.regexp_replace(F.regexp_replace(s, "(?:店|店舗)$", ""), "^[ 　ー-]+|[ 　ー-]+$", "")


def store_keys(name: Column | str, address: Column | str, phone: Column | str, brands: list[str]) -> Column:
    """What tells a store on a page: its phone, name, core name, and the beginning and town of its address; two characters at least, each once."""
    shown, core = F.trim(nz(name)), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(nz(name)), brand_pattern(brands), ""), "(?:店|店舗)$", ""), "^[ 　ー-]+|[ 　ー-]+$", "")
    long_enough = F.length(core) >= 2
    plain = F.trim(F.regexp_replace(nz(address), POSTAL, ""))
    parts = [
        nz(phone), F.replace(nz(phone), F.lit("-"), F.lit("")), shown, F.when((shown != "") & long_enough, core), F.when((shown != "") & long_enough, F.concat(core, F.lit("店"))),
        F.regexp_extract(plain, "([一-龥]{1,6}(?:市|区|町|村|郡)[一-龥ぁ-んァ-ヶ]{1,12}[0-9０-９])", 1), F.regexp_extract(plain, "(?:市|区|町|村|郡)([^0-9０-９]{2,8})", 1),
    ]
    solid = F.transform(F.array(*parts), lambda k: F.regexp_replace(F.coalesce(k, F.lit("")), r"[\s　]+", ""))
    return F.array_distinct(F.filter(solid, lambda k: F.length(k) >= 2))


def compact(c: Column | str) -> Column:
    """Letters and digits alone, in compatibility form."""
    return F.regexp_replace(nfkc(nz(c)), r"[^\p{L}\p{N}]", "")
