"""Japanese names, addresses and pages made from the driver's tables, as expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .domain import read

SURNAMES = ("山田", "佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "中村", "小林", "加藤")
TRADES = ("商事", "フーズ", "企画", "興産", "物産", "サービス", "商店")
MARKS = ("ア", "イ", "ウ", "エ", "オ", "カ", "キ", "ク", "ケ", "コ", "サ")
BRANDS = ("カーブス", "モスバーガー", "業務スーパー", "コメダ珈琲", "ハードオフ", "Kids Duo")
AREAS = (("東京都", "港区", "芝浦"), ("北海道", "札幌市中央区", "大通西"), ("山梨県", "都留市", "田原"), ("大阪府", "大阪市北区", "梅田"), ("神奈川県", "横浜市西区", "高島"), ("福岡県", "久留米市", "東町"), ("沖縄県", "那覇市", "久茂地"), ("京都府", "宇治市", "広野町"))


def choose(value: str, options: tuple[str, ...]) -> str:
    """One of the options by a whole number."""
    return f"case ({value}) % {len(options)} " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end"


def core(k: str) -> str:
    return f"concat({choose(k, SURNAMES)}, {choose(k, TRADES)}, {choose(k, MARKS)})"


def raw_name(k: str) -> str:
    """As people write it."""
    c = core(k)
    return f"case ({k}) % 6 when 0 then concat('株式会社', {c}) when 1 then concat({c}, '株式会社') when 2 then concat('㈱', {c}) when 3 then concat('(株) ', {c}) when 4 then concat('有限会社　', {c}) else concat(' ㈲', {c}, '。') end"


def display(k: str) -> str:
    """What its display form is to be."""
    c = core(k)
    return f"case when ({k}) % 6 = 1 then concat({c}, '株式会社') when ({k}) % 6 < 4 then concat('株式会社', {c}) else concat('有限会社', {c}) end"


_AREA = [choose("{0}", tuple(a[i] for a in AREAS)) for i in range(3)]
_TAIL = "cast({0} % 9 + 1 as string), '丁目', cast({0} % 20 + 1 as string), '番', cast({0} % 30 + 1 as string), '号'"
#: Columns by table; {0} is the key.
OPERATORS = {
    "operator_id": "{0}", "raw_name": raw_name("{0}"), "display": display("{0}"), "core": core("{0}"), "number": "case when {0} % 5 = 0 then '' else lpad(cast({0} as string), 13, '0') end",
    "prefecture": _AREA[0], "city": _AREA[1], "street": "concat(" + _AREA[2] + ", cast({0} % 9 + 1 as string), '-', cast({0} % 20 + 1 as string))",
}
REGISTRY = {
    "corporate_number": "lpad(cast({0} as string), 13, '0')", "name": display("{0}"), "normalized_name": f"lower({display('{0}')})", "process": "case when {0} % 10 = 0 then '71' else '01' end",
    "prefecture": _AREA[0], "city": _AREA[1], "street": OPERATORS["street"], "update_date": "concat('2024-0', cast({0} % 9 + 1 as string))",
}
STORES = {
    "place_id": "{0}", "brand": choose("{0}", BRANDS), "core": "concat(" + _AREA[2] + ", cast({0} % 400 as string))", "name": "concat(" + choose("{0}", BRANDS) + ", ' ', " + _AREA[2] + ", cast({0} % 400 as string), '店')",
    "pref": _AREA[0], "city": _AREA[1], "town": _AREA[2],
    "address": "concat(case when {0} % 3 = 0 then '〒100-0001 ' else '' end, " + _AREA[0] + ", " + _AREA[1] + ", " + _AREA[2] + ", " + _TAIL + ", case {0} % 4 when 0 then ' サンハイツ 3F' when 1 then ' 山田ビル' when 2 then '　203' else '' end)",
    "plain_address": "concat(" + _AREA[0] + ", " + _AREA[1] + ", " + _AREA[2] + ", cast({0} % 9 + 1 as string), '-', cast({0} % 20 + 1 as string), '-', cast({0} % 30 + 1 as string))",
    "phone": "case when {0} % 4 = 0 then '' else concat('03-', cast(1000 + {0} % 900 as string), '-', cast(1000 + {0} % 7000 as string)) end",
    "url": "case when {0} % 3 = 0 then '' else concat('https://', case {0} % 5 when 0 then 'map' when 1 then 'www' else 'shop' end, '.example', cast({0} % 40 as string), '.co.jp/s/', cast({0} % 700 as string), '/') end",
    "lat": "30 + cast({0} * 37 % 1000 as double) / 100", "lng": "130 + cast({0} * 91 % 1200 as double) / 100",
}


def frame(spark: SparkSession, sf_dir: str, table: str, key: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return read(spark, sf_dir, table).where(where).selectExpr(*[f"{e.format(key)} as {n}" for n, e in columns.items()])


def sql(table: str, key: str, columns: dict[str, str], where: str = "true") -> str:
    return "select " + ", ".join(f"{e.format(key)} as {n}" for n, e in columns.items()) + f" from {table} where {where}"


def operators(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "customer", "c_custkey", OPERATORS)


def registry(s: SparkSession, d: str) -> DataFrame:
    """Every second operator has a company there."""
    return frame(s, d, "customer", "c_custkey", REGISTRY, "c_custkey % 2 = 0")


def stores(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders", "o_orderkey", STORES)


JP_SQL = f"with jp_operators as ({sql('customer', 'c_custkey', OPERATORS)}), jp_registry as ({sql('customer', 'c_custkey', REGISTRY, 'c_custkey % 2 = 0')}), jp_stores as ({sql('orders', 'o_orderkey', STORES)})"
