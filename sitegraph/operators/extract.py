"""Facts from recorded text: companies, revenue, labelled values, links by keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import brand_match_key, brand_similarity, nz, text_before

#: An amount behind a label of revenue, with or without a colon, and the fiscal period it is for; yen in a unit.
INLINE_REVENUE = r"売上(?:高|収益|額)?[:：][^<\n]{0,60}?([0-9][0-9,\.]*)\s*(億円|百万円|千円|万円|円)"
SIMPLE_REVENUE = r"売上(?:高|収益|額)?[\s　]+(?:約[\s　]*)?([0-9][0-9,\.]*)\s*(億円|百万円|千円|万円|円)"
PERIOD = r"((?:20\d{2}|令和\d+|平成\d+)年\s*(?:\d{1,2}月期|度))"
UNITS = {"億円": 10**8, "百万円": 10**6, "千円": 10**3, "万円": 10**4, "円": 1}
LEAST_YEN, MOST_YEN = 10**8, 10**13


def fiscal_year(period: Column) -> Column:
    """Years since 2000 of a period, of the western count or an era; -1 without one."""
    part = lambda p: F.regexp_extract(period, p, 1)
    number = lambda p: part(p).try_cast("int")
    return F.when(part(r"20(\d{2})") != "", number(r"20(\d{2})")).when(part(r"令和(\d+)") != "", number(r"令和(\d+)") + 18).when(part(r"平成(\d+)") != "", number(r"平成(\d+)") - 12).otherwise(-1)


def revenues(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, period, yen of each revenue that a page names: behind a colon, or if there are none beside the label.

    The period stands between label and amount, or is the last of the 200 characters before them.
    Amounts below LEAST_YEN or above MOST_YEN are slips.
    """
    t = F.col(text)
    pattern = F.when(t.rlike(INLINE_REVENUE), F.lit(INLINE_REVENUE)).otherwise(F.lit(SIMPLE_REVENUE))
    rows = pages.select(key, t.alias("t"), pattern.alias("p")).where(t.rlike(INLINE_REVENUE) | t.rlike(SIMPLE_REVENUE))
    hits = lambda k: F.call_function("regexp_extract_all", F.col("t"), F.col("p"), F.lit(k))
    gaps = F.call_function("split", F.col("t"), F.col("p"), F.lit(-1))
    rows = rows.select(key, hits(0).alias("m"), hits(1).alias("a"), hits(2).alias("u"), gaps.alias("g"))
    before = text_before(F.col("m"), F.col("g"))
    each = rows.select(key, F.posexplode(F.arrays_zip("m", "a", "u", before.alias("b"))).alias("i", "x")).select(key, "i", "x.*")
    periods = F.regexp_extract_all("b", F.lit(PERIOD), F.lit(1))
    inside = F.regexp_extract("m", PERIOD, 1)
    times = F.element_at(F.create_map(*[x for u, n in UNITS.items() for x in (F.lit(u), F.lit(float(n)))]), F.col("u"))
    yen = F.floor(F.regexp_replace("a", ",", "").try_cast("double") * times).cast("long")
    out = each.select(key, "i", F.when(inside != "", inside).when(F.size(periods) > 0, F.element_at(periods, -1)).otherwise("").alias("period"), yen.alias("yen"))
    return out.where(F.col("yen").between(LEAST_YEN, MOST_YEN))


def revenue_pair(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, observed_at, current_yen, previous_yen: of the last amounts of each period the two latest; amounts without a period stand by themselves and come last."""
    rows = revenues(pages, key, text).withColumn("k", F.when(F.col("period") != "", F.col("period")).otherwise(F.concat(F.lit("#"), F.col("i").cast("string"))))
    per = rows.groupBy(key, "k").agg(F.max_by("yen", "i").alias("yen"), F.min("i").alias("i"), F.max("period").alias("period"))
    order = Window.partitionBy(key).orderBy(F.desc(fiscal_year(F.col("period"))), "i")
    two = per.withColumn("r", F.row_number().over(order)).where("r <= 2")
    at = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return two.groupBy(key).agg(at("period", 1).alias("observed_at"), at("yen", 1).alias("current_yen"), F.coalesce(at("yen", 2), F.lit(0)).alias("previous_yen"))


def label_values(text: Column) -> Column:
    """Map of the lines that read label, colon, value; of equal labels the last."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike("^[^:：]{1,30}[:：]."))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:：]+)[:：]", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:：]+[:：](.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))


def best_link(links: DataFrame, in_label: dict[str, float], in_href: dict[str, float], least: float) -> DataFrame:
    """page_id, href, score of each page's link that scores best by keywords; of equal ones the first."""
    score = F.lit(0.0)
    for c, words in (("label", in_label), ("href", in_href)):
        for w, x in words.items():
            score = score + F.when(F.contains(F.lower(F.col(c)), F.lit(w)), F.lit(x)).otherwise(0.0)
    scored = links.withColumn("score", F.round(score, 4)).where(F.col("score") >= least)
    return scored.groupBy("page_id").agg(F.max("score").alias("score"), F.min_by("href", F.struct(-F.col("score"), "pos")).alias("href"))


def markdown_links(text: Column) -> Column:
    """Targets of [label](target) in the order they stand."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def brand_filter(stores: DataFrame, brand: str, foreign_domains: list[str], conflicts: list[str]) -> DataFrame:
    """stores with the first decision of the strict filter and whether it accepts."""
    key, want = brand_match_key("name"), brand_match_key(F.lit(brand))
    url = F.lower(nz("official_url"))
    foreign, clash = F.lit(False), F.lit(False)
    for d in foreign_domains:
        foreign = foreign | F.contains(url, F.lit(d))
    for c in conflicts:
        clash = clash | F.contains(key, brand_match_key(F.lit(c)))
    alike = brand_similarity(key, want)
    why = (
        F.when(foreign, "foreign_domain").when(F.contains("name", F.lit(brand)), "substring").when(F.contains(key, want), "normalized").when(alike >= 0.85, "similar")
        .when(alike < 0.20, "unlike").when(F.startswith(key, F.substring(want, 1, 5)), "prefix").when(clash, "conflict").otherwise("default")
    )
    return stores.withColumn("decision", why).withColumn("accepted", ~F.col("decision").isin("foreign_domain", "unlike", "conflict"))


#: Labels of a member's page, by field; what stands before a representative's name.
FIELDS = {
    "representative": ("代表者", "代表取締役", "代表"), "headquarters_address": ("本社所在地", "本社", "所在地", "住所"), "capital_stock": ("資本金",), "established": ("設立", "創業"),
    "website_url": ("ホームページ", "URL", "Web サイト", "Webサイト", "公式 URL"), "industry": ("業種", "事業内容"),
}
TITLES = r"^(代表取締役(?:社長|会長|)|取締役社長|社長)[\s　:：]*(.+)"


def member_fields(text: Column) -> Column:
    """struct of FIELDS and representative_title from a page's text: the first label of a field with something on its line behind it."""
    out = {}
    for field, labels in FIELDS.items():
        got = [F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(text, rf"\Q{w}\E[\s　:：]*([^\n<]{{2,200}})", 1), r"[\s　]+", " ")), r"[。、,. ]+$", "") for w in labels]
        held = [F.regexp_extract(text, rf"(\Q{w}\E[\s　:：]*[^\n<]{{2,200}})", 1) != "" for w in labels]
        value = F.lit("")
        for h, g in reversed(list(zip(held, got, strict=True))):
            value = F.when(h, F.substring(g, 1, 200)).otherwise(value)
        out[field] = value
    title = F.regexp_extract(out["representative"], TITLES, 1)
    person = F.when(title != "", F.trim(F.regexp_extract(out["representative"], TITLES, 2))).otherwise(out["representative"])
    return F.struct(person.alias("representative"), title.alias("representative_title"), *[v.alias(f) for f, v in out.items() if f != "representative"])


#: Patterns of an official site.
SITE_NAME = r"(?:会社名|商号|社\s*名|会社)[:：\s　]+((?:株式会社|有限会社|合同会社)[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー]{2,30})"
BARE_NAME = r"((?:株式会社|有限会社|合同会社)[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー]{2,25})"
SITE_COUNT = r"(?:店舗数|加盟店数|総店舗数|全国)[^0-9]{0,10}([0-9][0-9,]*)\s*(?:店舗|店|ヶ所|か所)"
MOST_STORES = 50_000


def site_company(text: Column) -> Column:
    """The company of an official site: the one behind a label, else the one that it names most often, twice at least; of equally frequent ones the shorter, then the first."""
    labelled = F.trim(F.regexp_extract(text, SITE_NAME, 1))
    names = F.filter(F.regexp_extract_all(text, F.lit(BARE_NAME), F.lit(1)), lambda x: F.length(x) >= 5)
    counted = F.transform(F.array_distinct(names), lambda x, i: F.struct((-F.size(F.filter(names, lambda y: y == x))).alias("n"), F.length(x).alias("l"), i.alias("i"), x.alias("x")))
    best = F.get(F.array_sort(counted), 0)
    return F.when(labelled != "", F.substring(labelled, 1, 80)).when(best["n"] <= -2, F.substring(best["x"], 1, 80)).otherwise("")


def site_store_count(text: Column) -> Column:
    """The first number of stores that a site names, if it can be one; else 0."""
    n = F.regexp_replace(F.regexp_extract(text, SITE_COUNT, 1), ",", "").try_cast("long")
    return F.when(n.between(1, MOST_STORES), n).otherwise(F.lit(0)).cast("long")


# -- disclosure documents --------------------------------------------------------------------------

_YEAR_ROW = r"(20\d{2})\s*(?:年\s*)?年度\s+([0-9,，]+)\s+([0-9,，]+)\s+([0-9,，]+)"
_number = lambda c: F.coalesce(F.regexp_replace(c, "[,，]", "").try_cast("int"), F.lit(0))
DIRECT_WORDS, FRANCHISE_WORDS = ("直営", "RC", "ＲＣ"), ("フランチャイズ", "加盟店", "加盟者", "FC", "ＦＣ")


def _valid(a: Column, b: Column, total: Column) -> Column:
    return a.between(0, 10_000) & b.between(0, 10_000) & (total > 0) & (total <= 10_000) & (F.abs(a + b - total) <= 1)


def _direct_first(window: Column) -> Column:
    """Whether the column of direct stores stands before that of franchised ones."""
    first = lambda words: F.array_min(F.filter(F.array(*[F.instr(window, w) for w in words]), lambda p: p > 0))
    return F.coalesce(first(DIRECT_WORDS) < first(FRANCHISE_WORDS), F.lit(False))


def _latest_row(window: Column, check: bool) -> Column:
    """struct(year, a, b, total) of the latest year's row of a table; of equal years the first."""
    parts = [F.regexp_extract_all(window, F.lit(_YEAR_ROW), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "yabt", strict=True)]), lambda x, i: F.struct((-_number(x["y"])).alias("o"), i.alias("i"), _number(x["a"]).alias("a"), _number(x["b"]).alias("b"), _number(x["t"]).alias("t")))
    rows = F.filter(rows, lambda x: _valid(x["a"], x["b"], x["t"])) if check else rows
    return F.get(F.array_sort(rows), 0)


def disclosed_counts(text: Column, brand: Column) -> Column:
    """struct(method, observed_at, fc, rc, total) of the store counts in a disclosure document; method is empty if none is found.

    Strategies in order: a table of franchised, direct and all stores; the brand's row in a table of
    store numbers; a table by year; a month in the history; a sentence about today.
    """
    compact = F.regexp_replace(nz(text), r"[ \t\u3000]+", " ")
    told = lambda m, at, fc, rc, total: F.struct(F.lit(m).alias("method"), at.alias("observed_at"), fc.cast("int").alias("fc"), rc.cast("int").alias("rc"), total.cast("int").alias("total"))
    zero = F.lit(0)
    after = lambda pattern, n: F.regexp_extract(compact, rf"(?s)((?:{pattern}).{{0,{n}}})", 1)
    table = _latest_row(F.substring(after(r"FC\s*店\s+RC\s*店\s+合\s*計", 1600), 1, 1600), False)
    one = F.when(table.isNotNull(), told("fc_rc_total_table", F.concat((-table["o"]).cast("string"), F.lit("年度")), table["a"], table["b"], table["t"]))
    lines = F.split(nz(text), r"\r?\n")
    solid = lambda x: F.translate(F.regexp_replace(x, r"\s+", ""), "０１２３４５６７８９", "0123456789")
    numbers = lambda x: F.transform(F.regexp_extract_all(F.translate(x, "０１２３４５６７８９", "0123456789"), F.lit("([0-9][0-9,，]*)"), F.lit(1)), _number)
    heads = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("店舗数推移")) | F.contains(x, F.lit("教室")), i)), lambda i: i.isNotNull())

    def row_of(head: Column) -> Column:
        window = F.slice(lines, head + 1, F.lit(30))
        order = _direct_first(F.array_join(window, "\n"))

        def one_row(x: Column, i: Column) -> Column:
            n = numbers(x)
            a, b, t = (F.get(n, F.size(n) - k) for k in (3, 2, 1))
            month = F.regexp_extract_all(F.array_join(F.slice(window, 1, i + 1), "\n"), F.lit(r"(20\d{2}\s*/\s*[0-9]{1,2})"), F.lit(1))
            at = F.when(F.size(month) > 0, F.concat(F.regexp_extract(F.element_at(month, -1), r"(\d+)", 1), F.lit("-"), F.lpad(F.regexp_extract(F.element_at(month, -1), r"/\s*(\d+)", 1), 2, "0"))).otherwise("")
            ok = F.contains(solid(x), solid(brand)) & (F.size(n) >= 3) & _valid(a, b, t)
            return F.when(ok, told("brand_store_count_row", at, F.when(order, b).otherwise(a), F.when(order, a).otherwise(b), t))

        return F.get(F.filter(F.transform(window, one_row), lambda r: r.isNotNull()), 0)

    two = F.when(nz(brand) != "", F.get(F.filter(F.transform(heads, row_of), lambda r: r.isNotNull()), 0))
    three = []
    for header in ("店舗数推移", "教室数推移", "教 室 数 推 移"):
        window = F.substring(after(rf"\Q{header}\E", 2200), 1, 2200)
        r = _latest_row(window, True)
        order = _direct_first(window)
        three.append(F.when(r.isNotNull(), told("year_store_count_table", F.concat((-r["o"]).cast("string"), F.lit("年度")), F.when(order, r["b"]).otherwise(r["a"]), F.when(order, r["a"]).otherwise(r["b"]), r["t"])))
    month = r"(20\d{2})\s*年\s*([0-9]{1,2})\s*月\s+店舗数\s+([0-9,，]+)\s*店舗"
    parts = [F.regexp_extract_all(compact, F.lit(month), F.lit(k)) for k in (1, 2, 3)]
    months = F.array_sort(F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "ymn", strict=True)]), lambda x, i: F.struct((-_number(x["y"]) * 100 - _number(x["m"])).alias("o"), i.alias("i"), _number(x["n"]).alias("n"))))
    newest = F.get(months, 0)
    four = F.when(newest.isNotNull(), told("history_store_count", F.format_string("%d-%02d", F.floor(-newest["o"] / 100).cast("int"), (-newest["o"] % 100).cast("int")), zero, zero, newest["n"]))
    now = F.regexp_extract(compact, r"現在(?:は|、)?\s*([0-9,，]+)\s*店舗", 1)
    day = [F.regexp_extract(compact, r"(20\d{2})\s*年\s*([0-9]{1,2})\s*月末日現在", k) for k in (1, 2)]
    five = F.when(now != "", told("current_store_count_sentence", F.when(day[0] != "", F.concat(day[0], F.lit("-"), F.lpad(day[1], 2, "0"))).otherwise(""), zero, zero, _number(now)))
    return F.coalesce(one, two, *three, four, five, told("", F.lit(""), zero, zero, zero))
