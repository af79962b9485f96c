"""Who runs a store: evidence on pages, labels, decisions and the gates that a finding has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc, nz
from .evidence import host

#: Words around which a page says who runs a store, and those that say the brand itself does.
OPERATOR_KEYWORDS = ("運営会社", "運営法人", "運営元", "運営:", "運営：", "加盟店", "フランチャイジー", "株式会社", "Operated by", "Franchisee", "Operator:")
DIRECT_KEYWORDS = ("直営店", "自社運営", "全店直営", "子会社が運営", "Directly operated", "全店舗直営")
#: Hints in a snippet, in the order they are tried.
FRANCHISEE_HINTS = ("加盟店です", "加盟店として運営", "フランチャイジー", "FC 加盟店", "運営: 株式会社", "運営会社: 株式会社", "運営法人: 株式会社", "運営者: 株式会社", "当店は、")
DIRECT_HINTS = ("直営店", "直営店舗", "全店直営", "自社運営", "本部直営", "本店直営", "弊社直営")
MASTER_HINTS = ("マスターフランチャイジー", "master franchisee", "Master Franchisee", "フランチャイザー", "franchisor", "本部へのお問い合わせ", "本部へお問い合わせ", "として事業展開", "本部会社")
#: What a link to the page about the company says.
ABOUT_TEXTS = ("会社概要", "企業情報", "会社情報", "運営会社", "運営元", "About", "About us", "Corporate", "Company")

#: Characters of a company's name, and what ends one that follows its form.
NAME_CHARS = r"A-Za-z0-9ぁ-ゖァ-ヿ一-龠々ー・\s&\-‐-―−"
NAME_ENDS = (
    "、", "。", "の", "が", "を", "は", "で", "と", "も",
    "所在地", "住所", "電話", "電話番号", "FAX", "Fax", "ファックス", "〒", "Tel", "TEL", "Phone", "設立", "代表", "代表者", "代表取締役", "事業内容", "本社", "本店",
    "資本金", "従業員", "創業", "公式サイト", "URL", "ウェブサイト", "業種", "営業時間", "定休日",
    " All", " all", "©", " ©", "(c)", "(C)", " Copyright", " copyright", " Rights", " rights", " Inc", " Inc.", " Ltd", " Ltd.", " Co.", " Co ",
    "について", "に関する", "に関し", "に対する", "に対し", "によって", "による", "として", "への", "からの",
    "キャンペーン", "期間", "特典", "限定", "お得", "お知らせ", "セール", "イベント", "新着", "最新", "情報", "募集", "求人",
)
#: What separates a company's name from the text before it, if its form stands behind.
NAME_STARTS = ("、", "。", "   ", "  ", "　", "\n", "：", ":", "名称", "会社名", "社名", "商号", "事業者名", "法人名", "会社概要", "企業情報", "会社案内", "会社情報", "Home", "HOME")
_DATE = r"20\d{2}|令和\d+|平成\d+"
_ATOM = rf"(?:(?!株式会社|㈱|\(株\))[{NAME_CHARS}])"
_quoted = lambda words: "|".join(rf"\Q{w}\E" for w in words)


def company_names(snippet: Column) -> Column:
    """Companies of a text, each once: first those whose form stands before the name, then those whose form stands behind it.

    A name stops before another company form; the former end at particles, labels, notices and
    dates, the latter begin behind separators and labels.
    """
    s = nfkc(snippet)
    before = rf"(株式会社|㈱|\(株\))({_ATOM}{{1,40}})"
    forms, bodies = (F.regexp_extract_all(s, F.lit(before), F.lit(k)) for k in (1, 2))
    cut = lambda b: F.rtrim(F.regexp_replace(F.regexp_replace(b, r"\s+$", ""), rf"(?s)(?:{_quoted(NAME_ENDS)}|{_DATE}).*$", ""))
    heads = F.filter(F.transform(F.arrays_zip(forms.alias("f"), bodies.alias("b")), lambda x: F.when(cut(x["b"]) != "", F.concat(x["f"], cut(x["b"])))), lambda x: x.isNotNull())
    ends = F.regexp_extract_all(s, F.lit(rf"({_ATOM}{{1,40}})株式会社"), F.lit(1))
    begun = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"^\s+|\s+$", ""), rf"(?s)^.*(?:{_quoted(NAME_STARTS)})", ""))
    tails = F.transform(F.filter(F.transform(ends, begun), lambda b: (b != "") & ~b.isin("の", "が", "を", "は", "で", "と")), lambda b: F.concat(b, F.lit("株式会社")))
    return F.array_distinct(F.concat(heads, tails))


def occurrences(pages: DataFrame, key: str, text: str, keywords: tuple[str, ...], reason: str, around: int = 200) -> DataFrame:
    """key, reason, keyword, pos, snippet of every occurrence of every keyword; those of one keyword don't overlap.

    Positions are running sums over the pieces between the hits of a keyword, so a page of many hits
    costs no more than their number.
    """
    rows = pages.select(key, F.col(text).alias("text")).where("text is not null").withColumn("rid", F.monotonically_increasing_id())
    pieces = F.array(*[F.struct(F.lit(n).alias("n"), F.transform(F.split("text", rf"\Q{w}\E", -1), lambda p: F.length(p)).alias("gaps")) for n, w in enumerate(keywords)])
    each = rows.select("rid", F.explode(F.filter(pieces, lambda x: F.size(x["gaps"]) > 1)).alias("x"))
    found = each.select("rid", "x.n", F.size("x.gaps").alias("size"), F.posexplode("x.gaps").alias("i", "gap"))
    lengths = F.element_at(F.array(*[F.lit(len(w)) for w in keywords]), F.col("n") + 1)
    run = Window.partitionBy("rid", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = found.withColumn("pos", F.sum("gap").over(run) + F.col("i") * lengths).where("i < size - 1").select("rid", "n", F.col("pos").cast("int").alias("pos"))
    start = F.greatest(F.col("pos") - around, F.lit(0))
    piece = F.substring(F.col("text"), start + 1, F.col("pos") + around - start)
    names = F.element_at(F.array(*[F.lit(w) for w in keywords]), F.col("n") + 1)
    return rows.join(at, "rid").select(key, F.lit(reason).alias("reason"), names.alias("keyword"), "pos", F.trim(F.regexp_replace(piece, r"\s+", " ")).alias("snippet"))


def page_evidence(pages: DataFrame, key: str, text: str, around: int = 200) -> DataFrame:
    """All occurrences of operator and direct keywords; those whose page, beginning (100 characters) and reason are alike count once, the first by keyword and place."""
    order = {w: i for i, w in enumerate((*OPERATOR_KEYWORDS, *DIRECT_KEYWORDS))}
    rank = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("keyword"))
    rows = occurrences(pages, key, text, OPERATOR_KEYWORDS, "operator_keyword", around).unionByName(occurrences(pages, key, text, DIRECT_KEYWORDS, "direct_keyword", around)).withColumn("rank", rank)
    w = Window.partitionBy(key, F.substring("snippet", 1, 100), "reason").orderBy("rank", "pos")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "rank")


def about_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, url of each link to a page about the company on the same host, once a page; links: page_id, pos, href, label; pages: page_id, url."""
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    base = F.regexp_extract("url", r"^([^?#]*/)[^/]*$", 1)
    target = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.regexp_extract("url", "^([^:]+:)", 1), "href")).when(F.startswith("href", F.lit("/")), F.concat(site, "href")).otherwise(F.concat(base, "href"))
    said = F.lit(False)
    for t in ABOUT_TEXTS:
        said = said | F.contains("label", F.lit(t))
    rows = links.where((F.col("label") != "") & said).join(pages.select("page_id", "url"), "page_id").withColumn("target", target)
    return rows.where((host(F.col("target")) == host(F.col("url"))) & (host(F.col("url")) != "")).select("page_id", F.col("target").alias("about_url")).distinct()


def root_candidates(url: Column) -> Column:
    """The root of a URL's host and, for hosts of maps and shops, that of the site under www."""
    scheme, name = F.regexp_extract(url, "^(https?)://", 1), F.regexp_extract(url, "^https?://([^/]+)", 1)
    own = F.concat(scheme, F.lit("://"), name, F.lit("/"))
    up = F.regexp_replace(own, r"://(?i:map|maps|store|stores|shop|m)\.", "://www.")
    return F.when(scheme == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(own, up)))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(_quoted(words))


def decide(evidence: DataFrame, key: str = "place_id") -> DataFrame:
    """key, operator_name, operator_type, confidence from evidence (key, seq, url, snippet, reason).

    Evidence alike in url, beginning (120 characters) and reason counts once. First rule that holds:
    an explicit franchisee hint with a company behind it within 200 characters (.9), a direct hint
    with a company anywhere (.85) or without (.6), a master hint with a company (.65), a company
    (.5), else unknown without confidence. Companies are ranked by how many pieces of evidence name
    them, of equal ones the first. Keys without evidence don't appear.
    """
    alike = Window.partitionBy(key, "url", F.substring("snippet", 1, 120), "reason").orderBy("seq")
    rows = evidence.withColumn("r", F.row_number().over(alike)).where("r = 1")
    text = nz("snippet")
    tails = [F.when(F.contains(text, F.lit(h)), F.get(company_names(F.substring(text, F.instr(text, h), F.lit(200))), 0)) for h in FRANCHISEE_HINTS]
    seen = rows.select(key, "seq", F.coalesce(*tails).alias("explicit"), (_any(text, DIRECT_HINTS) | (nz("reason") == "direct_keyword")).alias("direct"), _any(text, MASTER_HINTS).alias("master"), company_names(text).alias("names"))
    facts = seen.groupBy(key).agg(F.min_by("explicit", F.when(F.col("explicit").isNotNull(), F.col("seq"))).alias("explicit"), F.max("direct").alias("direct"), F.max("master").alias("master"))
    counted = seen.select(key, "seq", F.posexplode("names").alias("i", "name")).groupBy(key, "name").agg(F.count("*").alias("n"), F.min(F.struct("seq", "i")).alias("first"))
    best = counted.groupBy(key).agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "first")).alias("name"))
    both = facts.join(best, key, "left")
    explicit, name = F.col("explicit").isNotNull(), F.col("name").isNotNull()
    kind = F.when(explicit, "franchisee").when(F.col("direct"), "direct").when(F.col("master") & name, "franchisor").otherwise("unknown")
    sure = F.when(explicit, 0.9).when(F.col("direct") & name, 0.85).when(F.col("direct"), 0.6).when(F.col("master") & name, 0.65).when(name, 0.5).otherwise(0.0)
    return both.select(key, F.coalesce("explicit", "name", F.lit("")).alias("operator_name"), kind.alias("operator_type"), sure.alias("confidence"))


#: A company's name beside its form, the labels before it, from the surest, and headquarters that are never taken.
_FORM = r"(?:株式会社|有限会社|合同会社|㈱|㈲|\(株\)|（株）)"
CORP = rf"(?:{_FORM}[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー]{{2,25}}|[一-龥ぁ-んァ-ヶA-Za-z0-9・\-ー]{{2,25}}{_FORM})"
LABELS = (("運営会社", r"運営会社[:：\s]*", 0.9), ("運営", r"運営[:：\s]*", 0.85), ("店舗運営者", r"店舗運営(?:者|会社)[:：\s]*", 0.85), ("事業主", r"事業主[:：\s]*", 0.75), ("加盟店", r"加盟店[:：\s]*", 0.75), ("社名", r"(?:社\s?名|商\s?号|会社名)[:：\s]*", 0.7), ("bare", "", 0.4))
HEADQUARTERS = ("株式会社モスフードサービス", "株式会社モスストアカンパニー", "日本マクドナルド株式会社", "株式会社ダスキン", "株式会社壱番屋", "株式会社大戸屋", "株式会社アレフ", "株式会社ファーストフーズ")
_EDGES = r"[「」『』【】\"“”'’・,，。、　\s]"


def labelled_operator(html: Column) -> Column:
    """struct(name, label, confidence, corporate_number, phone, address) of the first label in LABELS that stands before a company on a page; null if none does.

    Only the first place of a label counts; headquarters and names over 50 characters are passed over.
    """
    found = []
    for label, pattern, sure in LABELS:
        name = F.regexp_replace(F.regexp_replace(F.regexp_extract(html, f"{pattern}({CORP})", 1), f"^{_EDGES}+|{_EDGES}+$", ""), r"\s+", "")
        found.append(F.when((name != "") & (F.length(name) <= 50) & ~name.isin(*HEADQUARTERS), F.struct(name.alias("name"), F.lit(label).alias("label"), F.lit(sure).alias("confidence"))))
    best = F.coalesce(*found)
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["label"].alias("label"), best["confidence"].alias("confidence"), F.regexp_extract(html, r"法人番号[:：\s]*(\d{13})", 1).alias("corporate_number"), F.regexp_extract(html, r"(0\d{1,4}-\d{1,4}-\d{4})", 1).alias("phone"), F.trim(F.regexp_extract(html, r"(〒?\d{3}[-‐]\d{4}[^<\n]{5,60})", 1)).alias("address")))


# -- gates -------------------------------------------------------------------------------------

#: Labels of an employer, and words of a page that offers work.
EMPLOYER_LABELS = ("会社名", "企業名", "法人名", "社名", "商号", "雇用主", "求人企業", "掲載企業", "募集企業", "採用企業", "応募先企業", "運営会社", "店舗運営", "事業者")
JOB_WORDS = ("求人", "採用", "アルバイト", "パート", "正社員", "募集", "転職", "応募", "ハローワーク")
KEY_DISTANCE, LABEL_DISTANCE, PAIR_DISTANCE = 1500, 120, 500


def _near(text: Column, a: Column, b: Column, distance: int) -> Column:
    """Whether a and b begin within a distance of each other somewhere in a text."""
    literal = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    gap = lambda x: F.concat(F.lit(".{0,"), F.greatest(F.lit(distance) - F.length(x), F.lit(0)).cast("string"), F.lit("}"))
    pattern = F.concat(F.lit("(?s)"), literal(a), gap(a), literal(b), F.lit("|"), literal(b), gap(b), literal(a))
    nested = F.contains(a, b) | F.contains(b, a)
    return F.contains(text, a) & F.contains(text, b) & (nested | F.call_function("rlike", text, pattern))


def useful_urls(urls: Column) -> Column:
    """Distinct URLs in their order, without result pages of search engines."""
    clean = F.array_distinct(F.filter(F.transform(urls, lambda u: F.trim(nz(u))), lambda u: u != ""))

    def search(u: Column) -> Column:
        h, path = host(u), F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
        return ((F.contains(h, F.lit("google.")) | F.contains(h, F.lit("bing.com"))) & F.startswith(path, F.lit("/search"))) | F.contains(h, F.lit("search.yahoo."))

    return F.filter(clean, lambda u: ~search(u))


def recruitment_evidence(text: Column, operator: Column, keys: Column, labelled: bool = True) -> Column:
    """struct(found, reason, store_key, label) of what a page that offers work says about an operator and a store.

    Gates in order: a text, the operator on it, a word of such a page, a store key that begins
    within KEY_DISTANCE of the operator, and an employer's label within LABEL_DISTANCE of it. The
    first key, and the first label of the list, that are near are given.
    """
    key = F.get(F.filter(keys, lambda k: _near(text, operator, k, KEY_DISTANCE)), 0)
    by_op = lambda w: F.contains(operator, w) | F.call_function("rlike", text, F.concat(F.lit(r"(?s)\Q"), operator, F.lit(r"\E.{0,"), (F.lit(LABEL_DISTANCE) - F.length(w)).cast("string"), F.lit(r"}\Q"), w, F.lit(r"\E|\Q"), w, F.lit(r"\E.{0,"), (F.lit(LABEL_DISTANCE) - F.length(w)).cast("string"), F.lit(r"}\Q"), operator, F.lit(r"\E")))
    label = F.get(F.filter(F.array(*[F.lit(x) for x in EMPLOYER_LABELS]), by_op), 0)
    reason = (
        F.when(nz(text) == "", "empty_html").when(~F.contains(text, operator), "operator_missing").when(~_any(text, JOB_WORDS), "not_job_or_recruit_page")
        .when(key.isNull(), "store_key_not_near_operator").when(label.isNull() if labelled else F.lit(False), "operator_without_employer_label").otherwise("")
    )
    near = reason.isin("", "operator_without_employer_label")
    return F.struct((reason == "").alias("found"), reason.alias("reason"), F.when(near, nz(key)).otherwise("").alias("store_key"), F.when(reason == "", nz(label)).otherwise("").alias("label"))


def cooccurring_key(text: Column, operator: Column, keys: Column, distance: int = PAIR_DISTANCE) -> Column:
    """The first store key inside the window of distance characters on either side of the operator's first place; null if none is."""
    at = F.instr(text, operator) if isinstance(operator, str) else F.call_function("instr", text, operator)
    start = F.greatest(at - 1 - distance, F.lit(0))
    window = F.substring(text, start + 1, at - 1 - start + F.length(operator) + distance)
    return F.when((nz(operator) != "") & (at > 0), F.get(F.filter(keys, lambda k: F.contains(window, k)), 0))


def recruitment_decision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, operator_name, corporate_number, accepted, reject_reason: the first candidate of a store, by confidence, that passes all gates.

    rows has a candidate each: keys, candidate (null if there is none), confidence, store_keys, blocked, text, registry_name, registry_number
    (null where no company bears the name exactly). Without one that passes, the reason is that of the last.
    """
    seen = recruitment_evidence(nz("text"), nz("candidate"), F.col("store_keys"))
    reason = (
        F.when(F.col("candidate").isNull(), "no_candidates").when(F.size("store_keys") == 0, "no_store_keys").when(F.col("blocked"), F.concat(F.lit("blocked_franchisor:"), F.col("candidate")))
        .when(~seen["found"], seen["reason"]).when(F.col("registry_number").isNull(), "houjin_no_exact_match").otherwise("")
    )
    told = rows.withColumn("reason", reason)
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "candidate")
    passed = F.when(F.col("reason") == "", order)
    return told.groupBy(*keys).agg(
        F.min_by("registry_name", passed).alias("operator_name"), F.min_by("registry_number", passed).alias("corporate_number"),
        F.max(F.col("reason") == "").alias("accepted"), F.when(F.max(F.col("reason") == ""), "").otherwise(F.max_by("reason", order)).alias("reject_reason"),
    )


def store_research(rows: DataFrame, key: str) -> DataFrame:
    """rows with reject_reason and accepted after four gates: a candidate with URLs, a store key near it, a critic's yes, the registry's exact name.

    rows has candidate, urls, store_keys, text, verdict, verdict_reason, registry_name.
    """
    near = cooccurring_key(nz("text"), nz("candidate"), F.col("store_keys"))
    reason = (
        F.when(nz("candidate") == "", "gate1_no_operator").when(F.coalesce(F.size("urls"), F.lit(0)) <= 0, "gate1_no_evidence_urls").when(F.size("store_keys") == 0, "gate2_no_store_keys")
        .when(near.isNull(), "gate2_no_cooccurrence").when(nz("verdict") != "yes", F.concat(F.lit("gate3_critic_"), nz("verdict"), F.lit(": "), F.substring(nz("verdict_reason"), 1, 40)))
        .when(F.col("registry_name").isNull() | (F.col("registry_name") != F.col("candidate")), "gate4_no_exact_match").otherwise("")
    )
    return rows.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason") == "").withColumn("store_key", nz(near))


def page_acceptance(rows: DataFrame) -> DataFrame:
    """rows with operator_name, reject_reason and confidence (.84 if accepted): the gates for a store's own page.

    rows has html, text, fetch_error, store_keys, blocked_names (array), registry_name (null where no company bears the label's name).
    """
    label = labelled_operator(nz("html"))
    with_label = rows.withColumn("label", label)
    key = F.get(F.filter("store_keys", lambda k: F.contains(nz("text"), k)), 0)
    reason = (
        F.when(nz("fetch_error") != "", F.concat(F.lit("fetch_error:"), F.col("fetch_error"))).when(nz("html") == "", "empty_html").when(F.col("label").isNull(), "no_operator_label")
        .when((F.col("label.label") == "bare") | (F.col("label.confidence") < 0.7), "operator_label_not_explicit").when(F.array_contains("blocked_names", F.col("label.name")), "blocked_franchisor")
        .when(key.isNull(), "store_key_missing_in_page").when(F.col("registry_name").isNull(), "houjin_no_exact_match").otherwise("")
    )
    out = with_label.withColumn("reject_reason", reason)
    return out.withColumns({"operator_name": F.coalesce("registry_name", "label.name", F.lit("")), "confidence": F.when(F.col("reject_reason") == "", 0.84).otherwise(0.0)}).drop("label")
