"""Names, addresses and similarity as Column expressions; NFKC is the one Arrow UDF, to be applied once at ingest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..ship import ship

#: Marks of a company form and what they stand for.
DESIGNATORS = (("(株)", "株式会社"), ("㈱", "株式会社"), ("（株）", "株式会社"), ("(有)", "有限会社"), ("㈲", "有限会社"), ("（有）", "有限会社"))
FORMS = ("株式会社", "有限会社")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    ship(SparkSession.active())
    return _nfkc(c)


def nz(c: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cs], F.lit(""))


def operator_name(raw: Column | str) -> Column:
    """Display form: NFKC, one designator for each form, single blanks, none beside a designator, no closing punctuation; empty for null."""
    s = nfkc(F.trim(nz(raw)))
    for a, b in DESIGNATORS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"\s+", " ")
    for form in FORMS:
        s = F.regexp_replace(s, rf"\s*{form}\s*", form)
    return F.trim(F.regexp_replace(s, r"[、。,.・]+$", ""))


def canonical_key(raw: Column | str) -> Column:
    """Grouping key that keeps the designator."""
    return F.lower(operator_name(raw))


def core_key(raw: Column | str) -> Column:
    """Key without designators and blanks, for registry similarity; no NFKC."""
    s = nz(raw)
    for a in (*[d for d, _ in DESIGNATORS], *FORMS, " ", "　"):
        s = F.replace(s, F.lit(a), F.lit(""))
    return F.lower(s)


def space_free_key(raw: Column | str) -> Column:
    return F.regexp_replace(nz(raw), r"[\s　]+", "")


def brand_match_key(raw: Column | str) -> Column:
    """Lowercased without blanks, middle dots and hyphens; the long-vowel mark stays."""
    return F.translate(F.lower(nz(raw)), " 　・-", "")


def bigrams(s: Column) -> Column:
    """Distinct two-character pieces; none below two characters."""
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(shared / (F.size(x) + F.size(y) - shared))


def name_similarity(a: Column, b: Column) -> Column:
    """0 if a key is empty, 1 if equal, 0.9 if one contains the other, else bigram Jaccard; over keys."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(bigram_jaccard(a, b))


def brand_similarity(a: Column, b: Column) -> Column:
    """1 if one contains the other, else the greater of bigram Jaccard and 1 - edit distance / longer length."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(F.greatest(bigram_jaccard(a, b), edit))


def company_core(name: Column) -> Column:
    """A display name without the company forms before and behind it."""
    strip = F.regexp_replace(F.regexp_replace(name, "^(?:株式会社|有限会社)+", ""), "(?:株式会社|有限会社)+$", "")
    return F.trim(strip)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float:
        x, y = x or "", y or ""
        if not x and not y:
            return 100.0
        row = [0] * (len(y) + 1)  # longest common subsequence
        for c in x:
            last = 0
            for k, d in enumerate(y, 1):
                last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
        return 200.0 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def ratio(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over both lengths, in percent."""
    ship(SparkSession.active())
    return _ratio(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the shared words and the shared words with the rest of either side, words sorted."""
    x, y = F.array_distinct(F.split(F.trim(a), r"\s+")), F.array_distinct(F.split(F.trim(b), r"\s+"))
    line = lambda w: F.array_join(F.array_sort(w), " ")
    shared = line(F.array_intersect(x, y))
    one, two = (F.trim(F.concat_ws(" ", shared, line(F.array_except(p, q)))) for p, q in ((x, y), (y, x)))
    return F.greatest(F.when(shared != "", F.greatest(ratio(shared, one), ratio(shared, two))).otherwise(0.0), ratio(one, two))


#: Fixed value: two names are one from this ratio on.
ALIKE_RATIO = 88


def operators_match(a: Column, b: Column, fuzzy: bool = False) -> Column:
    """Whether two display names mean one company: equal, equal without company forms, or one of 3 characters or more inside the other.

    With fuzzy, names of 4 characters or more also match by the ratio of their words or cores.
    """
    x, y = company_core(a), company_core(b)
    filled = (nz(a) != "") & (nz(b) != "")
    same = (a == b) | ((x != "") & (x == y)) | ((F.length(a) >= 3) & F.contains(b, a)) | ((F.length(b) >= 3) & F.contains(a, b))
    if fuzzy:
        cores = (x != "") & (y != "") & (ratio(x, y) >= ALIKE_RATIO)
        same = same | ((F.length(a) >= 4) & (F.length(b) >= 4) & ((token_set_ratio(a, b) >= ALIKE_RATIO) | cores))
    return filled & same


def sanitize(c: Column | str) -> Column:
    """No control characters, no outer blanks."""
    return F.trim(F.regexp_replace(nz(c), r"\p{Cntrl}", ""))


def split_values(c: Column | str) -> Column:
    """Parts by the first separator there is: a slash between blanks, a semicolon, a vertical bar."""
    s = nz(c)
    parts = F.when(F.contains(s, F.lit(" / ")), F.split(s, " / ")).when(F.contains(s, F.lit(";")), F.split(s, ";")).when(F.contains(s, F.lit("|")), F.split(s, r"\|")).otherwise(F.array(s))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def join_values(values: Column, limit: int | None = None) -> Column:
    kept = F.array_sort(F.array_distinct(F.filter(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")))
    return F.array_join(F.slice(kept, 1, limit) if limit else kept, " / ")


def first_number(c: Column | str) -> Column:
    """The first part that is a corporate number of 13 digits, else empty."""
    return F.coalesce(F.get(F.filter(split_values(c), lambda x: x.rlike(r"^\d{13}$")), 0), F.lit(""))


def whole_number(c: Column | str) -> Column:
    """Integer of a text with thousands separators; 0 for what is none."""
    return F.coalesce(F.expr(f"try_cast(try_cast(regexp_replace({c if isinstance(c, str) else c._jc.toString()}, '[,\\\\s]', '') as double) as bigint)"), F.lit(0).cast("long"))


def brand_variants(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Of each part between slashes the part itself, what its parentheses hold, and the part without parentheses; distinct, in this order, each by its main name.

    A part with another spelling in aliases stands by its main name alone.
    """
    parts = F.filter(F.transform(F.split(F.trim(nz(c)), "[/／]"), lambda x: F.trim(x)), lambda x: x != "")

    def spread(part: Column) -> Column:
        main = canonical_brand(part, aliases or {})
        inner = F.regexp_extract_all(part, F.lit(r"[(（]([^)）]+)[)）]"), F.lit(1))
        outer = F.trim(F.regexp_replace(part, r"[(（][^)）]*[)）]", ""))
        return F.when(main != part, F.array(main)).otherwise(F.concat(F.array(part), inner, F.array(outer)))

    named = F.transform(F.flatten(F.transform(parts, spread)), lambda x: canonical_brand(x, aliases or {}))
    return F.array_distinct(F.filter(named, lambda x: x != ""))


#: Words that mark a part of an address as a building, and what marks it as a floor.
BUILDING_HINTS = ("ビル", "マンション", "タワー", "階", "ハイツ", "コーポ", "プラザ")
FLOOR = r"^\d+[FB]?F?$|^B\d+F$"


def normalize_address(raw: Column | str) -> Column:
    """Comparable form: NFKC, no postal code, no parts that name a building or floor, block marks as hyphens."""
    s = F.regexp_replace(nfkc(F.trim(nz(raw))), r"〒\s*\d{3}-?\d{4}\s*", "")
    solid = F.filter(F.split(s, r"\s+"), lambda t: (t != "") & ~t.rlike("|".join(BUILDING_HINTS)) & ~t.rlike(FLOOR))
    out = F.array_join(solid, "")
    out = F.regexp_replace(out, r"(\d+)丁目", "$1-")
    out = F.regexp_replace(out, r"(\d+)番地?", "$1-")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(\d+)号$", "$1"), "-+$", ""))


#: Patterns that no company's name holds.
GARBAGE = (
    r"[〒]?\d{3}[-‐]?\d{4}",
    r"(?:北海道|東京都|大阪府|京都府|(?:.{2,3}県))(?:.{0,10}?)(?:市|区|町|村|丁目|番地)",
    r"第\d{5,}号",
    r"\d{5,}\s*(?:号|番)",
    r"を展開する株式会社$",
    r"^お客",
    r"お知らせ\d{4}年",
    r"採用キャリア採用",
    r"現在地から探す",
    r"都道府県から探",
    r"(?:現在地|都道府県)から探",
    r"株式会社[^株]{2,}(?:高校生専門|南アルプスガーデン店|柏駅前店|静岡県|愛知県|東京都|大阪府)$",
    r"本部オフィス",
    r"関係会社株式会社$",
)
#: Companies that turn up beside others without running their stores.
PORTALS = (
    "NTTタウンページ株式会社", "株式会社タウンページ",
    "株式会社ぐるなび", "株式会社カカクコム",
    "株式会社ゼンリン", "株式会社マピオン",
    "スターバックスコーヒージャパン株式会社",
    "株式会社バンダイナムコアミューズメント",
)


def structural_garbage(name: Column | str) -> Column:
    """Whether a name is empty, a portal's, or holds what no company's name holds."""
    return (nz(name) == "") | nz(name).rlike("|".join(f"(?:{p})" for p in GARBAGE)) | nz(name).isin(*PORTALS)


#: Forms of companies that may run a store, and of bodies that don't.
COMPANY_FORMS = ("株式会社", "有限会社", "合同会社")
OTHER_BODIES = ("医療法人", "学校法人", "社会福祉法人", "宗教法人", "財団法人", "社団法人", "組合", "連合会", "協議会", "独立行政法人", "国立大学", "公立大学")


def may_run_stores(name: Column | str) -> Column:
    """A company form, and none of the other bodies."""
    return nz(name).rlike("|".join(COMPANY_FORMS)) & ~nz(name).rlike("|".join(OTHER_BODIES))


def japanese_head(c: Column | str) -> Column:
    """The words before the first one of ASCII characters alone, joined; the first word if there are none."""
    words = F.split(F.trim(nz(c)), r"[\s　]+")
    stop = F.array_position(F.transform(words, lambda w: w.rlike(r"^\p{ASCII}+$")), True)
    kept = F.when(stop == 0, words).when(stop == 1, F.slice(words, 1, 1)).otherwise(F.slice(words, 1, F.greatest(stop - 1, F.lit(1)).cast("int")))
    return F.array_join(kept, "")


def brand_pattern(brands: list[str]) -> str:
    """Pattern of any of these at the beginning, the longest first, in either case."""
    return "(?i)^(?:" + "|".join(rf"\Q{b}\E\s*" for b in sorted(brands, key=len, reverse=True)) + ")"


def brand_list(c: Column | str, aliases: dict[str, str]) -> Column:
    """Brands of a joined text, each by its main name and once; X stands for none."""
    parts = F.filter(F.transform(F.split(nz(c), "[・、,/／]"), lambda x: F.trim(x)), lambda x: (x != "") & (F.upper(x) != "X"))
    return F.array_distinct(F.transform(parts, lambda x: canonical_brand(x, aliases)))


def canonical_brand(c: Column | str, aliases: dict[str, str]) -> Column:
    """The main name of a brand, by a table of other spellings."""
    raw = F.trim(nz(c))
    if not aliases:
        return raw
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), raw), raw)


def thousand_yen(c: Column | str) -> Column:
    """Yen of an amount in thousands; 0 for what is none."""
    return whole_number(c) * 1000


def canonical_url(url: Column | str, host: str, home: str) -> Column:
    """URLs of a host (or below it) as home and the path, with a closing slash and without query; other URLs trimmed."""
    u = F.trim(nz(url))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    path = F.when(path == "", "/").when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))
    ours = F.contains(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(host))
    return F.when(ours, F.concat(F.lit(home), path)).otherwise(u)


def text_before(matches: Column, gaps: Column, chars: int = 200, shortest: int = 5) -> Column:
    """For each match of a text the characters before it, from all matches and the gaps around them, in order; matches have the shortest length at least."""
    pairs = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    back = -(-chars // shortest)
    earlier = lambda i: F.array_join(F.transform(F.slice(pairs, F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), lambda p: F.concat(nz(p["g"]), nz(p["m"]))), "")
    whole = F.transform(matches, lambda m, i: F.concat(F.when(i > 0, earlier(i)).otherwise(""), F.get(gaps, i)))
    return F.transform(whole, lambda b: F.substring(b, F.greatest(F.length(b) - chars + 1, F.lit(1)), F.lit(chars)))
