from pyspark.sql import functions as F

from sitegraph.functions import japan, text
from sitegraph.operators import bake, decide, judge, master, matching, ranks, registry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_addresses(spark):
    for tail in (" サンハイツ 3F", " 203", " コーポ山", "　B1F", " 2階", ""):
        assert one(spark, "〒100-0001 東京都港区1丁目2番3号" + tail, text.normalize_address) == "東京都港区1-2-3"
    got = one(spark, "大阪府大阪市中央区難波１丁目２番地３", japan.parse_address)
    assert (got.pref, got.city, got.rest) == ("大阪府", "大阪市中央区", "難波1-2-3")
    got = one(spark, "北海道余市郡余市町1", japan.parse_address)
    assert (got.pref, got.city) == ("北海道", "余市")  # the shortest run up to one of the signs
    assert tuple(one(spark, None, japan.parse_address)) == ("", "", "", "")
    assert one(spark, "〒100-0001 東京都千代田区千代田1丁目1番1号 日本ビル3F", japan.block_address) == "東京都千代田区千代田1-1-1"
    assert one(spark, "東京都千代田区丸の内二丁目四番一号", japan.block_address) == "東京都千代田区丸の内2-4-1"
    assert tuple(one(spark, "〒402-0054 山梨県都留市田原２丁目", japan.place_parts)) == ("山梨県", "都留市", "田原")
    assert tuple(one(spark, "nowhere", japan.place_parts)) == ("", "", "")
    assert one(spark, "〒1 東 京 都港区", japan.prefecture_in) == "東京都"


def test_garbage(spark):
    bad = ["東京都港区赤坂1丁目", "株式会社モスを展開する株式会社", "第123456号", "現在地から探す", "株式会社ぐるなび", "お客さま", "本部オフィス", None, ""]
    assert all(one(spark, x, text.structural_garbage) for x in bad)
    assert not one(spark, "株式会社山田商事", text.structural_garbage)


def test_fuzzy_names(spark):
    df = spark.createDataFrame([("株式会社ファストフィットネス", "株式会社ファストフイットネス"), ("ABC FOOD 株式会社", "株式会社 FOOD ABC"), ("株式会社山田商事", "株式会社鈴木物産")], "a string, b string")
    assert [r[0] for r in df.select(text.operators_match(F.col("a"), F.col("b"), fuzzy=True)).collect()] == [True, True, False]
    assert [round(r[0], 1) for r in df.select(text.ratio(F.lit("abcd"), F.lit("abed"))).collect()] == [75.0] * 3


def test_company_names(spark):
    names = lambda t: one(spark, t, decide.company_names)
    assert names("株式会社アルペンクイックフィットネス キャンペーン期間2026年4月1日") == ["株式会社アルペンクイックフィットネス"]
    assert names("㈱Ａ社株式会社Ｂ社") == ["(株)A社", "株式会社B社", "A社株式会社"]
    assert names("会社概要 名称 山田フーズ株式会社 所在地") == ["山田フーズ株式会社"]
    assert names("株式会社について") == [] and names(None) is None or names("") == []


def test_evidence_of_a_page(spark):
    page = "運営会社: 株式会社エー。" + "あ" * 300 + "運営会社は株式会社エー、全店直営"
    rows = decide.page_evidence(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, text string"), "id", "text").collect()
    assert {(r.keyword, r.pos) for r in rows} >= {("運営会社", 0), ("運営会社", 313), ("全店直営", 325)} and all(r.id == 1 for r in rows)
    assert all(len(r.snippet) <= 400 and r.keyword in page for r in rows)


def test_decision_order(spark):
    rows = [(1, 0, "u", "全店直営。運営: 株式会社エー", "x"), (1, 1, "u", "株式会社ビー", "x"), (2, 0, "u", "株式会社シーは本部会社", "x"), (3, 0, "u", "直営店", "x"), (3, 1, "u", "直営店", "x"), (4, 0, "u", None, None)]
    got = {r.place_id: (r.operator_name, r.operator_type, r.confidence) for r in decide.decide(spark.createDataFrame(rows, "place_id int, seq int, url string, snippet string, reason string")).collect()}
    assert got == {1: ("株式会社エー", "franchisee", 0.9), 2: ("株式会社シー", "franchisor", 0.65), 3: ("", "direct", 0.6), 4: ("", "unknown", 0.0)}


def test_recruitment_distances(spark):
    op, keys = F.lit("株式会社エー"), F.array(F.lit("港南店"), F.lit("03-1"))
    seen = lambda t: one(spark, t, lambda c: decide.recruitment_evidence(c, op, keys))
    assert seen("求人 会社名 株式会社エー " + "x" * 1480 + "港南店").found
    assert seen("求人 会社名 株式会社エー " + "x" * 1600 + "港南店").reason == "store_key_not_near_operator"
    assert seen("求人 港南店 " + "x" * 400 + "株式会社エー " + "x" * 130 + "会社名").reason == "operator_without_employer_label"
    assert seen("求人 会社名 株式会社エー 03-1").store_key == "03-1"


def test_judgement_rules(spark):
    schema = "place_id int, operation_type string, franchisor_name string, franchisee_name string, confidence double"
    a, b = spark.createDataFrame([(1, "direct", "A", "", 0.9), (2, "direct", "A", "", 0.9)], schema), spark.createDataFrame([(1, "franchisee", "B", "C", 0.5), (2, "franchisee", "B", "C", 0.5)], schema)
    critic = spark.createDataFrame([(1, "prefer_b", None, 0.7), (2, "both_wrong", "a", -0.1)], "place_id int, verdict string, preferred_side string, adjustment double")
    assert [tuple(r) for r in judge.panel(a, b, critic).orderBy("place_id").collect()] == [(1, "franchisee", "B", "C", 1.0), (2, "unknown", "", "", 0.15)]
    assert judge.agreement(judge.compared(a.limit(0), b)).first().operator_agreement is None


def test_positions_and_master(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "id int, k int")
    got = ranks.positioned(df, [F.desc("k"), F.asc("id")], "p").collect()
    want = {i: n for n, (_, i) in enumerate(sorted((-(i % 7), i) for i in range(200)), 1)}
    assert {r.id: r.p for r in got} == want and ranks.positioned(df.limit(0), [F.asc("id")], "p").count() == 0
    rows = spark.createDataFrame([("株式会社エー", "", 1), ("㈱エー", "5", 2), ("ビー", "5", 3), ("シー", None, 4), ("", "9", 5)], "operator_name string, corporate_number string, id int")
    assert {r.id: r.bucket for r in master.bucketed(rows).collect()} == {1: "CORP::5", 2: "CORP::5", 3: "CORP::5", 4: "NAME::シー"}


def test_gates_without_rows(spark):
    pages = spark.createDataFrame([], "place_id int, html string, text string, fetch_error string, store_keys array<string>, blocked_names array<string>, registry_name string")
    assert decide.page_acceptance(pages).count() == 0
    names = spark.createDataFrame([], "name string")
    reg = spark.createDataFrame([], "corporate_number string, name string, normalized_name string, process string, prefecture string, city string, street string")
    assert registry.cascade(names, reg).count() == registry.exact_verified(names, reg).count() == 0


def test_bake(spark):
    places = spark.createDataFrame([("1", " a\t", "x", 35.0, 139.0, "https://u", ""), ("1", "b", "x", 35.0, 139.0, "https://u", ""), ("", "c", "", 0.0, 0.0, "", None)], "place_id string, name string, address string, lat double, lng double, official_url string, phone string")
    pages = spark.createDataFrame([("https://u", "t", "m", {"place_id": "9"})], "url string, title string, markdown string, metadata map<string,string>")
    judged = spark.createDataFrame([("1", "", True, "", "株式会社エー", "", 0.5), ("2", "direct", False, "", "", "本部", 0.5)], "place_id string, operation_type string, is_franchise boolean, operator_name string, franchisee_name string, franchisor_name string, confidence double")
    out = bake.bake(places, "B", pages, judged)
    assert sorted((r.place_id, r.name, r.brand) for r in out["stores"].collect()) == [("", "c", "B"), ("1", "b", "B")]
    assert [r.place_id for r in out["documents"].collect()] == ["9"] and [(r.operator_name, r.operator_type) for r in out["operator_stores"].collect()] == [("株式会社エー", "franchisee")]
    assert list(bake.bake(places, "B")) == ["stores"]
    told = bake.canonicalised(spark.createDataFrame([("㈱A",), ("B",)], "name string"), spark.createDataFrame([("B", "株式会社B")], "name string, canonical string"))
    assert {r.name: r.canonical for r in told.collect()} == {"㈱A": "株式会社a", "B": "株式会社B"}


def test_pairs_and_what_is_left(spark):
    s = spark.createDataFrame([(1, "x", 35.0, 139.0), (2, "x", 35.0001, 139.0), (3, "x", 35.02, 139.0), (4, "y", 35.0, 139.0), (5, "y", 35.03, 139.0)], "id int, brand string, lat double, lng double")
    radii = spark.createDataFrame([("x", 100.0, 1500.0), ("z", 1.0, 4000.0)], "brand string, dominant_min_m double, territory_max_m double")
    got = {(r.a_id, r.b_id): r.relation for r in matching.classify_pairs(s, radii=radii).collect()}
    assert got == {(1, 2): "DUPLICATE", (1, 3): "INDEPENDENT", (2, 3): "INDEPENDENT", (4, 5): "INDEPENDENT"}
    top, bottom = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(7,), (8,)], "id int")
    left = matching.unmatched(top, bottom, spark.createDataFrame([(1, 8)], "top_id int, bottom_id int"))
    assert [[r.id for r in x.collect()] for x in left] == [[2], [7]]
