from pyspark.sql import functions as F

from sitegraph.functions import geo, text


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(f("v")).first()[0]


def test_operator_name(spark):
    assert one(spark, " (株) 山田　商事。", text.operator_name) == "株式会社山田 商事"
    assert one(spark, "㈱ＡＢＣ", text.canonical_key) == "株式会社abc"
    assert one(spark, None, text.operator_name) == ""
    assert one(spark, "ABC 株式会社", text.core_key) == "abc"


def test_values(spark):
    assert one(spark, "a / b / ", text.split_values) == ["a", "b"]
    assert one(spark, "x;1234567890123;y", text.first_number) == "1234567890123"
    assert one(spark, None, text.first_number) == ""
    assert one(spark, "1,234.0", text.whole_number) == 1234
    assert one(spark, "none", text.whole_number) == 0
    assert one(spark, "A(B)/C", text.brand_variants) == ["A(B)", "B", "A", "C"]


def test_address(spark):
    assert one(spark, "〒100-0001 東京都千代田区１丁目２番３号 山田ビル 2F", text.normalize_address) == "東京都千代田区1-2-3"


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("a", "b"), ("", "x"), ("abc", "xabc"), ("abc", "abc")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(text.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.0, 0.0, 0.9, 1.0]
    both = df.select(text.bigram_jaccard(F.col("a"), F.col("b")) == text.bigram_jaccard(F.col("b"), F.col("a"))).collect()
    assert all(r[0] for r in both)


def test_operators_match(spark):
    df = spark.createDataFrame([("株式会社川勝商事", "川勝商事株式会社"), ("abc", "xabcx"), ("ab", "xab"), (None, None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.operators_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_garbage(spark):
    df = spark.createDataFrame([("〒100-0001 x",), ("お客さま",), ("株式会社山田",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(text.structural_garbage("v")).collect()] == [True, True, False, True, True]


def test_geo(spark):
    df = spark.createDataFrame([(35.0, 139.0), (35.5, 139.5), (40.0, 139.5)], "lat double, lng double")
    square = [(35.1, 139.1), (36.0, 139.1), (36.0, 140.0), (35.1, 140.0)]
    assert [r[0] for r in df.select(geo.in_polygon(F.col("lat"), F.col("lng"), square)).collect()] == [False, True, False]
    d = df.limit(1).select(geo.haversine_m(F.lit(35.0), F.lit(139.0), F.lit(35.0), F.lit(139.01)), geo.flat_m(F.lit(35.0), F.lit(139.0), F.lit(35.0), F.lit(139.01))).first()
    assert abs(d[0] - 910.9) < 1 and abs(d[1] - 911.9) < 1
    root = spark.createDataFrame([("r", 0.0, 0.0, 2.0, 2.0)], "id string, south double, west double, north double, east double")
    assert sorted(tuple(r) for r in geo.quarter(root).collect()) == [("r-NE", 1.0, 1.0, 2.0, 2.0), ("r-NW", 1.0, 0.0, 2.0, 1.0), ("r-SE", 0.0, 1.0, 1.0, 2.0), ("r-SW", 0.0, 0.0, 1.0, 1.0)]
