from pyspark.sql import functions as F

from sitegraph.operators import audit, matching, registry, views, writes
from sitegraph.sources import files

STORES = "operator_name string, place_id long, brand string, operator_type string, discovered_via string, confidence double, verification_score double, corporate_number string"


def test_views_keep_null_types_and_drop_blank_names(spark):
    os = spark.createDataFrame([("a", 1, "x", None, "v", 0.5, 0.1, ""), ("a", 2, "y", "franchisee", "v", 0.7, 0.2, "1"), ("", 3, "x", "unknown", "v", 0.1, 0.1, ""), (None, 4, "x", "unknown", "v", 0.1, 0.1, ""), ("h", 5, "x", "franchisor", "v", 0.1, 0.1, "")], STORES)
    rows = views.all_franchisees(os).collect()
    assert [(r.operator_name, r.store_count, r.brands, r.size_class, r.corporate_number) for r in rows] == [("a", 2, "x,y", "small", "1")]
    assert views.multi_brand(os).first().total_stores == 2
    assert views.franchisors(os).first().operator_name == "h"
    assert views.mega_franchisees(os.limit(0)).count() == 0


def test_merge_keeps_first_filled(spark):
    rows = spark.createDataFrame([(1, "a", 1, "", "unknown", "v", 0.3, 0.1, ""), (2, "a", 1, "x", "direct", "w", 0.9, 0.0, "7"), (3, "a", 1, "y", "direct", "w", 0.2, 0.0, "")], "seq int, " + STORES)
    r = writes.merge_operator_stores(rows).first()
    assert (r.brand, r.operator_type, r.confidence, r.corporate_number) == ("x", "unknown", 0.9, "7")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    assert sorted(map(tuple, writes.insert_or_ignore(old, new, ["id"], ["v"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, writes.upsert(old, writes.last_wins(new, ["id"], ["v"]), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    blank = spark.createDataFrame([("", 1), ("", 2), ("k", 3), ("k", 4)], "k string, n int")
    assert sorted(r.n for r in writes.first_wins(blank, ["k"], ["n"], blank_passes=True).collect()) == [1, 2, 3]


def test_greedy_pairs(spark):
    pairs = spark.createDataFrame([(1, 10, 5.0), (1, 11, 6.0), (2, 10, 4.0), (2, 11, 9.0), (3, 11, 1.0)], "a_id long, b_id long, metres double")
    assert sorted((r.a_id, r.b_id) for r in matching.greedy_one_to_one(pairs).collect()) == [(2, 10), (3, 11)]


def test_cascade_prefers_the_first_tier(spark):
    rows = spark.createDataFrame([("1", "Abc", "abc", "01"), ("2", "Abcdef", "abcdef", "01"), ("3", "abc", "abc", "71"), ("4", "xyAbq", "xyabq", "01")], "corporate_number string, name string, normalized_name string, process string")
    names = spark.createDataFrame([("Abc",), ("Abcd",), ("abcde",), ("zzz",), ("ABC",), ("yAb",), ("q",), ("",), (None,)], "name string")
    got = {r.name: (r.corporate_number, r.tier) for r in registry.cascade(names, rows).collect()}
    assert got == {"Abc": ("1", 1), "Abcd": ("2", 3), "abcde": ("2", 4), "ABC": ("1", 2), "yAb": ("4", 5), "q": ("4", 5)}
    assert registry.cascade(names.limit(0), rows).count() == 0


def test_audit(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, None)], "id int, t string, g string")
    assert audit.accuracy(rows, "t", "g").first().accuracy == 0.6667
    assert audit.accuracy(rows.limit(0), "t", "g").first().accuracy == 0.0
    assert [r.reason for r in audit.first_reason(rows, [("null", F.col("t").isNull()), ("wrong", F.col("t") != F.col("g"))]).orderBy("id").collect()] == ["accepted", "wrong", "null"]
    assert audit.truth_recall(rows.limit(0), rows, ["t"]).first().recall == 0.0


def test_sources(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("1,1234567890123,01,x,2024-01-01,x,㈱山田,x,x,東京都,千代田区,1-1,x\n2,12,01,x,x,x,y,x,x,x,x,x,x\n3,1234567890123,01,x,2024-02-01,x,山田,x,x,東京都,千代田区,1-1,x\n", encoding="utf-8")
    reg = files.registry_csv(spark, f"file://{p}")
    assert reg.count() == 2 and files.latest(reg).first().name == "山田"
    t = tmp_path / "m.tsv"
    t.write_text("# one\nname\tbrand\na\tb\n\n# two\nX\tb\nc\td\n", encoding="utf-8")
    rows = files.sections_tsv(spark, f"file://{t}").collect()
    assert [(r.section, r.fields[0]) for r in rows] == [("one", "name"), ("one", "a"), ("two", "c")]
    j = tmp_path / "p.json"
    j.write_text('{"places":[{"id":"1","displayName":{"text":"n"},"formattedAddress":"a","location":{"latitude":1.0,"longitude":2.0},"internationalPhoneNumber":"+81"}]}\n')
    assert files.places_json(spark, f"file://{j}").first().phone == "+81"
    o = tmp_path / "o.json"
    o.write_text('{"elements":[{"type":"way","id":1,"center":{"lat":1.0,"lon":2.0},"tags":{"name":"Foo Bar"}},{"type":"node","id":2,"lat":1.0,"lon":2.0,"tags":{"name":"Foo","not:brand":"x"}}]}\n')
    assert [r.osm_id for r in files.osm_of_brand(files.osm_json(spark, f"file://{o}"), ["foo"]).collect()] == ["way/1"]
    e = tmp_path / "e.json"
    e.write_text('{"GET_STATS_DATA":{"STATISTICAL_DATA":{"DATA_INF":{"VALUE":[{"@area":"13","@cat01":"I","$":"12"},{"@area":"14","@cat01":"I","$":"-"}]}}}}\n')
    assert [r.n for r in files.estat_json(spark, f"file://{e}").collect()] == [12, 0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "brand string, n int")
    files.write_csv(df, f"file://{tmp_path}/c", ["n", "brand", "note"], ["n"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["n", "brand", "note"]
    files.write_by_brand(df, f"file://{tmp_path}/b", min_rows=2)
    assert [r.brand for r in spark.read.option("header", True).csv(f"file://{tmp_path}/b").select("brand").distinct().collect()] == ["b"]
