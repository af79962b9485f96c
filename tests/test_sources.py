import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sitegraph.functions.text import brand_match_key
from sitegraph.operators import matching, stores
from sitegraph.sources import files, franchisee_pages
from sitegraph.streaming import events

ROW = '{n},{c},01,x,2024-01-0{n},x,"㈱山田, 商事",x,x,東京都,千代田区,1-1,x\n'


def test_registry_files_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(ROW.format(n=1, c="1" * 13).encode("cp932"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + ROW.format(n=2, c="2" * 13).encode() + "3,12,short\n".encode())
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x/one.CSV", ROW.format(n=3, c="1" * 13))
        z.writestr("readme.txt", "no")
    (tmp_path / "c.zip").write_bytes(buf.getvalue())
    rows = files.registry_files(spark, f"file://{tmp_path}/*").collect()
    assert sorted((r.corporate_number, r.name, r.normalized_name) for r in rows) == [("1" * 13, "㈱山田, 商事", "株式会社山田, 商事")] * 2 + [("2" * 13, "㈱山田, 商事", "株式会社山田, 商事")]
    df = files.registry_files(spark, f"file://{tmp_path}/*")
    kept = files.ingested(df.where("update_date < '2024-01-03'"), df.where("update_date >= '2024-01-03'"))
    assert sorted((r.corporate_number, r.update_date) for r in kept.collect()) == [("1" * 13, "2024-01-03"), ("2" * 13, "2024-01-02")]
    assert files.decode("山".encode("cp932")) == "山" and files.decode(b"\x81\xff\x81").count("\ufffd") >= 1


def test_web_answers(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<corporations><corporation><corporateNumber>1</corporateNumber><name> 山田 </name><prefectureName>東京都</prefectureName><cityName>港区</cityName><process>01</process></corporation></corporations>", encoding="utf-8")
    r = files.registry_xml(spark, f"file://{tmp_path}/a.xml").first()
    assert (r.corporate_number, r.name, r.address, r.process, r.update_date) == ("1", "山田", "東京都港区", "01", "")
    (tmp_path / "g.json").write_text('{"hojin-infos":[{"corporate_number":"1","name":"a","location":"b"},{"name":"none"}]}')
    g = files.gbiz_json(spark, f"file://{tmp_path}/g.json").collect()
    assert [(x.corporate_number, x.address, x.kind) for x in g] == [("1", "b", "")]
    (tmp_path / "f.json").write_text('{"results":[{"docID":"S1","filerName":"a","docTypeCode":"120"},{"docID":"S2","docTypeCode":"350"}]}')
    assert [x.doc_id for x in files.filings_json(spark, f"file://{tmp_path}/f.json", ("120",)).collect()] == ["S1"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("XBRL/PublicDoc/a.htm", "<h2>関係会社の状況</h2><td>株式会社子会社エー</td><td>ビー物産株式会社</td><td>株式会社子会社エー</td>")
        z.writestr("XBRL/PublicDoc/b.htm", "short")
    (tmp_path / "S1.zip").write_bytes(buf.getvalue())
    (tmp_path / "S2.zip").write_bytes(b"no archive")
    pages = files.filing_pages(spark, f"file://{tmp_path}/*.zip")
    assert sorted(x.name for x in files.related_companies(pages, "path").collect()) == ["ビー物産株式会社", "株式会社子会社エー"]
    (tmp_path / "o.json").write_text('{"elements":[{"type":"node","id":1,"lat":35.0,"lon":139.0,"tags":{"name:ja":"カーブス 港"}},{"type":"node","id":2,"lat":50.0,"lon":139.0,"tags":{"brand":"カーブス"}}]}')
    e = files.osm_json(spark, f"file://{tmp_path}/o.json", boxes=[(30.0, 130.0, 40.0, 140.0)])
    assert [x.osm_id for x in files.osm_of_brand(e, ["カーブス"]).collect()] == ["node/1"]


def test_member_and_disclosure_pages(spark):
    html = "<table><tr><th>x</th></tr><tr><td>（株）モス MOS FOOD INC.<br></td><td>モス<br>ハンバーガーの提供</td><td><a href=\"https://m\">m</a></td></tr><tr><td>株式会社銀行</td><td>金融サービス</td></tr><tr><td>株式会社銀行</td><td>y</td></tr></table>"
    rows = files.member_index(spark.createDataFrame([("u", html)], "url string, html string")).orderBy("operator_name").collect()
    assert [(r.operator_name, r.brand, r.industry, r.url) for r in rows] == [("株式会社モス", "モス", "ハンバーガーの提供", "https://m"), ("株式会社銀行", "", "金融サービス", "")]
    html = '<!-- <table class="tbl_kaiji"><tr><td>株式会社旧</td><td><a href="/old.pdf">旧</a></td></tr></table> --><table class="tbl_kaiji"><tr><th class="thColor01">外食</th></tr><tr><td>㈱コメダ</td><td><a href="/fc/k.PDF">コメダ</a> <a href="/x.html">y</a></td></tr><tr><td>-</td><td><a href="/z.pdf">z</a></td></tr></table>'
    rows = files.disclosure_index(spark.createDataFrame([(html,)], "html string"), "https://j.example/").collect()
    assert [tuple(r) for r in rows] == [("株式会社コメダ", "コメダ", "外食", "https://j.example/fc/k.PDF")]
    html = '<ul><li> <a href="/kanto/minato/"><p class="name">港店</p><p class="address">東京都 港区</p></a></li><li><a href="/x/"><p class="name">y</p></a></li></ul>'
    rows = files.official_list(spark.createDataFrame([("東京都", html)], "prefecture string, html string"), "https://a.example").collect()
    assert [tuple(r) for r in rows] == [("東京都", "港店", "東京都 港区", "https://a.example/kanto/minato/", "minato")]


def test_franchisee_pages(spark):
    pages = [
        ("B", "u1", "brand_off_company", "<p>株式会社 K-ブランドオフ</p><p>店舗数 60 店舗</p>"),
        ("B", "u2", "brand_off_fc", "<p>加盟者名：㈱エー</p><p>BRAND OFF 仙台店、BRAND OFF買取専門店</p><p>加盟者名: 株式会社ビー</p><p>函館にて</p>"),
        ("K", "u3", "kandon_prtimes", "<p>韓丼 開店</p><p>◇運営会社：株式会社シー</p><p>◇店名：韓丼 宇治店</p><p>◇所在地：京都府宇治市 広野町1</p>"),
        ("K", "u4", "haricom_company", "<p>会社名</p><p>株式会社ディー</p><p>法人番号</p><p>1234567890123</p><p>韓丼八女店、韓丼久留米店</p>"),
        ("K", "u5", "birion_company", "<p>カルビ丼とスン豆腐専門店</p><p>株式会社 ビリオンフーズハヤシ</p><p>大宮店 鯖江店</p>"),
        ("K", "u6", "unknown", "x"), ("K", "u7", "kandon_prtimes", "none"), ("K", "u8", "birion_company", None),
    ]
    rows = franchisee_pages.franchisee_rows(spark.createDataFrame(pages, "brand string, url string, parser string, html string")).orderBy("source_url", "operator_name").collect()
    got = [(r.source_url, r.operator_name, r.operator_type, r.estimated_store_count, r.store_names, r.context_prefecture, r.context_city, r.corporate_number) for r in rows]
    assert got == [
        ("u1", "株式会社K-ブランドオフ", "franchisor", 60, [], "", "", ""), ("u2", "株式会社エー", "franchisee", 1, ["BRAND OFF 仙台店"], "宮城県", "仙台市", ""), ("u2", "株式会社ビー", "franchisee", 1, ["BRAND OFF 仙台店"], "北海道", "函館市", ""),
        ("u3", "株式会社シー", "franchisee", 1, ["韓丼 宇治店"], "京都府", "宇治市", ""), ("u4", "株式会社ディー", "franchisee", 2, ["韓丼八女店", "韓丼久留米店"], "福岡県", "八女市", "1234567890123"), ("u5", "株式会社ビリオンフーズハヤシ", "franchisee", 2, ["大宮店", "鯖江店"], "福井県", "", ""),
    ]


def test_manual_tables(spark, tmp_path):
    t = tmp_path / "m.tsv"
    t.write_text("# megajii\n企業名\tx\n(株)エー\t外食\t1,2\t代表\t東京都\t1,000\tx\t-\thttps://a\tカーブス・Curves、X\n少\t1\n# franchisor list\nビー\tCurves\t業\t3\t代\t住\t2\t1\t-\tw\tb\tr\n", encoding="utf-8")
    rows = files.manual_rows(spark, f"file://{t}", {"Curves": "カーブス"}).orderBy("line").collect()
    assert [(r.section, r.name, r.brand, r.store_count, r.revenue_current_jpy, r.brands) for r in rows] == [("megajii", "(株)エー", "", 12, 1_000_000, ["カーブス"]), ("franchisor", "ビー", "カーブス", 3, 2000, ["b"])]
    links = files.imported_links(files.manual_rows(spark, f"file://{t}", {"Curves": "カーブス"}), spark.createDataFrame([("株式会社エー", "1")], "name string, corporate_number string"), "manual").collect()
    assert [(r.brand, r.operator_name, r.corporate_number, r.source) for r in links] == [("カーブス", "株式会社エー", "1", "manual")]
    s = tmp_path / "s.tsv"
    s.write_text("franchisor_name\tbrand_name\n㈱エー\tABC(DEF)/カーブス\n株式会社エー\tabc\n\tx\n", encoding="utf-8")
    seeds = files.seed_brands(files.seeds_tsv(spark, f"file://{s}"), {}, ["カーブス"], brand_match_key)
    assert sorted((r.brand, r.franchisor) for r in seeds.collect()) == [("ABC", "株式会社エー"), ("ABC(DEF)", "株式会社エー"), ("DEF", "株式会社エー")]


def test_hand_written_knowledge(spark, tmp_path):
    pytest.importorskip("yaml")
    k = tmp_path / "k.yaml"
    k.write_text("brands:\n  カーブス:\n    known_franchisees:\n      - {name: 株式会社エー, corporate_number: 1, estimated_store_count: 2}\nmulti_brand_operators:\n  - {name: 株式会社エー, corporate_number: 1, brands: {カーブス: 2, モス バーガー: 1}}\n", encoding="utf-8")
    known = files.knowledge(spark, f"file://{k}")
    assert sorted((r.brand, r.estimated_store_count, r.total_stores, r.kind) for r in known.collect()) == [("カーブス", 2, 2, "franchisee"), ("カーブス", 2, 3, "multi_brand"), ("モス バーガー", 1, 3, "multi_brand")]
    assert sorted(r.place_id for r in files.registry_stores(known).collect()) == ["REG-MBO:1:モスバーガー:1", "REG:1:1", "REG:1:2"]
    c = tmp_path / "c.yaml"
    c.write_text("brands:\n  A:\n    conflicts: [{pattern: x}, {pattern: ' '}]\n  B: {}\n")
    assert [tuple(r) for r in files.brand_conflicts(spark, f"file://{c}").collect()] == [("A", "x")]
    t = tmp_path / "t.yaml"
    t.write_text("industries:\n  gym: {strategy: territory, dominant_min_m: 100, dominant_typical_m: 500, territory_max_m: 2000}\nbrands:\n  A: {industry: gym, dominant_min_m: 50}\n  B: {industry: none}\n")
    rows = matching.territories(*files.territory_tables(spark, f"file://{t}")).orderBy("brand").collect()
    assert [(r.brand, r.strategy, r.dominant_min_m, r.territory_max_m) for r in rows] == [("A", "territory", 50.0, 2000.0), ("B", "unknown", 0.0, 0.0)]


def test_report_files(spark, tmp_path):
    read = lambda p: spark.read.option("header", True).csv(f"file://{tmp_path}/{p}")
    rows = spark.createDataFrame([("b", "x", 2.5, "2024-02-01"), ("a", "y", 3.0, "2024-01-01")], "place_id string, brand string, lat double, extracted_at string")
    files.write_stores(rows, f"file://{tmp_path}/s")
    assert [r.place_id for r in read("s").collect()] == ["a", "b"] and read("s").columns == files.STORE_FIELDS
    links = spark.createDataFrame([(1, "x", 2), (2, "y", 5)], "id int, brand_name string, estimated_store_count int")
    files.write_links(links, f"file://{tmp_path}/l")
    assert [r.brand_name for r in read("l").collect()] == ["y", "x"]
    files.write_by_brand(spark.createDataFrame([("a/b:c", 1), ("..", 2)], "brand string, n int"), f"file://{tmp_path}/f")
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["folder=a_b_c", "folder=unknown"]
    files.write_candidates(links, f"file://{tmp_path}/y", "id")
    assert "candidates:" in (next((tmp_path / "y").glob("part-*"))).read_text()
    with pytest.raises(ValueError):
        files.write_candidates(links, f"file://{tmp_path}/z", "id", most=1)
    registered = spark.createDataFrame([("o", 4), ("p", 0)], "operator_name string, registered int")
    top = spark.createDataFrame([("o", 1), ("o", 2)], "operator_name string, top_id int")
    parts = stores.audit(registered, top, spark.createDataFrame([(1, 10)], "top_id int, bottom_id int"), spark.createDataFrame([(10, "n"), (11, "m")], "place_id int, name string"))
    files.write_audit(*parts, f"file://{tmp_path}/audit")
    assert [(r.operator_name, r.coverage_pct) for r in read("audit").collect()] == [("o", "25.0"), ("p", "0.0")]
    assert [r.place_id for r in read("audit-unknown-stores").collect()] == ["11"] and [r.operator_name for r in read("audit-missing-operators").collect()] == ["p"]
    found = spark.createDataFrame([(1, True), (2, False)], "id int, accepted boolean")
    files.write_sidecars(found, found.select("id", F.col("accepted").alias("found")), f"file://{tmp_path}/side", ["id"])
    assert [[r.id for r in read(f"side-{p}").collect()] for p in ("candidates", "failed-urls", "unverified", "accepted")] == [["1", "2"], ["2"], ["2"], ["1"]]


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    src, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    schema = "k int, v string, n int"
    spark.createDataFrame([(i, "old", i) for i in range(50)], schema).coalesce(1).write.parquet(f"file://{src}")
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{src}")
    assert events.upsert_sink(stream(), ["k"], ["n"], base).count() == 50
    spark.createDataFrame([(3, "new", 1000), (77, "new", 77), (4, "stale", -1)], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
    rows = {r.k: r.v for r in events.upsert_sink(stream(), ["k"], ["n"], base).collect()}
    assert len(rows) == 51 and rows[3] == "new" and rows[4] == "old" and rows[77] == "new" and rows[49] == "old"
    again = {r.k: r.v for r in events.upsert_sink(stream(), ["k"], ["n"], base).collect()}
    assert again == rows


def test_streams_of_requests(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, t string").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema("k int, t string").parquet(f"file://{tmp_path}/e").withColumn("t", F.col("t").cast("timestamp"))
    assert events.drain(events.running_dedupe(s, ["k"], at="t", within="1 hour"), "bounded").count() == 2
    told = events.judged(s, spark.createDataFrame([(1, "direct")], "k int, operation_type string"), "k")
    assert sorted((r.k, r.operation_type) for r in events.drain(told, "judged").collect()) == [(1, "direct"), (1, "direct"), (2, "unknown")]
