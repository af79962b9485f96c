"""Registered queries on a small fixture against brute force over all of its rows."""

import datetime
import math
import random
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sitegraph.operators import matching, registry, stores
from sitegraph.operators.greedy import greedy_in_groups
from sitegraph.plans import catalog, domain, entities, jp, more  # noqa: F401


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """63 stores of 24 of 60 customers in 10 nations, as tables of the driver; the last three, of three operators, bear one name."""
    d = tmp_path_factory.mktemp("small")
    day = datetime.date(2020, 1, 1)
    put = lambda name, **columns: pq.write_table(pa.table(columns), d / f"{name}.parquet")
    put("nation", n_nationkey=list(range(10)), n_name=[f"NATION_{i}" for i in range(10)])
    put("customer", c_custkey=list(range(1, 61)), c_nationkey=[i * 7 % 10 for i in range(1, 61)])
    put("orders", o_orderkey=[i + 6000 * j for j in (0, 1) for i in range(1, 31)] + [48507, 97007, 145507], o_custkey=[1 + (i * i + i // 9) % 24 for i in range(1, 61)] + [1, 11, 21], o_orderdate=[day] * 63)
    return str(d)


def test_near_singleton_brands_counts_every_store(spark, small):
    operators = defaultdict(set)
    for r in domain.stores(spark, small).collect():
        operators[r.name].add(r.operator_hint)
    want = sorted((b, min(o), len(o)) for b, o in operators.items() if len(o) <= 2)
    assert want and len(want) < len(operators)
    assert sorted((r.brand, r.operator_name, r.n) for r in catalog.QUERIES["near_singleton_brands"](spark, small).collect()) == want


def test_missing_prefectures_counts_every_store(spark, small):
    there = defaultdict(set)
    for r in domain.stores(spark, small).collect():
        there[r.brand + " #" + r.name.rsplit("#", 1)[1]].add(r.prefecture)
    want = sorted((b, " / ".join(f"NATION_{i}" for i in range(10) if f"NATION_{i}" not in p)) for b, p in there.items())
    assert any(m for _, m in want)
    assert sorted(map(tuple, catalog.QUERIES["missing_prefectures"](spark, small).collect())) == want


def test_connected_operators_joins_through_every_nation(spark, small):
    group = {}
    stores = domain.stores(spark, small).where("official_url <> ''").collect()
    for r in stores:
        group.setdefault(r.operator_hint, {r.operator_hint})
    urls = defaultdict(list)
    for r in stores:
        urls[r.official_url].append(r.operator_hint)
    for nodes in urls.values():
        for n in nodes[1:]:
            both = group[nodes[0]] | group[n]
            group |= dict.fromkeys(both, both)
    want = sorted((n, min(g)) for n, g in group.items())
    assert sorted(map(tuple, catalog.QUERIES["connected_operators"](spark, small).collect())) == want


def test_ambiguity_resolution_ranks_the_companies_of_every_city(spark, small):
    scores = defaultdict(list)
    for r in domain.registry(spark, small).where("process <> '71'").collect():
        scores[r.prefecture].append((-(int(r.corporate_number) * 13 % 97), r.corporate_number))
    scores = {p: sorted(x) for p, x in scores.items()}
    want = sorted((p, x[0][1], -x[0][0] / 100) for p, x in scores.items() if len(x) == 1 or x[1][0] - x[0][0] >= 3)
    assert any(len(x) > 1 for x in scores.values()) and want
    assert sorted(map(tuple, catalog.QUERIES["ambiguity_resolution"](spark, small).collect())) == want


def alike(a, b):
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 0 if not x & y else 0.9 if a in b or b in a else round(len(x & y) / len(x | y), 4)


def best(names, least):
    scored = {a: min((-alike(a, b), b) for b in names if b != a) for a in names}
    return sorted((a, -s, b) for a, (s, b) in scored.items() if -s >= least)


def test_fuzzy_best_match_sees_every_nation(spark, small):
    want = best({r.normalized_name for r in domain.registry(spark, small).collect()}, 0.5)
    assert len(want) == 20
    assert sorted(map(tuple, catalog.QUERIES["fuzzy_best_match"](spark, small).select("a", "score", "b").collect())) == want


def test_best_among_equals_brute_force(spark):
    names = {"".join("abc"[i * k * k // 7 % 3] for i in range(1, 3 + k % 9)) for k in range(1, 90)} | {"ab", "xabcx", "zzzz", "z", "qab", "qabcabcab"}
    for least in (0.5, 0.35):
        got = matching.best_among(spark.createDataFrame([(n,) for n in names], "k string"), "k", least)
        assert sorted(map(tuple, got.select("a", "score", "b").collect())) == best(names, least)


def metres(a, b):
    h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lng - a.lng) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(h, 1.0)))


def test_pair_classification_takes_every_nation(spark, small):
    stores = sorted(domain.stores(spark, small).collect(), key=lambda r: r.place_id)
    want = [(a.place_id, b.place_id, a.brand, "DUPLICATE" if metres(a, b) <= 1500 else "DOMINANT") for a, b in combinations(stores, 2) if a.brand == b.brand and metres(a, b) <= 15000]
    assert want
    assert sorted(map(tuple, catalog.QUERIES["pair_classification"](spark, small).collect())) == want


def test_classify_pairs_keeps_to_the_brand(spark):
    stores = spark.createDataFrame([(1, "x", 35.0, 139.0), (2, "x", 35.0001, 139.0), (3, "x", 35.01, 139.0), (4, "y", 35.0, 139.0), (5, None, 35.0, 139.0), (6, None, 35.0, 139.0)], "id int, brand string, lat double, lng double")
    got = sorted(map(tuple, matching.classify_pairs(stores).collect()))
    assert got == [(1, 2, "x", "DUPLICATE"), (1, 3, "x", "DOMINANT"), (2, 3, "x", "DOMINANT")]


def test_layered_store_match_takes_every_nation(spark, small):
    kept = [r for r in domain.stores(spark, small).collect() if r.place_id % 3]
    got = {r.layer: r.n for r in catalog.QUERIES["layered_store_match"](spark, small).collect()}
    assert got["id"] == sum(r.place_id % 2 == 0 for r in kept)
    assert sum(got.values()) == len(kept)


def greedy(rows):
    a, b, out = set(), set(), []
    for m, x, y in sorted((m, x, y) for x, y, m in rows):
        if x not in a and y not in b:
            a.add(x), b.add(y), out.append((x, y, m))
    return sorted(out)


PAIRS = "a_id long, b_id long, metres double"


def test_greedy_matches_sixty_equal_stores(spark):
    rows = [(x, 1000 + y, 0.0) for x in range(60) for y in range(60)]
    assert sorted(map(tuple, matching.greedy_one_to_one(spark.createDataFrame(rows, PAIRS)).collect())) == greedy(rows)


def test_greedy_goes_on_to_the_end_of_a_chain(spark):
    rows = [r for i in range(54) for r in ((i, 1000 + i, 200.0 - 2 * i), (i, 1001 + i, 199.0 - 2 * i))]
    assert sorted(map(tuple, matching.greedy_one_to_one(spark.createDataFrame(rows, PAIRS)).collect())) == greedy(rows)


def test_greedy_equals_pair_after_pair(spark):
    for seed in range(5):
        r = random.Random(seed)
        rows = [(x, 1000 + y, float(r.choice((x // 4 == y // 4, 2, 3)))) for x in range(16) for y in range(14) if r.random() < (0.4 if seed % 2 else 0.9) or x // 4 == y // 4]
        assert sorted(map(tuple, matching.greedy_one_to_one(spark.createDataFrame(rows, PAIRS)).collect())) == greedy(rows)


def test_layered_match_lets_unknown_cities_match_any(spark):
    columns = "id int, prefecture string, city string, address string, lat double, lng double"
    top = spark.createDataFrame([(1, "P", "C", "P C Town1-1", 1.0, 1.0), (2, "P", "", "P C Town2-2", 2.0, 2.0), (3, "P", "D", "P C Town3-3", 3.0, 3.0), (4, None, None, "P C Town4-4", 4.0, 4.0), (5, "P", "C", "P C Town5-5", 5.0, 5.0)], columns)
    bottom = spark.createDataFrame([(11, "P", "", "P C Town1-1", 40.0, 1.0), (12, "P", "C", "P C Town2-2", 40.0, 2.0), (13, "P", "C", "P C Town3-3", 40.0, 3.0), (14, "Q", "E", "P C Town4-4", 40.0, 4.0), (15, "Q", "", "P C Town5-5", 40.0, 5.0)], columns)
    assert sorted(map(tuple, matching.layered_match(top, bottom, 0.95).collect())) == [(1, 11, "address"), (2, 12, "address"), (4, 14, "address")]


def test_greedy_in_groups_equals_pair_after_pair(spark):
    for seed in range(3):
        r = random.Random(seed)
        a, b = ([(k + i, r.randrange(9)) for i in r.sample(range(60), 40)] for k in (0, 1000))
        a, b = a + [(a[0][0], 8 - a[0][1]), (None, 3)], b + [(b[0][0], 8 - b[0][1]), (b[1][0], None)]
        links = [(x, y, float(r.choice((1, 2, 2, 3)))) for x in range(10) for y in range(10) if r.random() < (0.2, 0.5, 0.9)[seed]]
        pairs = {}
        for x, y, m in sorted(links, reverse=True, key=lambda v: v[2]):
            pairs |= {(i, j): m for i, g in a if g == x and i is not None for j, h in b if h == y}
        sides = [spark.createDataFrame(v, "id long, g long") for v in (a, b)]
        got = greedy_in_groups(*sides, spark.createDataFrame(links, "a_g long, b_g long, metres double"))
        assert sorted(map(tuple, got.collect())) == greedy([(i, j, m) for (i, j), m in pairs.items()])


def test_greedy_in_groups_takes_large_groups_without_their_pairs(spark):
    """90,000 by 60,000 ids of one group are 5.4 billion pairs."""
    a, b = spark.range(90_000).selectExpr("id * 2 as id", "0L as g"), spark.range(60_000).selectExpr("id * 3 as id", "7L as g")
    got = greedy_in_groups(a, b, spark.createDataFrame([(0, 7, 0.0)], "a_g long, b_g long, metres double"))
    assert got.where("a_id / 2 = b_id / 3").count() == got.distinct().count() == 60_000


def test_layered_match_equals_brute_force(spark):
    r = random.Random(5)

    def store(i):
        area = r.choice((("P", "C"), ("P", "D"), ("Q", "C"), ("P", ""), (None, "C"), ("", None)))
        n = r.choice((1, 11, 2, 22, 3))
        return (i, *area, r.choice((f"P C Town{n}-{n}", f"P C Town{n}-{n}", f"P D Mall{n}", "x", "", None)), r.choice((None, 35.0, 35.0003, 35.0007, 36.0)), 139.0)

    def grams(s):
        return {s[i : i + 2] for i in range(len(s or "") - 1)}

    columns = "id int, prefecture string, city string, address string, lat double, lng double"
    for least in (0.6, 0.9):
        top, bottom = [store(i) for i in range(70)], [store(i) for i in range(60, 130)]
        want = [(i, i, "id") for i in range(60, 70)]
        a, b = top[:60], bottom[10:]
        for layer in ("address", "place"):
            pairs = []
            for x in a:
                for y in b:
                    g, h = grams(x[3]), grams(y[3])
                    if layer == "address" and g and h and all(not p or not q or p == q for p, q in zip(x[1:3], y[1:3], strict=True)) and len(g & h) / len(g | h) >= least:
                        pairs.append((x[0], y[0], 1 - len(g & h) / len(g | h)))
                    if layer == "place" and x[4] and y[4] and (m := 111_194.9266 * abs(x[4] - y[4])) <= 50:
                        pairs.append((x[0], y[0], round(m, 3)))
            found = greedy(pairs)
            assert found
            want += [(i, j, layer) for i, j, _ in found]
            a, b = [x for x in a if x[0] not in {i for i, _, _ in found}], [y for y in b if y[0] not in {j for _, j, _ in found}]
        got = matching.layered_match(spark.createDataFrame(top, columns), spark.createDataFrame(bottom, columns), least, 50.0)
        assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("lat", [0.0, 35.0, 45.5, 60.0, 89.9, -71.0])
def test_near_pairs_at_any_latitude(spark, lat):
    r = random.Random(int(lat))
    step = 0.02 / max(0.002, math.cos(math.radians(lat)))
    points = [(i, lat + r.uniform(-0.03, 0.03), ((179.99 if i % 2 else -179.99) + r.uniform(-step, step) + 180) % 360 - 180) for i in range(60)]
    df = spark.createDataFrame(points, "id int, lat double, lng double")
    rows = df.collect()
    want = sorted((a.id, b.id) for a in rows for b in rows if metres(a, b) <= 1000)
    assert len(want) > 60
    assert sorted((x.a_id, x.b_id) for x in matching.near_pairs(df, df, 1000.0).collect()) == want


def test_companies_at_stores_are_counted_once_for_a_street(spark):
    companies = spark.createDataFrame([(f"{i:013d}", "株式会社山田", "01", "東京都", "港区", f"芝浦{i % 3}-{i % 2}") for i in range(60)] + [("9" * 13, "株式会社山田", "01", "東京都", "港区", "高輪1-1"), ("8" * 13, "株式会社山田", "71", "東京都", "港区", "高輪1-2"), ("7" * 13, "株式会社山田", "01", "東京都", "港区", None)], "corporate_number string, name string, process string, prefecture string, city string, street string")
    places = [(i, ("東京都", "港区" if i % 5 else "", ("芝浦1", "高輪", "海岸", "", None)[i % 6 % 5])) for i in range(40)]
    out = registry.by_location(spark.createDataFrame(places, "place_id int, parts struct<pref string, city string, town string>"), companies)
    want = {"芝浦1": (20, "", "multi_match(20)"), "高輪": (1, "9" * 13, "single_match"), "海岸": (0, "", "no_match"), "": (62, "", "multi_match(62)"), None: (0, "", "no_match")}
    assert sorted(map(tuple, out.collect())) == sorted((i, *want[town]) for i, (_, city, town) in places if city)
    assert joined_rows(out) <= 40


def test_companies_at_stores_takes_every_store(spark, small):
    companies = [r for r in jp.registry(spark, small).collect() if r.process == "01"]
    want = []
    for r in jp.stores(spark, small).collect():
        town = r.town + (str(r.place_id % 9 + 1) if r.place_id % 2 == 0 else "")
        met = [c.corporate_number for c in companies if (c.prefecture, c.city) == (r.pref, r.city) and c.street.startswith(town)]
        want.append((r.place_id, len(met), met[0] if len(met) == 1 else "", "no_match" if not met else "single_match" if len(met) == 1 else f"multi_match({len(met)})"))
    assert len(want) == 63 and {n for p, n, _, _ in want if p % 3 == 0} >= {0, 1}
    assert sorted(map(tuple, catalog.QUERIES["companies_at_stores"](spark, small).collect())) == sorted(want)


def test_pages_meet_each_core_and_address_once(spark):
    cores, addresses = ("芝浦1", "芝浦", "芝浦12店", "高輪", ""), ("港区 1-2", "港区1-2-3", "", None)
    pages = [(i, cores[i % 5], addresses[i // 5 % 4]) for i in range(80)]
    shops = [(1000 + i, cores[i % 3], addresses[i // 3 % 4]) for i in range(24)] + [(1000, cores[0], addresses[0]), (2000, "高輪", "港区9")]
    out = stores.matched_pages(spark.createDataFrame(pages, "page_id int, core string, address string"), spark.createDataFrame(shops, "place_id int, core string, address string"))
    flat, want = lambda a: (a or "").replace(" ", ""), []
    for page, core, address in pages:
        hits = {(p, flat(a)) for p, c, a in shops if core and (core in c or c in core)}
        near = [p for p, a in hits if a and flat(address) and (a in flat(address) or flat(address) in a)]
        reason = "store_core_missing" if not core else "store_not_found" if not hits else "" if len(near) == 1 else "store_address_ambiguous" if near else "" if len(hits) == 1 else "store_name_ambiguous"
        want.append((page, None if reason else min(near or [p for p, _ in hits]), reason))
    assert {r for _, _, r in want} == {"", "store_core_missing", "store_address_ambiguous", "store_name_ambiguous"}
    assert sorted(out.collect()) == sorted(want)
    assert joined_rows(out) <= 80


def test_places_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(matching, "LOT", 7)
    columns = "id int, lat double, lng double"
    spots = [(35.0, 139.0), (35.001, 139.0), (35.001, 139.0005), (36.0, 139.0)]
    a, b = [(i, *spots[i % 4]) for i in range(80)], [(1000 + i, *spots[i % 2 + 1]) for i in range(40)]
    x, y = spark.createDataFrame(a, columns), spark.createDataFrame(b, columns)
    pairs = matching.near_lots(x, y, 150.0)
    b_rows = y.collect()
    want = sorted((p.id, q.id) for p in x.collect() for q in b_rows if metres(p, q) <= 150)
    assert sorted((r.a_id, r.b_id) for r in matching.pairs_of(pairs).collect()) == sorted((r.a_id, r.b_id) for r in matching.near_pairs(x, y, 150.0).collect()) == want
    assert pairs.count() < len(want) / 7
    near = matching.nearest(x, y, 150.0)
    best = sorted((p.id, min((metres(p, q), q.id) for q in b_rows)[1]) for p in x.collect() if any(metres(p, q) <= 150 for q in b_rows))
    assert sorted((r.a_id, r.b_id) for r in near.collect()) == best
    assert joined_rows(near) <= 80


def joined_rows(df):
    """The most rows that a join made in the last run of df, checkpoints aside."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            p = p.executedPlan()
        if "QueryStage" in p.nodeName():
            p = p.plan()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_best_among_scores_few_pairs(spark, monkeypatch):
    scored, plainly = [], matching.best_match
    monkeypatch.setattr(matching, "best_match", lambda pairs, *rest: scored.append(pairs.count()) or plainly(pairs, *rest))
    names = [f"operator{i * 37 % 1000:09d}" for i in range(300)]
    got = matching.best_among(spark.createDataFrame([(n,) for n in names], "k string"), "k", 0.5)
    assert sorted(map(tuple, got.select("a", "score", "b").collect())) == best(names, 0.5)
    assert sum(scored) < 20 * len(names)
