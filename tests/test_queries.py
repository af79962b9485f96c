"""Every domain query against its SQL, on the smallest tables."""

import duckdb
import pytest

from sitegraph.plans import catalog, decisions, entities, exports, more, sites  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return int(v)
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() >= 0
        return
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_has_rows_at_the_correctness_scale(name):
    """An empty result on both sides would prove nothing."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF.replace('0.001', '0.01')}/{t}.parquet'")
    assert c.sql(catalog.ORACLES[name]).limit(1).fetchall()
