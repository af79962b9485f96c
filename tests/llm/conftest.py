import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long, repeated and clashing: each operator must take them."""
    long = " ".join(f"word{i}" for i in range(9000))
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "one two three four five six"), (None, None), (4, long), (5, long), (6, "12345 !!! ###"), (7, "short"), (8, " \n\t ")]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None if i == 7 else f"s{(i or 0) % 2}", -1, "x", 0.5, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cls string, score double, count string")
