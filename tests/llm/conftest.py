import pytest

_LONG = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, _LONG + " tail one", "a"),
    (2, "start two " + _LONG, "a"),
    (3, _LONG + " tail one", None),
    (4, None, "b"),
    (5, "", "b"),
    (6, " \n\t ", "b"),
    (7, "x", None),
    (8, "héllo wörld 'tis they're  12 apples!!\n\nEnd ", "a"),
    (9, "héllo wörld 'tis they're  12 apples!!\n\nEnd ", "a"),
    (10, "a" * 300, "c"),
    (11, "b" + "a" * 120, "c"),
    (12, " ".join(f"w{i}" for i in range(40)) + " x " + " ".join(f"w{i}" for i in range(41, 80)) + " tail one", "a"),
    (12, "repeated id, other text", "a"),
    (12, "repeated id, other text", "a"),
    (None, "no id here", "c"),
    (-5, "negative " + _LONG[:200], "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, ties, and columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ROWS)], "doc_id long, text string, source string, ord int, bodies string")
    return df.selectExpr("*", "'y' as shard", "1 as kind", "2 as rank", "3 as n").repartition(3)


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
