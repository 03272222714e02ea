"""Every query with SQL gives the rows DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from quillstack import registry


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = _rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
