"""Stores by key: plans that read one bucket and move nothing, and versions merged on read."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillstack.sources import keyed

KEYS = ["article", "revision"]
UPGRADES = {1: lambda df: df.withColumn("tag", F.lit("none")), 2: lambda df: df.withColumnRenamed("at", "saved").withColumn("saved", F.col("saved") * 10)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def store(spark, tmp_path):
    name = f"s{uuid.uuid4().hex[:12]}"
    first = [(i, r, i * 10 + r) for i in range(200) for r in range(3)]
    second = [(i, 1, -1, "new") for i in range(0, 200, 2)] + [(500, 0, 7, "only")]
    keyed.save(spark.createDataFrame(first, "article long, revision int, at long"), name, KEYS, str(tmp_path), 1, 8)
    keyed.save(spark.createDataFrame(second, "article long, revision int, at long, tag string"), name, KEYS, str(tmp_path), 2, 8)
    yield name, str(tmp_path)
    for v in (1, 2, 3):
        spark.sql(f"DROP TABLE IF EXISTS {name}_v{v}")


def _want():
    rows = {(i, r): (i * 10 + r, "none") for i in range(200) for r in range(3)}
    rows |= {(i, 1): (-1, "new") for i in range(0, 200, 2)} | {(500, 0): (7, "only")}
    return {k: (at * 10, tag) for k, (at, tag) in rows.items()}


def _found(df):
    rows = [(r.article, r.revision, r.saved, r.tag) for r in df.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {(a, r): (s, t) for a, r, s, t in rows}


def test_versions_are_merged_on_read(spark, store):
    name, folder = store
    assert _found(keyed.load(spark, name, KEYS, 3, UPGRADES)) == _want()
    keyed.migrate(spark, name, KEYS, folder, 3, UPGRADES, 8)
    assert keyed.versions(spark, name, 3) == [3]
    assert _found(keyed.load(spark, name, KEYS, 3, UPGRADES)) == _want()


@pytest.fixture
def shown(spark):
    """Bucket numbers are told in plans only where the planner does not drop the layout for want of a use beyond the pruning."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_one_bucket_is_read(spark, store, shown):
    name, _ = store
    rows = keyed.stored(spark, name, 1)
    one = keyed.of_key(rows, KEYS, 17, 1, 3)
    assert sorted(tuple(r) for r in one.collect()) == [(17, 1, 171), (17, 2, 172)]
    assert "SelectedBucketsCount: 1 out of 8" in _plan(one)
    all_versions = keyed.of_key(keyed.load(spark, name, KEYS, 3, UPGRADES), KEYS, 16, 1)
    assert _found(all_versions) == {k: v for k, v in _want().items() if k[0] == 16 and k[1] >= 1}
    plan = _plan(all_versions)
    assert plan.count("SelectedBucketsCount: 1 out of 8") == plan.count("FileScan") > 0
    assert keyed.of_key(rows, KEYS, 9999).count() == 0


def test_stores_are_joined_where_they_lie(spark, store):
    name, _ = store
    a, b = keyed.stored(spark, name, 1), keyed.stored(spark, name, 2).select("article", "revision", "tag")
    settings = {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.requireAllClusterKeysForCoPartition": False}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = a.join(b, KEYS)
        assert joined.count() == 100 and "Exchange" not in _plan(joined)
        assert "Exchange" not in _plan(keyed.load(spark, name, KEYS, 3, UPGRADES))
        grouped = a.groupBy("article").agg(F.max("revision"))
        assert "Exchange" not in _plan(grouped) and grouped.count() == 200
    finally:
        for key in settings:
            spark.conf.unset(key)
