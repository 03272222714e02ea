"""Stores laid out by key: bucketed by the first key and sorted by all, one table for each version of their schema.

A look-up of one first key, alone or with a range of the second, reads one bucket; stores of the same number of buckets are joined
where they lie, on all keys if spark.sql.requireAllClusterKeysForCoPartition is false. Rows of an older version are brought up to the newest when they are read, and hidden
by newer rows of their key; nothing is rewritten until `migrate` says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By version: what makes its rows those of the next one.
Upgrades = dict[int, Callable[[DataFrame], DataFrame]]


def save(df: DataFrame, name: str, keys: list[str], folder: str, version: int = 1, buckets: int = 16) -> None:
    """Writes a version of a store: a table `name`_v<version> below a folder that the cluster shares. One file a bucket: rows are dealt as
    they will lie."""
    dealt = df.repartition(buckets, keys[0])
    dealt.write.bucketBy(buckets, keys[0]).sortBy(*keys).option("path", f"{folder}/{name}_v{version}").mode("overwrite").saveAsTable(f"{name}_v{version}")


def versions(spark: SparkSession, name: str, newest: int) -> list[int]:
    return [v for v in range(1, newest + 1) if spark.catalog.tableExists(f"{name}_v{v}")]


def stored(spark: SparkSession, name: str, version: int) -> DataFrame:
    return spark.table(f"{name}_v{version}")


def load(spark: SparkSession, name: str, keys: list[str], newest: int, upgrades: Upgrades) -> DataFrame:
    """All rows in the newest schema. Of rows of one key in several versions the newest version's count."""
    parts = []
    there = versions(spark, name, newest)
    for v in there:
        rows = stored(spark, name, v)
        for later in (x for x in there if x > v):  # both lie in the same buckets, so nothing moves
            rows = rows.join(stored(spark, name, later).select(*keys), keys, "left_anti")
        for step in range(v, newest):
            rows = upgrades[step](rows)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def of_key(rows: DataFrame, keys: list[str], first, low=None, high=None) -> DataFrame:
    """Rows of one first key whose second key lies in [low, high); None leaves an end open."""
    hit = F.col(keys[0]) == F.lit(first)
    if low is not None:
        hit &= F.col(keys[1]) >= low
    if high is not None:
        hit &= F.col(keys[1]) < high
    return rows.filter(hit)


def migrate(spark: SparkSession, name: str, keys: list[str], folder: str, newest: int, upgrades: Upgrades, buckets: int = 16) -> None:
    """Writes all rows as the newest version and drops the older tables once it is there."""
    rows = load(spark, name, keys, newest, upgrades)
    save(rows, f"{name}_moving", keys, folder, newest, buckets)
    save(stored(spark, f"{name}_moving", newest), name, keys, folder, newest, buckets)
    for v in versions(spark, name, newest - 1):
        spark.sql(f"DROP TABLE {name}_v{v}")
    spark.sql(f"DROP TABLE {name}_moving_v{newest}")
