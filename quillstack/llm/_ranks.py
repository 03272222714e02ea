"""Ranks and running totals over groups of any size, from SQL functions only.

Rows are ordered inside a group by a hash; its top bits are a bucket. Bucket totals give each bucket its
start, a window inside the bucket does the rest, so no task gets a whole group and the result does not
depend on the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_start(df: DataFrame, group: list[str], order: Column, ties: list[str], weight: Column, name: str, bits: int) -> DataFrame:
    """Adds `name`: the sum of weight over the rows before this one in its group, by (order hash, ties).

    order is a 64-bit hash; weight a non-negative long. Bucket totals number at most groups * 2**bits;
    they are joined by equality, so Spark chooses how once it knows their size.
    """
    rows = df.withColumns({"_h": order, "_w": weight}).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    totals = rows.groupBy(*group, "_b").agg(F.sum("_w").alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    keys = [*group, "_b"]
    starts = totals.select(*(F.col(c).alias(f"_{c}_") for c in keys), F.coalesce(before, F.lit(0)).alias("_s"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in keys]
    joined = rows.join(starts, same).select(*rows.columns, "_s")
    inside = F.sum("_w").over(W.partitionBy(*group, "_b").orderBy(F.shiftleft("_h", bits), *ties).rowsBetween(W.unboundedPreceding, -1))
    return joined.withColumn(name, F.col("_s") + F.coalesce(inside, F.lit(0))).drop("_h", "_w", "_b", "_s")
