"""Bundle conflicts and merge plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("article-revision", "article-content-divergence", "highlight-id", "note-id", "location")


def versus(incoming: DataFrame, local: DataFrame, key: list[str], same: dict[str, str]) -> DataFrame:
    """incoming with local's columns beside it, named local_<column>, and `present`."""
    other = local.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(c).alias(n) for c, n in same.items()), F.lit(True).alias("present"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return incoming.join(other, on, "left").drop(*(f"_{k}" for k in key)).withColumn("present", F.coalesce("present", F.lit(False)))


def article_conflict(revision: Column, local_revision: Column, digest: Column, local_digest: Column, present: Column) -> Column:
    """The conflict kind of an article: revision first, then content of equal revisions; null if there is none."""
    return F.when(present & (revision != local_revision), KINDS[0]).when(present & (digest != local_digest), KINDS[1])


def article_action(kind: Column, present: Column, policy: str, revision: Column, local_revision: Column) -> Column:
    """add, replace or skip: a revision conflict is overwritten only by a higher revision."""
    replace = F.lit(policy == "overwrite") & ((kind == KINDS[1]) | ((kind == KINDS[0]) & (revision > local_revision)))
    return F.when(~present, "add").when(replace, "replace").otherwise("skip")


def newer_wins(saved: Column, local_saved: Column, present: Column) -> Column:
    return F.when(~present, "add").when(saved > local_saved, "replace").otherwise("skip")


def summary(conflicts: DataFrame, id_col: str, kind: str = "kind", sample: int = 5) -> DataFrame:
    """(kind, n, sample): kinds that occur, with the `sample` smallest ids joined by a comma.

    Ids are cut to the smallest few by a bounded heap a kind before they are gathered.
    """
    counted = conflicts.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    few = conflicts.filter(F.col(kind).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(kind).orderBy(id_col))).filter(F.col("_r") <= sample)
    ids = few.groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("sample"))
    return counted.join(ids, kind)
