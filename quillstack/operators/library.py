"""Library, reading position and review queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FINISHED = 0.98


def search(rows: DataFrame, fields: list[Column], query: str) -> DataFrame:
    """Rows whose fields, joined by one space, contain the query; a match may span fields, a blank query takes all."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    parts = []
    for f in fields:
        parts += [F.lit(" "), F.coalesce(f, F.lit(""))]
    return rows.filter(F.lower(F.concat(*parts[1:])).contains(wanted))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order; ties must be broken by it."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_value(rows: DataFrame, key: str, value: list[str], at: str, tie: str) -> DataFrame:
    """Per key, `value` where `at` is largest, the smallest `tie` among those: an aggregate, so one key may be any size."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(at, tie, *value), F.struct(at, -F.col(tie))).alias("b"))
    return best.select(key, "b.*")


def progress(chapters: DataFrame, book: str, position: Column, length: Column) -> DataFrame:
    """(book, total, finished, share): a chapter is finished from 98 % of its length on."""
    done = (length > 0) & (position >= FINISHED * length)
    out = chapters.groupBy(book).agg(F.count("*").alias("total"), F.count_if(done).alias("finished"))
    return out.withColumn("share", F.col("finished") / F.col("total"))


def first_wins(*sources: DataFrame, key: str) -> DataFrame:
    """Union in which an earlier source's row hides later ones of its key; duplicates inside a source must not occur."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(key), key, "left_anti").select(*out.columns))
    return out


def upsert(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    return changes.unionByName(stored.join(changes.select(*key), key, "left_anti").select(*changes.columns))


def cascade_delete(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose reference is among ids."""
    return {name: t.join(ids.select(F.col(key).alias("_gone")).distinct(), F.col(ref) == F.col("_gone"), "left_anti") for name, (t, ref) in tables.items()}


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def nearest_rank(rows: DataFrame, key: list[str], value: str, share: float, cells: int = 1024) -> DataFrame:
    """(key, n, p): the value at index min(n - 1, floor(share * n)) of each sorted group.

    Values are counted in `cells` equal steps between the group's least and greatest; sums over these find the
    cell with the wanted rank, and only that cell's values, equal ones counted first, are put in order. So no task orders a whole
    group, unless its values crowd into one cell. Null values are left out.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"), F.col(value).alias("_value"))
    ends = rows.groupBy(*(F.col(k).alias(f"_e{k}") for k in key)).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in key]
    width = F.col("_hi") - F.col("_lo")
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.join(ends, same("_e")).withColumn("_cell", cell)
    counted = placed.groupBy(*key, "_cell").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(W.partitionBy(*key).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))
    at = F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))
    cells_hit = counted.withColumn("_upto", upto).filter((F.col("_upto") > at) & (F.col("_upto") - F.col("c") <= at))
    cells_hit = cells_hit.select(*(F.col(k).alias(f"_h{k}") for k in key), F.col("_cell").alias("_hcell"), (at - F.col("_upto") + F.col("c")).alias("_at"))
    few = placed.join(cells_hit, [*same("_h"), F.col("_cell") == F.col("_hcell")]).groupBy(*key, "_value").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("_at").alias("_at"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*key).orderBy("_value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = few.withColumn("_before", before).filter((F.col("_before") <= F.col("_at")) & (F.col("_before") + F.col("c") > F.col("_at")))
    return hit.select(*key, "n", F.col("_value").alias("p"))
