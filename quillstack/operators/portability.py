"""Import of bundles: conflicts of all kinds, plans, counters, and deletes that span tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SKIP, OVERWRITE, KEEP_BOTH = "skip", "overwrite", "keep-both"
# The order in which conflicts are told.
KINDS = ("book", "article-revision", "article-content-divergence", "highlight-id", "note-id", "location")


def against(incoming: DataFrame, local: DataFrame, keys: list[str], compare: list[str] = []) -> DataFrame:  # noqa: B006
    """incoming with `present` and local's columns `compare` as local_<name>, by one key or several."""
    other = local.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"local_{c}") for c in compare), F.lit(True).alias("_p"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    joined = incoming.join(other, on, "left")
    return joined.withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p", *(f"_k{i}" for i in range(len(keys))))


def conflict_summary(parts: list[DataFrame], sample: int = 5) -> DataFrame:
    """(place, kind, n, sample) from rows (kind, ord, id): kinds that occur, in their fixed order, with the first ids.

    Each task counts its rows and keeps the first of each kind, so none sorts them all.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = Counter(), {}
        for batch in batches:
            found = pa.Table.from_batches([batch])
            for kind in pc.unique(batch.column("kind")).to_pylist():
                own = found.filter(pc.equal(found["kind"], kind)).select(["ord", "id"])
                counts[kind] += own.num_rows
                own = pa.concat_tables([best[kind], own]) if kind in best else own
                best[kind] = own.take(pc.select_k_unstable(own, sample, [("ord", "ascending"), ("id", "ascending")])).combine_chunks()
        if counts:
            own = [best[k].to_pylist() for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values())), pa.array(own, type=pa.list_(pa.struct([("ord", pa.int64()), ("id", pa.string())])))], names=["kind", "n", "few"])

    typed = rows.select("kind", F.col("ord").cast("long").alias("ord"), "id")
    partial = typed.mapInArrow(firsts, "kind string, n long, few array<struct<ord:long,id:string>>")
    whole = partial.groupBy("kind").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, sample).alias("few"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("long") - 1
    return whole.select("kind", "n", F.array_join(F.expr("few.id"), ",").alias("sample"), place.alias("place"))


def book_action(present: Column, same: Column, policy: str) -> Column:
    """keep-both behaves as skip: no book ids are minted."""
    return F.when(~present, "add").when(~same & F.lit(policy == OVERWRITE), "replace").otherwise("skip")


def id_action(present: Column, policy: str) -> Column:
    return F.when(~present, "add").otherwise({OVERWRITE: "replace", KEEP_BOTH: "mint"}.get(policy, "skip"))


def minted(id_: Column, action: Column, salt: str) -> Column:
    """The id under which a row is written: a new one where both are kept, the same on every run, else its own."""
    return F.when(action == "mint", F.substring(F.sha2(F.concat(F.lit(salt), id_.cast("string")), 256), 1, 32)).otherwise(id_.cast("string"))


def location_action(present: Column, saved: Column, local_saved: Column, policy: str) -> Column:
    """Strictly newer wins, and only where overwriting is chosen."""
    return F.when(~present, "add").when(F.lit(policy == OVERWRITE) & (saved > local_saved), "replace").otherwise("skip")


def counters(planned: DataFrame, entity: str = "entity", action: str = "action") -> DataFrame:
    """(entity, incoming, written, skipped)."""
    a = F.col(action)
    return planned.groupBy(entity).agg(F.count("*").alias("incoming"), F.count_if(a == "add").alias("added"), F.count_if(a != "skip").alias("written"), F.count_if(a == "skip").alias("skipped"))


def preview_sentence(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with changes put over it: the last change of a key wins, whichever rows were there before."""
    rows = stored.select(*stored.columns, F.lit(None).cast(changes.schema[order].dataType).alias("_o"), F.lit(0).alias("_c"))
    rows = rows.unionByName(changes.select(*stored.columns, F.col(order).alias("_o"), F.lit(1).alias("_c")))
    best = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*stored.columns), F.struct("_c", "_o")).alias("b"))
    return best.select("b.*")


def after_import(stored: DataFrame, planned: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """A table after an import: its rows, but for those that a planned row replaces, and the planned rows that are not skipped.

    planned has stored's columns under the keys that rows are written with, each key once.
    """
    written = planned.filter(F.col(action) != SKIP).select(*stored.columns)
    over = written.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    kept = stored.join(over, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti")
    return kept.unionByName(written)


def deletion_ids(*sources: DataFrame) -> DataFrame:
    """Union of id columns without repeats."""
    out = sources[0].toDF("id")
    for s in sources[1:]:
        out = out.union(s)
    return out.distinct()


def without(rows: DataFrame, ref: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias("_gone")), F.col(ref) == F.col("_gone"), "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, keys that occur more than once with their count)."""
    first = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("b")).select("b.*")
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return first, again


def referenced(fixtures: DataFrame, key: str, *refs: DataFrame) -> DataFrame:
    """Fixtures that any of the id columns names."""
    return fixtures.join(deletion_ids(*refs), F.col(key) == F.col("id"), "left_semi")
