"""Sharding by jump consistent hashing, in SQL functions only (operator 1).

A key's shard is found by jumping ahead through shard numbers with pseudorandom steps: no ring, no
table, and one more shard takes keys only into itself. The random numbers are a chain of xxhash64 values that
starts at the key, where the published algorithm has a linear congruence: its products wrap around
64 bits, which ANSI SQL arithmetic refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ranks import running_start
from ._tables import table

FIRST_JUMPS = 32


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard, 0 to n_shards - 1, of a key of any type; null is a key like others.

    A jump moves at least one shard ahead, so n_shards steps always suffice; about ln(n_shards) are taken
    on average. With many shards the first 32 steps nearly always do, and only rows that need more run on.
    """

    def jumps(start: Column, steps: int) -> Column:
        def jump(s: Column, _: Column) -> Column:
            ahead = F.floor((s.ahead + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(s.random, 33) + 1)))
            moved = F.struct(s.ahead.alias("shard"), ahead.alias("ahead"), F.xxhash64(s.random).alias("random"))
            return F.when(s.ahead < n_shards, moved).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)

    # The first jump always starts at shard 0, so its target is one step of the same rule.
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("ahead"), F.xxhash64(key).alias("random"))
    first = jumps(start, min(n_shards + 1, FIRST_JUMPS))
    if n_shards < FIRST_JUMPS:
        return first.shard.cast("int")
    return F.when(first.ahead >= n_shards, first.shard).otherwise(jumps(first, n_shards).shard).cast("int")


def assign_shards(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bits: int = 10) -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot (0, 1, ... in each shard), grown_shard.

    The id alone decides the shard; a null id is a key of its own. Slots follow a hash of id and text, so
    repeated rows get slots of their own and a rerun agrees. Null texts have size 1 and the checksum of no
    bytes. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = rows.select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), n_shards).alias("shard"),
        jump_shard(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
    )
    slotted = running_start(placed, ["shard"], F.xxhash64("doc_id", "size", "text_crc32"), ["doc_id", "size", "text_crc32"], F.lit(1).cast("long"), "slot", bits)
    return slotted.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", files: int = 1) -> None:
    """Writes all of df below path/shard=N, each shard in up to `files` tasks; a column named shard is replaced."""
    placed = df.withColumn("shard", jump_shard(F.col(id_col), n_shards)).withColumn("_part", F.pmod(F.xxhash64(F.lit("file"), *(F.col(c) for c in df.columns if df.schema[c].dataType.typeName() in ("long", "integer", "string"))), F.lit(files)))
    placed.repartition(n_shards * files, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
