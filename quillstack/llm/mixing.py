"""Mixing sources to target weights, in SQL functions only (operator 5).

Each source's documents lie end to end in a pseudorandom order and are packed into blocks of BLOCK words. A target is so many
passes over the source's blocks and a part of one more, its quota of blocks. The output is shards of SHARD_SLOTS slots of one block
each. What a shard gets of each source is a multinomial draw under the condition that all shards together use up the
quotas: slots are dealt a pseudorandom arrangement of all quota blocks, so shards differ in their counts by chance and the mix
meets its targets to a word. The n-th block of a source goes through the source's own pseudorandom permutation of block
indices, one for each pass, and the words come by joining on (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._ranks import running_start
from ._tables import SPACES, shared_checkpoint, table

BLOCK, SHARD_SLOTS, CELLS, ROUNDS = 128, 4096, 4096, 16
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    blank = (F.element_at(parts, 1) == "").cast("int") + F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target: `share` of all sizes by weight, at most cap * size each.

    Weights repeat along the sources in code-point order, null last. The level at which weight * level,
    capped, adds up to the whole is found by going through sources by their cap per weight: the rows here
    are one a source.
    """
    position = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(position, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    order = W.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    whole = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    below = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (whole - below) / above)
    # The first source whose own cap lies above the level at its place sets the level for all after it.
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "weight", "level"))).over(W.partitionBy()).level
    target = F.when(found.isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * found))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at index: swap-or-not rounds, exact for every n."""

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, i), n) - x, n)
        return F.when(F.pmod(F.xxhash64(seed, i, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def draw_slots(spark: SparkSession, quotas: DataFrame, seed: int) -> DataFrame:
    """(shard, slot, sid, n): which source each slot of each shard was drawn for, and its how manieth block it takes, 0 <= n < quota."""
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).head()[0]
    cell = max(1, -(-total // CELLS))
    ranges = quotas.withColumn("low", F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)))
    ranges = ranges.withColumn("low", F.coalesce("low", F.lit(0))).filter("quota > 0")
    # A draw finds its source by an equality on a cell of the range, at most CELLS + sources rows.
    cells = ranges.select("sid", "low", "quota", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("low") + F.col("quota") - 1) / cell))).alias("cell"))
    size = F.lit(max(total, 1)).cast("long")
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod("id", F.lit(SHARD_SLOTS)).alias("slot"), permuted(F.col("id"), size, F.lit(seed).cast("long")).alias("draw"))
    found = slots.withColumn("cell", F.floor(F.col("draw") / cell)).join(cells, "cell").filter("draw >= low and draw < low + quota")
    return found.select("shard", "slot", "sid", (F.col("draw") - F.col("low")).alias("n"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7, bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: id, size (words), source_size, target, taken (words, repeats counted), shards (those that hold some of it, ascending).
    pieces: shard, slot, turn (pass over the source), id, order, start, size, lo, hi: the slot holds words [lo, hi) of the
    document that lies at `start` of its source. Texts without words are taken 0 times; a null source is a source of its
    own, last in order. Repeated rows count each for itself. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("order"))
    docs = shared_checkpoint(docs)
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    words = F.round("target").cast("long")
    targets = targets.withColumns({"sid": F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"), "words": words})
    size = F.greatest("source_size", F.lit(1).cast("long"))
    targets = targets.withColumns({
        "blocks": F.ceil(F.col("source_size") / block),
        "passes": F.floor(F.col("words") / size),
        "rest": F.col("words") - F.floor(F.col("words") / size) * F.col("source_size"),
    })
    targets = shared_checkpoint(targets.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)))

    drawn = draw_slots(spark, targets.select("sid", "quota"), seed).join(targets.select("sid", "blocks", "passes", "rest"), "sid")
    turn, place = F.floor(F.col("n") / F.col("blocks")), F.pmod("n", "blocks")
    # The last, shorter block keeps its place at the end of each pass, so a part of a pass has whole blocks first.
    full = F.col("blocks") - 1
    index = F.when(place >= full, place).otherwise(permuted(place, F.greatest(full, F.lit(1).cast("long")), F.xxhash64(F.lit(seed), "sid", turn)))
    length = F.when(turn < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - place * block))
    filled = drawn.select("shard", "slot", "sid", turn.alias("turn"), index.alias("index"), length.cast("long").alias("length"))

    named = docs.join(targets.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = shared_checkpoint(running_start(named, ["sid"], F.col("order"), ["id", "size"], F.col("size"), "start", bits))
    spread = placed.filter("size > 0").select("id", "order", "sid", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("index"))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("index") * block + F.col("length"))
    held = spread.join(filled, ["sid", "index"]).filter(hi > lo)
    pieces = shared_checkpoint(held.select("shard", "slot", "turn", "id", "order", "sid", "start", "size", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi")))
    sums = pieces.groupBy(F.col("sid").alias("x"), F.col("start").alias("y")).agg(F.sum(F.col("hi") - F.col("lo")).alias("took"), F.array_sort(F.collect_set("shard")).alias("shards"))
    out = placed.join(sums, (F.col("sid") == F.col("x")) & (F.col("start") == F.col("y")) & (F.col("size") > 0), "left")
    documents = out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    return documents, pieces.withColumnRenamed("id", id_col)


def mixed_texts(df: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """df's rows as the mix takes them: one row for each pass that takes words of a document, dealt by the shard of its first slot
    and sorted by shard and slot inside a partition.

    A pass that takes all words keeps the text as it is; else its words are joined by one space. Texts of which
    nothing is taken, and null texts, give no row. Rows equal in id and text give each their own rows, with the other
    columns of one of them.
    """
    one = F.struct("lo", "hi")
    plan = pieces.groupBy(F.col(id_col).alias("_id"), F.col("order").alias("_order"), "sid", "start", "turn").agg(F.min(F.struct("shard", "slot")).alias("_first"), F.max("size").alias("_all"), F.array_sort(F.collect_list(one)).alias("_runs"))
    plan = plan.drop("sid", "start", "turn")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    # One row for equal rows, combined before the shuffle; each start of theirs in the plan brings it back.
    rows = df.select(F.col(id_col).alias("_rid"), key.alias("_key"), F.struct(*df.columns).alias("_row")).groupBy("_rid", "_key").agg(F.first("_row").alias("_row"))
    rows = rows.join(plan, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_order")))
    words = F.filter(F.split(F.coalesce(F.col("_row")[text_col], F.lit("")), SPACES), lambda w: w != "")
    rows = rows.withColumn("_words", words)
    size = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    part = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice("_words", (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    text = F.when(size == F.col("_all"), F.col("_row")[text_col]).otherwise(part)
    out = rows.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns), F.col("_first.shard").alias("_shard"), F.col("_first.slot").alias("_slot"))
    return out.repartition("_shard").sortWithinPartitions("_shard", "_slot").select(*df.columns)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix_sources(table(spark, sf_dir, "documents"))
    return documents
