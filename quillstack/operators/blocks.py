"""Documents as blocks with running text coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import furniture_key, normalized

MIN_BLOCKS, MIN_LENGTH, MAX_UNSUPPORTED = 3, 500, 0.4


GROUP = 64


def let(value: Column, f) -> Column:
    """f(value), with value computed once: a column used inside a lambda would be put in its place and computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_lines(text: Column) -> Column:
    """The non-blank lines of a text, normalized; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalized), lambda x: x != "")


def with_block_arrays(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds blocks, array<struct<idx, text, len, start>>: the non-blank lines of a text, normalized, with running offsets.

    Blocks are joined by one character. Everything happens inside the row, so that no shuffle is needed to number the lines; sums
    run over groups of GROUP lines first, so the work grows with the lines and not with their square. A null text has no blocks.
    """
    zero = F.lit(0).cast("long")
    total = lambda sizes, first, n: F.aggregate(F.slice(sizes, first, n), zero, lambda a, x: a + x)
    none = F.array().cast("array<bigint>")

    def bases(sizes: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int"))
        sums = F.when(F.size(sizes) > 0, F.transform(groups, lambda g: total(sizes, g * GROUP + 1, F.lit(GROUP)))).otherwise(none)
        begin = F.struct(none.alias("a"), zero.alias("s"))
        return F.aggregate(sums, begin, lambda a, x: F.struct(F.array_append(a["a"], a["s"]).alias("a"), (a["s"] + x).alias("s")))["a"]

    def numbered(lines: Column, sizes: Column, before: Column) -> Column:
        start = lambda i: F.get(before, F.floor(i / GROUP).cast("int")) + total(sizes, F.floor(i / GROUP).cast("int") * GROUP + 1, i % GROUP)
        return F.transform(lines, lambda x, i: F.struct(i.alias("idx"), x.alias("text"), F.length(x).cast("long").alias("len"), start(i).alias("start")))

    sizes = lambda lines: F.transform(lines, lambda x: F.length(x).cast("long") + 1)
    found = let(text_lines(F.col(text_col)), lambda lines: let(sizes(lines), lambda s: let(bases(s), lambda b: numbered(lines, s, b))))
    return docs.withColumn("blocks", found)


def offset_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, text, len, start) of each block."""
    # The outer form, as the inner one would compute all blocks once more to leave out rows without any.
    return with_block_arrays(docs.select(id_col, text_col), text_col).select(id_col, F.inline_outer("blocks")).filter("idx is not null")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, text): the non-blank lines of each document, normalized."""
    return docs.select(id_col, F.posexplode_outer(text_lines(F.col(text_col))).alias("idx", "text")).filter("idx is not null")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """article_stats of texts whose blocks are their lines, inside each row; texts without blocks give no row."""
    counted = lambda lines: F.struct(F.size(lines).cast("long").alias("n"), F.aggregate(lines, F.lit(-1).cast("long"), lambda n, x: n + F.length(x) + 1).alias("length"))
    rows = docs.select(id_col, F.explode_outer(F.array(let(text_lines(F.col(text_col)), counted))).alias("c")).filter("c.n > 0")
    stats = rows.select(id_col, F.col("c.n").alias("n_blocks"), F.col("c.length").alias("text_length"), F.lit(0).alias("n_unsupported"))
    return confidence(stats, id_col)


def edge_furniture(docs: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """(key, n): masked first and last lines that stand in `least` texts or more."""
    ends = let(text_lines(F.col(text_col)), lambda lines: F.when(F.size(lines) > 0, F.array(F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1))))
    keys = docs.select(F.explode_outer(F.array_distinct(F.transform(ends, furniture_key))).alias("key")).filter("key is not null")
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def with_offsets(blocks: DataFrame, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """Adds len and start: blocks of a document are joined by one character."""
    size = F.length("text") if length is None else length
    before = W.partitionBy(id_col).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    sized = blocks.withColumn("len", size.cast("long"))
    return sized.withColumn("start", F.coalesce(F.sum(F.col("len") + 1).over(before), F.lit(0)))


def article_stats(blocks: DataFrame, id_col: str = "doc_id", unsupported: Column | None = None) -> DataFrame:
    """(id, n_blocks, text_length, state, reason): extraction confidence from counts alone."""
    bad = F.lit(False) if unsupported is None else unsupported
    stats = blocks.groupBy(id_col).agg(F.count("*").alias("n_blocks"), (F.sum(F.length("text")) + F.count("*") - 1).cast("long").alias("text_length"), F.count_if(bad).alias("n_unsupported"))
    return confidence(stats, id_col)


def confidence(stats: DataFrame, id_col: str) -> DataFrame:
    """(id, n_blocks, text_length, state, reason) from counts."""
    chrome = F.col("n_unsupported") / F.col("n_blocks") > MAX_UNSUPPORTED
    sound = (F.col("n_blocks") >= MIN_BLOCKS) & (F.col("text_length") >= MIN_LENGTH)
    return stats.select(
        id_col, "n_blocks", "text_length",
        F.when(chrome, "low").when(sound, "confident").otherwise("low").alias("state"),
        F.when(chrome, "high-unsupported-ratio").when(sound, "").otherwise("extraction-thin").alias("reason"),
    )


def repeated_furniture(blocks: DataFrame, id_col: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, n): masked first and last lines that stand on `least` documents or more."""
    last = F.max("idx").over(W.partitionBy(id_col))
    edge = blocks.withColumn("last", last).filter("idx = 0 or idx = last").select(id_col, furniture_key(F.col("text")).alias("key")).distinct()
    return edge.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def weighted_mode(rows: DataFrame, group: str, value: str, weight: Column, order: str | None = None) -> DataFrame:
    """(group, value, weight): the value with most weight; on ties the one seen first by `order`, without it the smaller."""
    seen = F.col(value) if order is None else F.col(order)
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("weight"), F.min(seen).alias("_seen"))
    best = sums.groupBy(group).agg(F.max_by(F.struct(value, "weight"), F.struct("weight", -F.col("_seen"))).alias("b"))
    return best.select(group, f"b.{value}", "b.weight")


def with_previous(rows: DataFrame, group: str, position: str, width: int = 4096) -> DataFrame:
    """Adds `previous`: the position before this one in its group.

    Rows are ordered inside ranges of `width` positions; the highest position of each goes on to the next range, so
    a large group is dealt to many tasks.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(position) / width))
    own = F.lag(position).over(W.partitionBy(group, "_range").orderBy(position))
    tops = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.max(position).alias("_top"))
    before = tops.select("_g", "_r", F.lag("_top").over(W.partitionBy("_g").orderBy("_r")).alias("_before"))
    joined = ranged.withColumn("previous", own).join(before, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return joined.select(*rows.columns, F.coalesce("previous", "_before").alias("previous"))


def modal_gap(rows: DataFrame, group: str, position: str, gap: Column) -> DataFrame:
    """(group, gap, n): the most frequent step between neighbours, the larger on ties."""
    steps = rows.withColumn("gap", gap).filter("gap > 0").groupBy(group, "gap").agg(F.count("*").alias("n"))
    best = steps.groupBy(group).agg(F.max(F.struct("n", "gap")).alias("b"))
    return best.select(group, "b.gap", "b.n")


def votes(rows: DataFrame, group: str, low: Column, high: Column) -> DataFrame:
    """(group, bin, n): how many intervals cover each bin."""
    return rows.select(group, F.explode(F.sequence(low, high)).alias("bin")).groupBy(group, "bin").agg(F.count("*").alias("n"))


def empty_runs(counts: DataFrame, group: str, share: float) -> DataFrame:
    """(group, first_bin, n_bins): runs of neighbouring bins with at most `share` of the group's highest count."""
    top = F.max("n").over(W.partitionBy(group))
    low = counts.withColumn("top", top).filter(F.col("n") <= share * F.col("top"))
    island = F.col("bin") - F.row_number().over(W.partitionBy(group).orderBy("bin"))
    return low.withColumn("island", island).groupBy(group, "island").agg(F.min("bin").alias("first_bin"), F.count("*").alias("n_bins")).drop("island")


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """Adds to each point the last range of its key that starts at or before it: both sides in one ordered window."""
    tagged = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(ranges.schema[start].dataType).alias("_s"))
    marks = ranges.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(tagged.schema["_p"].dataType).alias("_p"), F.col(start).alias("_s"))
    order = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = tagged.unionByName(marks).withColumn("range_start", F.last("_s", ignorenulls=True).over(order))
    return both.filter("_kind = 1").select("_p.*", "range_start")
