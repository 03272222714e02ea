"""Lines, pages and chapters from positioned items; drift of measured heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDOW_LINES = 2


def line_bands(items: DataFrame, page: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """(page, band, y, n, items): items from top to bottom; one opens a band if it lies more than `tolerance` below the first of the band.

    The band's head decides and not the item before, so a page is one ordered fold over its items; a page is one unit.
    Ids of the items come along in reading order of the fold (y down, x up).
    """
    rows = items.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.col(y)).alias("down"), F.col(x).alias("x"), F.col("id").alias("id")))).alias("_items"))
    step = lambda a, it: F.when((F.size(a["heads"]) > 0) & (F.element_at(a["heads"], -1) + it["down"] <= tolerance), F.struct(a["heads"].alias("heads"), F.array_append(a["of"], F.size(a["heads"]) - 1).alias("of"))).otherwise(F.struct(F.array_append(a["heads"], -it["down"]).alias("heads"), F.array_append(a["of"], F.size(a["heads"])).alias("of")))
    start = F.struct(F.array().cast("array<double>").alias("heads"), F.array().cast("array<int>").alias("of"))
    rows = rows.withColumn("_f", F.aggregate("_items", start, step))
    each = rows.select(*page, F.posexplode("_items").alias("i", "it"), "_f").select(*page, F.get("_f.of", F.col("i")).alias("band"), F.col("it.id").alias("id"), "i", "_f.heads")
    return each.groupBy(*page, "band").agg(F.get(F.first("heads"), F.first("band")).alias("y"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda v: v["id"].cast("string")), ",").alias("items"))


def page_stats(items: DataFrame, page: list[str], text: str) -> DataFrame:
    """(page, items, chars): items that are not blank, and their characters that are no white space."""
    real = F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) != ""
    return items.groupBy(*page).agg(F.count_if(real).alias("items"), F.sum(F.length(F.regexp_replace(F.col(text), r"\s+", ""))).cast("long").alias("chars"))


def document_verdict(pages: DataFrame, document: str, columnar: Column, floor_items: int, floor_chars: int, empty_items: int, empty_chars: int, majority: float = 0.5) -> DataFrame:
    """(document, pages, text_bearing, near_empty, columnar, multi_column, scanned) from rows with items and chars a page."""
    bearing = (F.col("items") >= floor_items) & (F.col("chars") >= floor_chars)
    empty = (F.col("items") < empty_items) | (F.col("chars") < empty_chars)
    out = pages.groupBy(document).agg(F.count("*").alias("pages"), F.count_if(bearing).alias("text_bearing"), F.count_if(empty).alias("near_empty"), F.count_if(bearing & columnar).alias("columnar"))
    return out.withColumns({"multi_column": (F.col("text_bearing") > 0) & (F.col("columnar") > majority * F.col("text_bearing")), "scanned": (F.col("pages") > 0) & (F.col("near_empty") > majority * F.col("pages"))})


def paragraphs(lines: DataFrame, page: list[str], order: str, breaks: Column, text: str) -> DataFrame:
    """(page, paragraph, n, text): lines up to the next one that `breaks` (an expression over lag values) opens. As in SQL, lines of one place
    are of one paragraph, lines without a place come last, and a paragraph of null texts alone has none. Lines of one place are put by text."""
    own = W.partitionBy(*page).orderBy(F.asc_nulls_last(order))
    numbered = lines.withColumn("paragraph", F.sum(F.coalesce(breaks.cast("int"), F.lit(0))).over(own).cast("long"))
    placed = F.struct(F.col(order).isNull().alias("_none"), order, text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda v: v[text]), " ")
    return numbered.groupBy(*page, "paragraph").agg(F.count("*").alias("n"), F.when(F.count(text) > 0, joined).alias("text"))


def legal_split(total: Column, candidate: Column, lines: int = WIDOW_LINES) -> Column:
    """A split that leaves `lines` lines on either side; blocks too short for that keep the candidate."""
    return F.when(total < 2 * lines, candidate).otherwise(F.least(F.greatest(candidate, F.lit(lines)), total - lines))


def largest_legal_split(bottoms: Column, top: Column, limit: Column, lines: int = WIDOW_LINES) -> Column:
    """How many lines stay on the page: the most whose last one ends by limit; null if the block cannot be split."""
    n = F.size(bottoms)
    tries = F.transform(F.sequence(F.lit(lines), F.greatest(n - 1, F.lit(lines))), lambda k: legal_split(n, k, lines))
    fits = F.filter(tries, lambda k: (k > 0) & (k < n) & (F.get(bottoms, k - 1) - top <= limit))
    return F.when(n >= 2 * lines, F.array_max(fits))


def chapter_units(starts: DataFrame, book: str, at: str, label: str, end: str) -> DataFrame:
    """(book, start, until, label): from each entry to the next, the last to the end; what lies before the first is front matter."""
    own = W.partitionBy(book).orderBy(at)
    units = starts.select(book, F.col(at).alias("start"), F.coalesce(F.lead(at).over(own), F.col(end)).alias("until"), F.col(label).alias("label"))
    first = starts.groupBy(book).agg(F.min(at).alias("until")).filter("until > 0")
    front = first.select(book, F.lit(0).cast(starts.schema[at].dataType).alias("start"), "until", F.lit("Front matter").alias("label"))
    return units.unionByName(front)


def chapter_title(label: Column, doc_title: Column, heading: Column, fallback: Column) -> Column:
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(label), given(doc_title), F.nullif(heading, F.lit("")), fallback)


def drift_downgrades(samples: DataFrame, run: str, order: str, tolerance: float, size: int = 5) -> DataFrame:
    """(run, kind, drift): kinds whose predicted and true heights differ by more than tolerance in the first `size` eligible samples."""
    eligible = samples.filter(F.col("kind").isin("paragraph", "heading") & F.col("eligible"))
    few = eligible.withColumn("_r", F.row_number().over(W.partitionBy(run).orderBy(order))).filter(F.col("_r") <= size)
    drift = F.abs(F.col("actual") - F.col("predicted"))
    return few.filter(drift > tolerance).groupBy(run, "kind").agg(F.max(drift).alias("drift"))


def in_order_matches(labels: Column, blocks: Column) -> Column:
    """How many labels meet an equal block, each behind the one of the label before it; a label without one is passed over."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(s, label):
        rest = F.slice(blocks, s["at"] + 1, F.greatest(F.size(blocks) - s["at"], F.lit(0)))
        hit = F.array_position(rest, label).cast("int")
        return F.when(hit > 0, F.struct((s["at"] + hit).alias("at"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(labels, zero, step)["n"]


def agreement(labels: Column, blocks: Column) -> Column:
    most = F.greatest(F.size(labels), F.size(blocks))
    return F.when(most == 0, F.lit(1.0)).otherwise(in_order_matches(labels, blocks) / most)


def current_epochs(results: DataFrame, key: str, epoch: str, order: str) -> DataFrame:
    """Adds stale: whether a result of a higher epoch of its key came before it."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return results.withColumn("stale", F.coalesce(F.max(epoch).over(before) > F.col(epoch), F.lit(False)))


def ring(events: DataFrame, key: str, order: list[Column], size: int = 100) -> DataFrame:
    """The newest `size` rows of each key."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= size).drop("_r")
