"""Books, their spines and tables of contents, review filters, and refusals of requests and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import spread


def book_search(books: DataFrame, chapters: DataFrame, book: str, ref: str, fields: list[Column], title: str, order: str, query: str) -> DataFrame:
    """Books whose fields and chapter titles, joined by one space in order, contain the query; a blank query takes all.

    A match may span titles, so the titles of one book come together; a book is one unit.
    """
    wanted = query.strip().lower()
    if not wanted:
        return books
    titles = chapters.groupBy(F.col(ref).alias("_ref")).agg(F.array_sort(F.collect_list(F.struct(order, title))).alias("_t"))
    parts = []
    for f in fields:
        parts += [F.coalesce(f, F.lit("")), F.lit(" ")]
    hay = F.concat(*parts, F.coalesce(F.array_join(F.col(f"_t.{title}"), " "), F.lit("")))
    return books.join(titles, F.col(book) == F.col("_ref"), "left").filter(F.lower(hay).contains(wanted)).select(*books.columns)


def only_one(*inputs: Column) -> Column:
    """Whether exactly one of the inputs is given."""
    return sum((i.isNotNull().cast("int") for i in inputs), F.lit(0)) == 1


def size_refusal(size: Column, limit: int) -> Column:
    return F.when(size > limit, "too-large").when(size == 0, "empty").otherwise("")


def precedence(*sources: DataFrame, key: str) -> DataFrame:
    """One row a key, from the first source that has it, with its `tier` (0 is the first); no source need be unique."""
    tiers = [s.withColumn("tier", F.lit(i)) for i, s in enumerate(sources)]
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    values = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct("tier", *[c for c in values if c != "tier"])).alias("b"))
    return best.select(key, "b.*")


def disjoint(new: DataFrame, existing: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The new ranges [start, end) that overlap no existing range of their key.

    Both sides stand in one ordered window a key: a range is free if the farthest end before it does not
    pass its start and no existing range starts inside it.
    """
    cols = [key, start, end]
    rows = new.select(*cols, F.lit(1).alias("_new"), F.struct(*new.columns).alias("_row")).unionByName(existing.filter(F.col(start) < F.col(end)).select(*cols, F.lit(0).alias("_new")).withColumn("_row", F.lit(None).cast(new.select(F.struct(*new.columns).alias("r")).schema["r"].dataType)))
    # At one start, existing ranges come first on the way down and last on the way up.
    down = W.partitionBy(key).orderBy(F.col(start), F.col("_new")).rowsBetween(W.unboundedPreceding, -1)
    up = W.partitionBy(key).orderBy(F.col(start).desc(), F.col("_new")).rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumns({"_reach": F.max(F.when(F.col("_new") == 0, F.col(end))).over(down), "_next": F.min(F.when(F.col("_new") == 0, F.col(start))).over(up)})
    free = (F.coalesce(F.col("_reach") <= F.col(start), F.lit(True)) & F.coalesce(F.col("_next") >= F.col(end), F.lit(True))) | (F.col(start) >= F.col(end))
    return marked.filter((F.col("_new") == 1) & free).select("_row.*")


def normalized_href(href: Column, base: Column | None = None) -> Column:
    """Without fragment, percent-decoded where that is possible, `.` and `..` resolved from the folder `base`; never above the root."""
    bare = F.regexp_replace(href, "#.*$", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    parts = F.filter(F.split(decoded, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    start = none if base is None else F.when(F.coalesce(base, F.lit("")) == "", none).otherwise(F.split(base, "/"))
    stack = F.aggregate(parts, start, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.array_join(stack, "/")


def toc_targets(toc: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(book, ord, label, pos): entries (book, ord, label, href) at the first spine position of their file.

    manifest has book, item, href; spine book, item, pos; toc and manifest may have `base`, the folder of the file that names the href. Entries without a file are left out; of entries
    at one position the first stays.
    """
    first = spine.groupBy("book", "item").agg(F.min("pos").alias("pos"))
    file = lambda rows: normalized_href(F.col("href"), F.col("base") if "base" in rows.columns else None)
    files = manifest.withColumn("file", file(manifest)).groupBy("book", "file").agg(F.min("item").alias("item"))
    hit = toc.withColumn("file", file(toc)).join(files, ["book", "file"]).join(first, ["book", "item"])
    best = hit.groupBy("book", "pos").agg(F.min(F.struct("ord", "label")).alias("b"))
    return best.select("book", "b.ord", "b.label", "pos")


def rewritten_notes(notes: DataFrame, rewrite: DataFrame, ref: str) -> DataFrame:
    """Notes whose reference follows the rewrite table (old, new); others keep theirs."""
    joined = notes.join(rewrite, F.col(ref) == F.col("old"), "left")
    return joined.withColumn(ref, F.coalesce("new", ref)).select(*notes.columns)


def bundle_refusal(is_zip: Column, names: Column, safe: Column, bundle: Column, version: Column, newest: int = 2) -> Column:
    """The first reason for refusing a bundle, empty if there is none."""
    return (
        F.when(~F.coalesce(is_zip, F.lit(False)), "not-a-zip")
        .when(~F.coalesce(safe, F.lit(False)), "unsafe-entry")
        .when(~F.coalesce(F.array_contains(names, "bundle.json") & F.array_contains(names, "manifest.json"), F.lit(False)), "missing-entry")
        .when(F.try_parse_json(bundle).isNull(), "invalid-json")
        .when(F.coalesce(version > newest, F.lit(False)), "newer-schema-version")
        .otherwise("")
    )


def line_runs(items: DataFrame, line: list[str], x: str, width: str, gap: float) -> DataFrame:
    """(line, run, x0, x1, n): items of a line whose distance to all before them is at most `gap` form a run.

    A task sorts its lines and holds its runs, so lines are dealt to as many tasks as there may be.
    """
    own = W.partitionBy(*line).orderBy(x, width)
    reach = F.max(F.col(x) + F.col(width)).over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = spread(items, *line).withColumn("_b", F.coalesce((F.col(x) - reach > gap).cast("int"), F.lit(0)))
    numbered = marked.withColumn("run", F.sum("_b").over(own).cast("long"))
    return numbered.groupBy(*line, "run").agg(F.min(x).alias("x0"), F.max(F.col(x) + F.col(width)).alias("x1"), F.count("*").alias("n"))


def chapters_of(books: DataFrame, chapters: DataFrame, book: str, declared: str, ref: str, chapter: str) -> DataFrame:
    """(book, chapter columns, place, declared): a book's chapters in the order it declares, then those that only name the book.

    Declared chapters without a row are left out and keep their place; undeclared ones follow by their id.
    """
    listed = books.select(book, F.size(declared).cast("long").alias("_size"), F.posexplode(declared).alias("_pos", "_id"))
    own = listed.join(chapters, (F.col(book) == F.col(ref)) & (F.col("_id") == F.col(chapter)))
    values = [c for c in chapters.columns if c != ref]
    first = own.select(book, *values, F.col("_pos").cast("long").alias("place"), F.lit(True).alias("declared"))
    mine = chapters.join(books.select(book, F.size(declared).cast("long").alias("_size")), F.col(ref) == F.col(book))
    stray = mine.join(listed.select(F.col(book).alias("_b"), F.col("_id")), (F.col(book) == F.col("_b")) & (F.col(chapter) == F.col("_id")), "left_anti")
    after = F.row_number().over(W.partitionBy(book).orderBy(chapter, *(c for c in values if c != chapter))).cast("long") - 1
    return first.unionByName(stray.select(book, *values, (F.col("_size") + after).alias("place"), F.lit(False).alias("declared")))
