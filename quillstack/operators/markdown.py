"""Markdown documents as blocks, by windows over lines, and the Markdown report of highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import escape_markdown_line

FENCE = r"^ {0,3}(```|~~~)"
HEADING = r"^ {0,3}#{1,6}([ \t]|$)"
RULE = r"^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$"
QUOTE = r"^ {0,3}>"
ITEM = r"^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \t]+"
FIGURE = r"^ {0,3}!\[([^\]]*)\]\(([^)]*)\)[ \t]*$"


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, kind, level, text): paragraphs, headings, quotes, lists, code and figures in order.

    A line of text right below a quote or an item belongs to it. Items stay one list over blank lines. Rules
    and fences give no text; code keeps its lines as they are. A null or blank document has no blocks.
    """
    own = W.partitionBy(id_col).orderBy("line")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n")).alias("line", "raw"))
    raw = F.col("raw")
    lines = lines.withColumn("fence", raw.rlike(FENCE))
    lines = lines.withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    kind = (
        F.when(F.col("inside") | F.col("fence"), "code")
        .when(F.trim(raw) == "", "blank")
        .when(raw.rlike(HEADING), "heading")
        .when(raw.rlike(RULE), "rule")
        .when(raw.rlike(QUOTE), "quote")
        .when(raw.rlike(ITEM), "list")
        .when(raw.rlike(FIGURE), "figure")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("k", kind)
    above = F.last(F.when(F.col("k") != "paragraph", F.col("k")), ignorenulls=True).over(before)
    lines = lines.withColumn("above", above)
    lines = lines.withColumn("kind", F.when((F.col("k") == "paragraph") & F.col("above").isin("quote", "list"), F.col("above")).otherwise(F.col("k")))
    lines = lines.withColumn("previous", F.lag("kind").over(own))
    lines = lines.filter("kind <> 'blank'").withColumn("solid", F.lag("kind").over(own))
    alone = F.col("kind").isin("heading", "figure", "rule") | (F.col("fence") & ~F.col("inside"))
    gap = (F.col("previous") == "blank") & ~F.col("kind").isin("list", "code")
    start = F.coalesce(alone | (F.col("solid") != F.col("kind")) | gap, F.lit(True))
    lines = lines.withColumn("b", F.sum(start.cast("int")).over(own))
    text = (
        F.when(F.col("kind") == "heading", F.regexp_replace(F.regexp_replace(raw, r"^ {0,3}#{1,6}[ \t]*", ""), r"([ \t]+#+)?[ \t]*$", ""))
        .when(F.col("kind") == "quote", F.trim(F.regexp_replace(raw, r"^ {0,3}> ?", "")))
        .when(F.col("kind") == "list", F.trim(F.regexp_replace(raw, ITEM, "")))
        .when(F.col("kind") == "figure", F.regexp_extract(raw, FIGURE, 1))
        .when(F.col("kind") == "code", raw)
        .otherwise(F.trim(raw))
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(raw, "^ *(#+)", 1)))
    kept = lines.withColumns({"t": text, "level": level}).filter("kind <> 'rule' and not (kind = 'code' and fence)")
    blocks = kept.groupBy(id_col, "b", "kind").agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("line", "t"))).alias("ls"))
    glue = F.when(F.col("kind").isin("paragraph", "quote"), " ").otherwise("\n")
    blocks = blocks.select(id_col, "b", "kind", "level", F.expr("ls.t").alias("ts"), glue.alias("glue"))
    joined = F.when(F.col("glue") == " ", F.array_join("ts", " ")).otherwise(F.array_join("ts", "\n"))
    idx = (F.row_number().over(W.partitionBy(id_col).orderBy("b")) - 1).cast("long")
    return blocks.select(id_col, idx.alias("idx"), "kind", "level", joined.alias("text"))


def highlights_report(entries: DataFrame, section: str, at: str, quote: str, note: str) -> DataFrame:
    """(section, n, report): the quotes of a section as Markdown, newest first, each with its note if it has one.

    A section is one article, whose highlights fit one row. Null notes give no note line.
    """
    lines = F.transform(F.split(F.coalesce(F.col(quote), F.lit("")), "\n"), lambda x: F.concat(F.lit("> "), escape_markdown_line(x)))
    body = F.concat(F.array_join(lines, "\n"), F.coalesce(F.concat(F.lit("\n\n"), F.col(note)), F.lit("")))
    rows = entries.select(section, F.struct((-F.col(at).cast("long")).alias("o"), body.alias("body")).alias("e"))
    grouped = rows.groupBy(section).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("e")).alias("es"))
    return grouped.select(section, "n", F.array_join(F.expr("es.body"), "\n\n").alias("report"))
