"""Slices for rendering, outline headings, contents lists and front matter, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import blocks, slices
from ..operators.review import iso_time
from ..operators.shelf import normalized_href
from ..sources import table
from .queries import _BLOCKS, query

_STARTS = """, b AS (SELECT doc_id, idx, text, {size}::BIGINT AS n, coalesce(sum({size} + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks)"""


@query(_BLOCKS + _STARTS.format(size="length_grapheme(text)") + """, g AS (SELECT *, unnest(range(start // 150, (start + n) // 150 + 1)) AS k FROM b),
c AS (SELECT doc_id, idx, 0 AS cut FROM b UNION SELECT doc_id, idx, n // 2 FROM b UNION SELECT doc_id, idx, 150 * k + 20 - start FROM g WHERE 150 * k + 20 - start BETWEEN 1 AND n - 1 UNION SELECT doc_id, idx, 150 * k + 90 - start FROM g WHERE 150 * k + 90 - start BETWEEN 1 AND n - 1),
p AS (SELECT c.doc_id, c.idx, cut, coalesce(lead(cut) OVER (PARTITION BY c.doc_id, c.idx ORDER BY cut), n) AS until, start, n, text, start + cut AS place FROM c JOIN b ON c.doc_id = b.doc_id AND c.idx = b.idx)
SELECT doc_id, idx::INT AS idx, place::BIGINT AS start, ("until" - cut)::BIGINT AS len, CASE WHEN place % 150 BETWEEN 20 AND 89 THEN place // 150 END AS highlight, CASE WHEN cut < n // 2 THEN 'strong' ELSE '' END AS marks,
substring_grapheme(text, (cut + 1)::BIGINT, ("until" - cut)::BIGINT) AS text FROM p""")
def highlighted_runs(spark, d):
    """Lines whose first half is strong, cut at a highlight of 70 clusters in each 150 of the document."""
    docs = table(spark, d, "documents")
    lines = blocks.with_offsets(blocks.text_blocks(docs), length=fn.grapheme_count(F.col("text")))
    half = F.floor(F.col("len") / 2).cast("int")
    run = lambda text, marks: F.struct(F.array_join(text, "").alias("text"), F.lit(marks).alias("marks"))
    cut = blocks.let(fn.graphemes(F.col("text")), lambda g: F.array(run(F.slice(g, 1, half), "strong"), run(F.slice(g, half + 1, F.size(g)), "")))
    marked = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 150))).alias("id"))
    marked = marked.select("doc_id", "id", (F.col("id") * 150 + 20).alias("start"), (F.col("id") * 150 + 90).alias("end"))
    return slices.highlighted_runs(lines.select("doc_id", "idx", "start", cut.alias("runs")), marked, "doc_id").drop("slice")


@query(_BLOCKS + _STARTS.format(size="length(text)") + """, l AS (SELECT doc_id, idx, start, start + n AS until FROM b), r AS (SELECT doc_id, max(until) AS total FROM l GROUP BY doc_id),
p AS (SELECT doc_id, total, unnest(range(0, total // 400 + 1)) AS k FROM r)
SELECT l.doc_id, k AS range, idx::INT AS path, CASE WHEN idx = 0 OR total <= 400 THEN start ELSE greatest(start, 400 * k) END AS start, CASE WHEN idx = 0 OR total <= 400 THEN until ELSE least(until, 400 * k + 400) END AS end
FROM l JOIN p USING (doc_id) WHERE until > 400 * k AND start < 400 * k + 400""")
def block_slices(spark, d):
    """A document as one quote of its lines, the first a heading, shown in ranges of 400 characters."""
    docs = blocks.with_block_arrays(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "blocks").filter(F.size("blocks") > 0)
    end = F.element_at("blocks", -1)
    docs = docs.select("doc_id", "blocks", (end["start"] + end["len"]).alias("top_end"))
    leaves = docs.select("doc_id", "top_end", F.inline("blocks"))
    leaves = leaves.select("doc_id", F.col("idx").alias("path"), F.when(F.col("idx") == 0, "heading").otherwise("paragraph").alias("kind"), "start", (F.col("start") + F.col("len")).alias("end"), F.lit(0).alias("top_start"), "top_end")
    ranges = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top_end") / 400))).alias("range"))
    ranges = ranges.select("doc_id", "range", (F.col("range") * 400).alias("start"), (F.col("range") * 400 + 400).alias("end"))
    return slices.sliced_blocks(leaves, ranges, "doc_id")


@query()
def outline_headings(spark, d):
    """No SQL: what a target may take depends on the targets before it."""
    rows = table(spark, d, "lineitem")
    paragraphs = rows.select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("y"), F.lit(2.0).alias("delta"))
    y = F.when(F.col("l_linenumber") % 4 != 0, (F.col("l_partkey") % 60).cast("double"))
    return slices.outline_headings(paragraphs, rows.select("l_orderkey", F.col("l_linenumber").alias("ord"), y.alias("y"), (F.col("l_linenumber") % 3 + 1).alias("level")), "l_orderkey")


@query(r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(nav, '<a href'), 1) AS i FROM n)
SELECT page_id, (i - 1)::INT AS ord, label, ltrim(href, '/') AS href, 1::INT AS depth FROM e""")
def navigation_entries(spark, d):
    found = slices.contents_entries(table(spark, d, "pages"), "page_id", "html", ("ol", "ul"))
    return found.withColumn("href", normalized_href(F.col("href")))


@query(r"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'The "' || c_name || '"' WHEN 2 THEN 'it''s ' || c_name END AS title, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 3 THEN 'A. ' || c_mktsegment END AS author,
CASE WHEN c_custkey % 4 = 0 THEN '2024-03-0' || (1 + c_custkey % 9) || 'T00:00:00.000Z' END AS published, CASE WHEN c_custkey % 4 = 3 THEN 'title: ' || c_name || chr(10) ELSE '' END || 'Text of ' || c_name AS body FROM customer""")
def markdown_front_matter(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    title = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit('"The \\"'), name, F.lit('\\""'))).otherwise(F.concat(F.lit("'it''s "), name, F.lit("'  # quoted")))
    author = F.when(k % 5 == 0, "1984").otherwise(F.concat(F.lit("A. "), F.col("c_mktsegment"), F.lit(" # who")))
    date = F.when(k % 4 == 0, F.concat(F.lit("2024-03-0"), (1 + k % 9).cast("string"))).otherwise("soon")
    head = F.concat(F.lit("---\ntitle: "), title, F.lit("\nauthor: "), author, F.lit("\ndate: "), date, F.lit("\n---\n"))
    text = F.concat(F.when(k % 4 == 3, F.concat(F.lit("title: "), name, F.lit("\n"))).otherwise(head), F.lit("Text of "), name)
    rows = table(spark, d, "customer").select("c_custkey", slices.front_matter(text).alias("m"))
    return rows.select("c_custkey", "m.title", "m.author", iso_time(F.col("m.date")).alias("published"), "m.body")
