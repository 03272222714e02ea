"""Queries over source formats, shelves and bundles, with their SQL. Stand-ins as in `queries`: suppliers are chapters of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown, page_blocks, shelf
from ..sources import table
from .queries import query


@query(r"""
WITH raw AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS raw, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS line FROM documents),
f AS (SELECT *, regexp_matches(raw, '^ {0,3}(```|~~~)') AS fence FROM raw),
i AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
k AS (SELECT *, CASE WHEN inside OR fence THEN 'code' WHEN trim(raw) = '' THEN 'blank' WHEN regexp_matches(raw, '^ {0,3}#{1,6}([ \t]|$)') THEN 'heading'
WHEN regexp_matches(raw, '^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$') THEN 'rule' WHEN regexp_matches(raw, '^ {0,3}>') THEN 'quote'
WHEN regexp_matches(raw, '^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \t]+') THEN 'list' WHEN regexp_matches(raw, '^ {0,3}!\[([^\]]*)\]\(([^)]*)\)[ \t]*$') THEN 'figure' ELSE 'paragraph' END AS k FROM i),
a AS (SELECT *, last_value(CASE WHEN k <> 'paragraph' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM k),
r AS (SELECT *, CASE WHEN k = 'paragraph' AND above IN ('quote', 'list') THEN above ELSE k END AS kind FROM a),
p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS previous FROM r),
s AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS solid FROM p WHERE kind <> 'blank'),
b AS (SELECT *, sum(coalesce(kind IN ('heading', 'figure', 'rule') OR (fence AND NOT inside) OR solid <> kind OR (previous = 'blank' AND kind NOT IN ('list', 'code')), true)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM s),
t AS (SELECT doc_id, b, kind, max(CASE WHEN kind = 'heading' THEN length(regexp_extract(raw, '^ *(#+)', 1)) END) AS level, count(*) AS n_lines FROM b WHERE kind <> 'rule' AND NOT (kind = 'code' AND fence) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS idx, kind, level FROM t""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.markdown_blocks(table(spark, d, "documents")).select("doc_id", "idx", "kind", "level")


@query()
def page_block_rows(spark, d):
    return page_blocks.page_blocks(page_blocks.page_nodes(table(spark, d, "pages")))


@query()
def page_inline_runs(spark, d):
    return page_blocks.inline_runs(page_blocks.page_nodes(table(spark, d, "pages")))


_ESCAPED = r"""list_transform(string_split(text, chr(10)), lambda x: '> ' || CASE WHEN regexp_matches(x, '^[0-9]+\.') THEN regexp_replace(x, '^([0-9]+)\.', '\1\\.')
ELSE regexp_replace(regexp_extract(x, '^[-+*>#]+'), '(.)', '\\\1', 'g') || substr(x, length(regexp_extract(x, '^[-+*>#]+')) + 1) END)"""


def _reported(marks: str) -> str:
    return f"""WITH t AS (SELECT conv_id, turn, role, {marks} AS text FROM conversations)
SELECT conv_id, count(*) AS n, string_agg(array_to_string({_ESCAPED}, chr(10)) || chr(10) || chr(10) || role, chr(10) || chr(10) ORDER BY turn DESC) AS report FROM t GROUP BY conv_id"""


@query(_reported("text"))
def highlights_report(spark, d):
    return markdown.highlights_report(table(spark, d, "conversations"), "conv_id", "turn", "text", "role")


@query(_reported("CASE turn % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN turn || '. ' || text WHEN 2 THEN 'x' || chr(10) || '>*- ' || text ELSE text END"))
def escaped_report(spark, d):
    k, text = F.col("turn") % 4, F.col("text")
    marked = F.when(k == 0, F.concat(F.lit("## "), text)).when(k == 1, F.concat(F.col("turn").cast("string"), F.lit(". "), text)).when(k == 2, F.concat(F.lit("x\n>*- "), text)).otherwise(text)
    return markdown.highlights_report(table(spark, d, "conversations").withColumn("text", marked), "conv_id", "turn", "text", "role")


@query("""WITH t AS (SELECT s_nationkey, string_agg(s_name, ' ' ORDER BY s_suppkey, s_name) AS titles FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey, n_name FROM nation LEFT JOIN t ON n_nationkey = s_nationkey WHERE contains(lower(n_name || ' ' || coalesce(titles, '')), '1 supplier')""")
def book_search(spark, d):
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier")
    return shelf.book_search(nations, suppliers, "n_nationkey", "s_nationkey", [F.col("n_name")], "s_name", "s_suppkey", "1 Supplier ").select("n_nationkey", "n_name")


@query("""SELECT doc_id, (coalesce(lang = 'en', false) AND text IS NOT NULL)::INT + (coalesce(source = 'src1', false) AND text IS NOT NULL)::INT + (doc_id % 3 = 0 AND text IS NOT NULL)::INT = 1 AS valid FROM documents""")
def request_shape(spark, d):
    given = [F.when(c, F.col("text")) for c in (F.col("lang") == "en", F.col("source") == "src1", F.col("doc_id") % 3 == 0)]
    return table(spark, d, "documents").select("doc_id", shelf.only_one(*given).alias("valid"))


@query("SELECT page_id, CASE WHEN strlen(html) > 5000 THEN 'too-large' WHEN strlen(html) = 0 THEN 'empty' ELSE '' END AS refusal FROM pages")
def input_limits(spark, d):
    return table(spark, d, "pages").select("page_id", shelf.size_refusal(F.octet_length("html"), 5000).alias("refusal"))


@query("""SELECT id, min(tier)::INT AS tier FROM (SELECT vec_id * 3 AS id, 0 AS tier FROM embeddings UNION ALL SELECT doc_id * 2, 1 FROM documents
UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY id""")
def article_lookup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    bundle = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    return shelf.precedence(bundle, docs.select((F.col("id") * 2).alias("id")), docs, key="id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT % 15 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, s::BIGINT AS s, e::BIGINT AS e FROM r n WHERE l_linenumber % 2 = 0 AND NOT EXISTS
(SELECT 1 FROM r o WHERE o.l_linenumber % 2 = 1 AND o.l_orderkey = n.l_orderkey AND greatest(o.s, n.s) < least(o.e, n.e))""")
def disjoint_highlights(spark, d):
    start = F.col("l_linenumber").cast("long") * 10
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", start.alias("s"), (start + F.col("l_quantity").cast("long") % 15).alias("e"))
    return shelf.disjoint(rows.filter("l_linenumber % 2 = 0"), rows.filter("l_linenumber % 2 = 1"), "l_orderkey", "s", "e")


@query("""SELECT o_orderkey, CASE WHEN c_nationkey = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def note_rewrites(spark, d):
    rewrite = table(spark, d, "customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return shelf.rewritten_notes(table(spark, d, "orders").select("o_orderkey", "o_custkey"), rewrite, "o_custkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not-a-zip' WHEN doc_id % 5 = 0 THEN 'unsafe-entry' WHEN doc_id % 3 = 0 THEN 'missing-entry' WHEN doc_id % 4 = 0 THEN 'invalid-json'
WHEN doc_id % 2 = 0 THEN 'newer-schema-version' ELSE '' END AS refusal FROM documents""")
def bundle_refusals(spark, d):
    i = F.col("doc_id")
    names = F.when(i % 3 == 0, F.array(F.lit("bundle.json"))).otherwise(F.array(F.lit("bundle.json"), F.lit("manifest.json")))
    bundle = F.when(i % 4 == 0, "{bad").otherwise('{"articles": []}')
    version = F.when(i % 2 == 0, 3).otherwise(2)
    return table(spark, d, "documents").select("doc_id", shelf.bundle_refusal(i % 7 != 0, names, i % 5 != 0, bundle, version).alias("refusal"))


@query("""WITH i AS (SELECT l_suppkey, floor(l_extendedprice)::BIGINT AS x, l_quantity::BIGINT AS w FROM lineitem),
m AS (SELECT *, max(x + w) OVER (PARTITION BY l_suppkey ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(coalesce((x - reach > 40)::INT, 0)) OVER (PARTITION BY l_suppkey ORDER BY x, w) AS run FROM m)
SELECT l_suppkey, run::BIGINT AS run, min(x) AS x0, max(x + w) AS x1, count(*) AS n FROM n GROUP BY ALL""")
def line_runs(spark, d):
    x = F.floor("l_extendedprice").cast("long")
    items = table(spark, d, "lineitem").select("l_suppkey", x.alias("x"), F.col("l_quantity").cast("long").alias("w"))
    return shelf.line_runs(items, ["l_suppkey"], "x", "w", 40)


def _customer_pages(spark: SparkSession, d: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    parts = (
        F.lit("<article><blockquote>"), name, F.lit("</blockquote><blockquote><p>"), segment, F.lit('</p></blockquote><ol start="'), (F.col("c_custkey") % 9 + 1).cast("string"),
        F.lit("\"><li>bare</li><li><p>"), name, F.lit("</p><ul><li><p>"), segment, F.lit('</p></li></ul></li></ol><div><sup class="reference">['), F.col("c_nationkey").cast("string"),
        F.lit(']</sup><sup class="footnote">7</sup></div></article><section class="footnotes"><ol><li>'), name, F.lit("</li><li> </li><li><b>"), segment, F.lit("</b> note</li></ol></section>"),
    )
    return table(spark, d, "customer").select("c_custkey", F.concat(*parts).alias("html"))


@query("""SELECT c_custkey, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS idx, unnest(['', 'blockquote', 'numbered-list ' || (c_custkey % 9 + 1) || '/item', 'numbered-list ' || (c_custkey % 9 + 1) || '/item/bulleted-list/item', '', '']) AS boxes,
unnest(['paragraph', 'paragraph', 'paragraph', 'paragraph', 'footnote-reference', 'footnote-reference']) AS kind, unnest([c_name, c_mktsegment, c_name, c_mktsegment, '[' || c_nationkey || ']', '7']) AS text,
unnest([NULL, NULL, NULL, NULL, 'fn-1', 'fn-7']) AS footnote_id FROM customer""")
def page_tree(spark, d):
    """Pages made of each customer's name and segment, as a tree of quotes, lists and footnote marks."""
    rows = page_blocks.page_block_tree(page_blocks.page_nodes(_customer_pages(spark, d), "c_custkey"), "c_custkey")
    named = F.transform("boxes", lambda b: F.concat(b["kind"], F.coalesce(F.concat(F.lit(" "), b["start"].cast("string")), F.lit(""))))
    return rows.select("c_custkey", "idx", F.array_join(named, "/").alias("boxes"), "kind", "text", "footnote_id")


@query("""SELECT c_custkey, 'fn-1' AS footnote_id, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'fn-3', c_mktsegment || ' note' FROM customer""")
def footnote_rows(spark, d):
    return page_blocks.footnote_bodies(page_blocks.page_nodes(_customer_pages(spark, d), "c_custkey"), "c_custkey")
