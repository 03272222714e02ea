"""Review, library, chapter and layout queries with their SQL.

Stand-ins: conversation turns are highlights of articles (documents), customers' orders are books of chapters, lineitems are
chapters, positioned items or measured blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import blocks, layout, library, review, shelf
from ..sources import table
from .queries import query

_ENTRIES = """WITH e AS (SELECT c.conv_id, c.turn, d.doc_id IS NOT NULL AS present, CASE WHEN d.doc_id IS NOT NULL THEN [d.source, d.lang] END AS tags, d.source AS title,
CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN c.turn % 3 = 1 THEN 'ambiguous' WHEN c.turn % 5 = 4 THEN 'orphan' ELSE 'confident' END AS status, (c.conv_id * 7 + c.turn * 13) % 101 AS made, length(c.text) AS pos
FROM conversations c LEFT JOIN documents d ON c.conv_id * 3 = d.doc_id)
"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("a"), F.array("source", "lang").alias("tags"), F.col("source").alias("title"))
    rows = turns.join(docs, F.col("conv_id") * 3 == F.col("a"), "left").withColumn("present", F.col("a").isNotNull())
    found = F.when(F.col("turn") % 3 == 1, "ambiguous").when(F.col("turn") % 5 == 4, "orphan").otherwise("confident")
    return rows.select("conv_id", "turn", "present", "tags", "title", review.entry_status(F.col("present"), found).alias("status"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 101).alias("made"), F.length("text").cast("long").alias("pos"))


@query(_ENTRIES + "SELECT conv_id, turn, status FROM e WHERE list_contains(tags, 'en') AND status = 'confident'")
def review_filter(spark, d):
    return review.review_filter(_entries(spark, d), F.col("tags"), F.col("conv_id"), F.col("status"), tag="en", confidence="confident").select("conv_id", "turn", "status")


@query(_ENTRIES + "SELECT conv_id, turn, status FROM e WHERE conv_id = 3")
def review_one_article(spark, d):
    return review.review_filter(_entries(spark, d), F.col("tags"), F.col("conv_id"), F.col("status"), article_id=3).select("conv_id", "turn", "status")


@query(_ENTRIES + "SELECT conv_id, turn, max(made) OVER (PARTITION BY conv_id) AS newest, row_number() OVER (PARTITION BY conv_id ORDER BY made DESC, turn) - 1 AS place FROM e WHERE present")
def review_by_date(spark, d):
    rows = review.with_section_newest(_entries(spark, d).filter("present"), "conv_id", "made")
    ranked = review.ranked_sections(rows, "conv_id", [F.desc("made"), F.col("turn")])
    return ranked.orderBy(F.desc("newest"), "conv_id", "place").select("conv_id", "turn", "newest", "place")


@query(_ENTRIES + "SELECT title, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos, turn) - 1 AS place FROM e WHERE present")
def review_by_article(spark, d):
    ranked = review.ranked_sections(_entries(spark, d).filter("present"), "conv_id", [F.col("pos"), F.col("turn")])
    return ranked.orderBy(F.expr("title COLLATE UNICODE"), "conv_id", "place").select("title", "conv_id", "turn", "place")


@query(_ENTRIES + "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos, turn) - 1 AS place FROM e WHERE present")
def review_by_position(spark, d):
    ranked = review.ranked_sections(_entries(spark, d).filter("present"), "conv_id", [F.col("pos"), F.col("turn")])
    return ranked.orderBy("conv_id", "place").select("conv_id", "turn", "place")


@query(_ENTRIES + """SELECT conv_id, count(*) FILTER (WHERE status = 'confident') AS confident, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous,
count(*) FILTER (WHERE status = 'orphan') AS orphan, count(*) FILTER (WHERE status <> 'confident') AS unresolved FROM e GROUP BY conv_id""")
def resolution_tally(spark, d):
    return review.tally(_entries(spark, d), ["conv_id"])


@query("SELECT count(*) FILTER (WHERE turn % 2 = 0) AS confident, count(*) FILTER (WHERE turn % 2 = 1 AND turn % 3 = 0) AS ambiguous, count(*) FILTER (WHERE turn % 2 = 1 AND turn % 3 <> 0) AS orphan, count(*) FILTER (WHERE turn % 2 = 1) AS unresolved FROM conversations")
def unresolved_count(spark, d):
    status = F.when(F.col("turn") % 2 == 0, "confident").when(F.col("turn") % 3 == 0, "ambiguous").otherwise("orphan")
    return review.tally(table(spark, d, "conversations").select(status.alias("status")), [])


@query("SELECT doc_id FROM documents WHERE list_contains([source, lang], 'en')")
def tag_filter(spark, d):
    return table(spark, d, "documents").filter(F.array_contains(F.array("source", "lang"), "en")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 2")
def chapter_exclusion(spark, d):
    book = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, "book")
    return table(spark, d, "documents").filter(review.not_a_chapter(book)).select("doc_id")


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'mailto:a@b.example' WHEN 3 THEN 'javascript:' || url ELSE '//' || url END AS u FROM pages)
SELECT page_id, regexp_matches(u, '(?i)^(https?|mailto):') AS link, regexp_matches(u, '(?i)^https?:') AS media FROM u""")
def url_schemes(spark, d):
    k, url = F.col("page_id") % 5, F.col("url")
    u = F.when(k == 0, url).when(k == 1, F.upper(url)).when(k == 2, "mailto:a@b.example").when(k == 3, F.concat(F.lit("javascript:"), url)).otherwise(F.concat(F.lit("//"), url))
    return table(spark, d, "pages").select("page_id", review.allowed_link(u).alias("link"), review.allowed_media(u).alias("media"))


_NAMES = ("a/{}.txt", "../{}", "a/../../{}", "/{}", "a/../{}", "C:{}", "a\\{}", "a/nul.{}")


@query("SELECT doc_id, doc_id % 8 IN (0, 4) AS safe FROM documents")
def safe_entry_names(spark, d):
    name = F.lit(None).cast("string")
    for i, pattern in enumerate(_NAMES):
        before, after = pattern.split("{}")
        name = F.when(F.col("doc_id") % 8 == i, F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))).otherwise(name)
    return table(spark, d, "documents").select("doc_id", fn.safe_entry_name(name).alias("safe"))


@query("""SELECT doc_id, doc_id % 6 IN (1, 2, 4, 5) AS protected FROM documents""")
def drm_flags(spark, d):
    k, font = F.col("doc_id") % 6, F.lit("http://www.idpf.org/2008/embedding")
    names = F.when(k == 1, F.array(F.lit("META-INF/license.lcpl"))).when(k == 2, F.array(F.lit("META-INF/rights.xml"))).otherwise(F.array(F.lit("mimetype")))
    algorithms = F.when(k == 3, F.array(font, font)).when(k == 4, F.array(font, F.lit("http://example.com/aes"))).when(k == 5, F.array(F.lit(None).cast("string")))
    return table(spark, d, "documents").select("doc_id", review.drm_protected(names, algorithms).alias("protected"))


_TITLES = ("Untitled ", "Microsoft Word - x", "A good title {}", "report{}.docx", "x", "0123456789abcdef0123", "Unknown quantities {}", "  ", "Adobe Illustrator 3", "12345678-1234-1234-1234-123456789abc")


@query("SELECT doc_id, doc_id % 10 IN (2, 6) AS sane FROM documents")
def pdf_titles(spark, d):
    title = F.lit(None).cast("string")
    for i, t in enumerate(_TITLES):
        before, _, after = t.partition("{}")
        title = F.when(F.col("doc_id") % 10 == i, F.concat(F.lit(before), F.col("doc_id").cast("string") if "{}" in t else F.lit(""), F.lit(after))).otherwise(title)
    return table(spark, d, "documents").select("doc_id", review.sane_title(title).alias("sane"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '- ' || doc_id || ' -' WHEN 2 THEN 'page ' || doc_id WHEN 3 THEN '|' || doc_id ELSE doc_id || '12345' END AS t FROM documents)
SELECT doc_id, regexp_matches(trim(t), '^[#|\-–—\s]*[0-9]{1,4}[#|\-–—\s]*$') AS bare FROM t""")
def bare_page_numbers(spark, d):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    t = F.when(k == 0, i).when(k == 1, F.concat(F.lit("- "), i, F.lit(" -"))).when(k == 2, F.concat(F.lit("page "), i)).when(k == 3, F.concat(F.lit("|"), i)).otherwise(F.concat(i, F.lit("12345")))
    return table(spark, d, "documents").select("doc_id", review.bare_page_number(t).alias("bare"))


_KINDS = ("paragraph", "heading", "blockquote", "bulleted-list", "numbered-list", "figure", "code-block", "footnote-reference", "unsupported")


@query(f"""WITH k AS (SELECT doc_id, {list(_KINDS)}[doc_id % 9 + 1] AS kind FROM documents)
SELECT doc_id, kind <> 'unsupported' AS selectable, kind IN ('paragraph', 'blockquote', 'bulleted-list', 'numbered-list') AS splittable FROM k""")
def block_eligibility(spark, d):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 9).cast("int"))
    return table(spark, d, "documents").select("doc_id", review.selectable(kind).alias("selectable"), review.splittable(kind).alias("splittable"))


_SOURCES = tuple(review.BADGES)


@query(f"""SELECT doc_id, {list(review.BADGES.values())}[doc_id % 7 + 1] AS badge FROM documents""")
def source_badges(spark, d):
    source = F.get(F.array(*map(F.lit, _SOURCES)), (F.col("doc_id") % 7).cast("int"))
    return table(spark, d, "documents").select("doc_id", review.source_badge(source).alias("badge"))


_REASONS = (
    "ssrf-blocked-scheme ssrf-blocked-private-ip ssrf-blocked-metadata fetch-failed response-too-large unsupported-content-type extraction-unsupported extraction-too-low-confidence round-trip-anchor-failed "
    "pdf-unreadable pdf-encrypted pdf-scanned pdf-multi-column pdf-too-large epub-protected epub-unreadable epub-empty epub-too-large already-in-library server-error"
)


@query(f"""WITH said(k, said) AS (VALUES (0, 'This address points somewhere the reader can''t reach.'), (1, 'This address points somewhere the reader can''t reach.'), (2, 'This address points somewhere the reader can''t reach.'), (3, 'Couldn''t reach this page.'), (4, 'This page is too large.'),
(5, 'This page isn''t an article.'), (6, 'Couldn''t reliably read this page.'), (7, 'Couldn''t reliably read this page.'), (8, 'Couldn''t reliably read this page.'), (9, 'This PDF couldn''t be opened — it may be corrupt or not a PDF.'), (10, 'This PDF is password-protected, so its text can''t be read.'),
(11, 'This PDF looks like scanned images rather than text. An OCR tool could convert it first.'), (12, 'This PDF has multiple text columns, and its reading order can''t be reconstructed reliably yet.'), (13, 'This PDF is too long or too large to read here.'), (14, 'This book is protected by DRM and cannot be added.'),
(15, 'This file could not be read as an EPUB book.'), (16, 'No readable chapters were found in this book.'), (17, 'This book is too large to add.'), (18, 'Already in your library.'), (19, 'Something went wrong. Try again.'))
SELECT doc_id, string_split('{_REASONS}', ' ')[doc_id % 20 + 1] AS reason, said FROM documents JOIN said ON k = doc_id % 20""")
def failure_copy(spark, d):
    """What a reader is told for each of the reasons."""
    reason = F.get(F.split(F.lit(_REASONS), " "), (F.col("doc_id") % 20).cast("int"))
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"), review.failure_copy(reason).alias("said"))


@query("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [source, lang, 'read later'] ELSE [source, lang] END, ',') AS tags, array_to_string(CASE WHEN doc_id % 2 = 0 THEN [source] ELSE [source, lang] END, ',') AS saved FROM documents""")
def tag_updates(spark, d):
    k = F.col("doc_id")
    draft = F.when(k % 3 == 0, " read later ").when(k % 3 == 1, F.col("source")).otherwise("  ")
    saved = review.saved_tags(F.array(F.col("source"), F.when(k % 2 == 0, " ").otherwise(F.col("lang"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(review.with_new_tag(F.array("source", "lang"), draft), ",").alias("tags"), F.array_join(saved, ",").alias("saved"))


@query("""WITH l AS (SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1)
SELECT doc_id, ts AS opened, CASE WHEN value IS NULL THEN NULL WHEN n_chars > 0 THEN least(1.0, greatest(0.0, value / n_chars)) ELSE 0.0 END AS progress FROM documents LEFT JOIN l ON doc_id = user_id""")
def library_rows(spark, d):
    newest = library.latest_value(table(spark, d, "events"), "user_id", ["value"], "ts", "event_id").select("user_id", F.col("ts").alias("opened"), "value")
    out = table(spark, d, "documents").join(newest, F.col("doc_id") == F.col("user_id"), "left")
    return out.select("doc_id", "opened", F.when(F.col("value").isNotNull(), review.progress_ratio(F.col("value"), F.col("n_chars"))).alias("progress"))


@query("""WITH b AS (SELECT o_orderkey, unnest(generate_series(1, 4)) AS chapter FROM orders), m AS (SELECT o_orderkey, chapter, chapter - 1 AS place, true AS declared, l_partkey FROM b JOIN lineitem ON o_orderkey = l_orderkey AND chapter = l_linenumber),
u AS (SELECT l_orderkey, l_linenumber, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, false AS declared, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber > 4)
SELECT o_orderkey, chapter::INT AS chapter, place::BIGINT AS place, declared, l_partkey FROM m UNION ALL SELECT * FROM u""")
def shelf_chapters(spark, d):
    books = table(spark, d, "orders").select("o_orderkey", F.sequence(F.lit(1), F.lit(4)).alias("chapters"))
    chapters = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("chapter"), "l_partkey")
    return shelf.chapters_of(books, chapters, "o_orderkey", "chapters", "l_orderkey", "chapter").select("o_orderkey", "chapter", "place", "declared", "l_partkey")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id * 2 + 1 FROM embeddings)""")
def admitted_articles(spark, d):
    have = table(spark, d, "embeddings").select((F.col("vec_id") * 2 + 1).alias("vec_id"))
    return table(spark, d, "documents").join(have, F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("""WITH t AS (SELECT l_orderkey AS book, l_linenumber::BIGINT AS ord, l_returnflag || l_linenumber AS label, 2 - l_partkey % 3 AS pos FROM lineitem WHERE l_partkey % 4 <> 3)
SELECT book, pos, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY book, pos ORDER BY ord, label) AS r FROM t) WHERE r = 1""")
def toc_targets(spark, d):
    items = table(spark, d, "lineitem")
    n = F.col("l_partkey") % 3
    label = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    href = F.when(F.col("l_partkey") % 4 == 3, "absent.xhtml").otherwise(F.concat(F.lit("text/./x/../c%20"), n.cast("string"), F.lit(".xhtml#p")))
    toc = items.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("long").alias("ord"), label.alias("label"), href.alias("href"))
    parts = table(spark, d, "orders").select(F.col("o_orderkey").alias("book"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    manifest = parts.select("book", F.concat(F.lit("i"), F.col("i").cast("string")).alias("item"), F.concat(F.lit("text/c%20"), F.col("i").cast("string"), F.lit(".xhtml")).alias("href"))
    spine = parts.select("book", F.concat(F.lit("i"), F.col("i").cast("string")).alias("item"), (2 - F.col("i")).cast("long").alias("pos"))
    return shelf.toc_targets(toc, manifest, spine)


@query("""WITH s AS (SELECT o_custkey, o_orderkey % 100 AS pos, min(o_orderkey) AS label FROM orders GROUP BY ALL), u AS (SELECT o_custkey, pos AS start, coalesce(lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos), 100) AS until, 'c' || label AS label FROM s),
f AS (SELECT o_custkey, 0::BIGINT, min(pos), 'Front matter' FROM s GROUP BY o_custkey HAVING min(pos) > 0) SELECT o_custkey, start::BIGINT AS start, until::BIGINT AS until, label FROM u UNION ALL SELECT * FROM f""")
def chapter_units(spark, d):
    starts = table(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 100).alias("at")).agg(F.concat(F.lit("c"), F.min("o_orderkey").cast("string")).alias("label")).withColumn("end", F.lit(100).cast("long"))
    return layout.chapter_units(starts, "o_custkey", "at", "label", "end")


@query("""WITH c AS (SELECT doc_id, unnest(generate_series(0, doc_id % 4)) * 50 AS start FROM documents), p AS (SELECT doc_id, n_chars % 200 AS at FROM documents)
SELECT p.doc_id, p.at, (SELECT max(start) FROM c WHERE c.doc_id = p.doc_id AND start <= p.at) AS range_start FROM p""")
def spine_units(spark, d):
    docs = table(spark, d, "documents")
    units = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), lambda i: i * 50)).alias("start"))
    return blocks.containing(docs.select("doc_id", (F.col("n_chars") % 200).alias("at")), units, "doc_id", "at", "start")


@query("""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id = 5 AND turn - 1 IN (SELECT turn FROM conversations WHERE role = 'user' AND conv_id = 5)""")
def article_annotations(spark, d):
    turns = table(spark, d, "conversations").filter("conv_id = 5")
    marked = turns.filter("role = 'user'").select((F.col("turn") + 1).alias("t"))
    return turns.filter("role = 'assistant'").join(marked, F.col("turn") == F.col("t"), "left_semi").select("conv_id", "turn")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS resume FROM orders GROUP BY o_custkey""")
def resume_chapters(spark, d):
    opened = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return library.latest_value(opened, "o_custkey", [], "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("resume"))


@query(r"""SELECT doc_id, count(*) FILTER (WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '') AS items, sum(length(regexp_replace(line, '\s+', '', 'g')))::BIGINT AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def page_text_stats(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return layout.page_stats(lines, ["doc_id"], "line")


@query("""WITH p AS (SELECT l_orderkey AS book, l_quantity AS items, l_extendedprice AS chars, l_discount > 0.05 AS col FROM lineitem), v AS (SELECT book, count(*) AS pages, count(*) FILTER (WHERE items >= 10 AND chars >= 5000) AS text_bearing,
count(*) FILTER (WHERE items < 5 OR chars < 2000) AS near_empty, count(*) FILTER (WHERE items >= 10 AND chars >= 5000 AND col) AS columnar FROM p GROUP BY book)
SELECT *, text_bearing > 0 AND columnar > 0.5 * text_bearing AS multi_column, near_empty > 0.5 * pages AS scanned FROM v""")
def document_verdicts(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_quantity").alias("items"), F.col("l_extendedprice").alias("chars"), (F.col("l_discount") > 0.05).alias("col"))
    return layout.document_verdict(pages, "book", F.col("col"), 10, 5000, 5, 2000)


@query("SELECT l_returnflag AS kind, bool_or(l_quantity > 49 AND l_discount > 0.09) AS eligible FROM lineitem GROUP BY l_returnflag")
def variant_eligibility(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.bool_or((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09)).alias("eligible"))


@query("""WITH s AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'paragraph' ELSE 'heading' END AS kind, l_quantity AS predicted, l_quantity + l_discount * 20 AS actual, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_linenumber <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ord) AS r FROM s) SELECT l_suppkey, kind, max(round(abs(actual - predicted), 6)) AS drift FROM r WHERE r <= 5 AND abs(actual - predicted) > 0.5 GROUP BY ALL""")
def drift_downgrades(spark, d):
    kind = F.when(F.col("l_linenumber") == 3, "figure").when(F.col("l_linenumber") % 2 == 0, "paragraph").otherwise("heading")
    samples = table(spark, d, "lineitem").select("l_suppkey", kind.alias("kind"), F.col("l_quantity").alias("predicted"), (F.col("l_quantity") + F.col("l_discount") * 20).alias("actual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.lit(True).alias("eligible"))
    return layout.drift_downgrades(samples, "l_suppkey", "ord", 0.5).withColumn("drift", F.round("drift", 6))


@query("""WITH s AS (SELECT user_id, max(ts) AS saved FROM events GROUP BY user_id) SELECT doc_id, source AS title, saved FROM documents LEFT JOIN s ON doc_id = user_id""")
def export_order(spark, d):
    saved = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("saved"))
    rows = table(spark, d, "documents").join(saved, F.col("doc_id") == F.col("user_id"), "left")
    return rows.select("doc_id", F.col("source").alias("title"), "saved").orderBy(F.desc_nulls_last("saved"), F.expr("title COLLATE UNICODE"), "doc_id")


@query("SELECT o_orderkey, o_orderdate FROM orders")
def books_by_added(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag <> 'A', l_linenumber, l_returnflag) AS creators FROM lineitem GROUP BY l_orderkey""")
def creators_order(spark, d):
    one = F.struct((F.col("l_returnflag") != "A").alias("other"), F.col("l_linenumber").alias("i"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"]), ",").alias("creators"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://example.com/p?a=' || page_id || '&b=2&b=1' ELSE 'https://example.com/p?z=1' END AS url FROM pages""")
def sorted_parameters(spark, d):
    i = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("HTTP://Example.com:80/p?b=2&utm_source=x&a="), i, F.lit("&b=1#top"))).otherwise("https://EXAMPLE.com:443/p?fbclid=7&z=1&ref=q")
    return table(spark, d, "pages").select("page_id", fn.clean_url(raw).alias("url"))


@query("""WITH b AS (SELECT l_orderkey, count(*)::INT AS n, max(l_linenumber)::INT AS m FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, n, CASE WHEN n < 4 THEN m // 2 ELSE least(greatest(m // 2, 2), n - 2) END::INT AS split FROM b""")
def legal_splits(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.max("l_linenumber").alias("m"))
    return b.select("l_orderkey", "n", layout.legal_split(F.col("n"), F.floor(F.col("m") / 2).cast("int")).cast("int").alias("split"))


@query("""WITH b AS (SELECT doc_id, (doc_id % 9)::INT AS n, (doc_id % 11) * 24 + 10 AS limit_px FROM documents), k AS (SELECT doc_id, n, limit_px, unnest(generate_series(2, greatest(n - 1, 2))) AS k FROM b),
a AS (SELECT doc_id, n, limit_px, least(greatest(k, 2), n - 2) AS a FROM k WHERE n >= 4) SELECT b.doc_id, max(a.a)::INT AS lines FROM b LEFT JOIN a ON a.doc_id = b.doc_id AND a.a * 24 <= a.limit_px GROUP BY b.doc_id""")
def overflow_splits(spark, d):
    n = (F.col("doc_id") % 9).cast("int")
    bottoms = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i * 24)).otherwise(F.array().cast("array<int>"))
    rows = table(spark, d, "documents").select("doc_id", bottoms.alias("b"), (F.col("doc_id") % 11 * 24 + 10).alias("limit_px"))
    return rows.select("doc_id", layout.largest_legal_split(F.col("b"), F.lit(0), F.col("limit_px")).cast("int").alias("lines"))


@query(_ENTRIES + "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN status = 'confident' THEN pos + 1 ELSE made END, turn) - 1 AS place FROM e")
def annotation_order(spark, d):
    rows = _entries(spark, d).withColumn("resolved", F.when(F.col("status") == "confident", F.col("pos") + 1))
    return review.ranked_sections(rows, "conv_id", [F.coalesce("resolved", "made"), F.col("turn")]).select("conv_id", "turn", "place")


@query("SELECT DISTINCT source AS title, lang FROM documents")
def article_options(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("title"), "lang").distinct().orderBy(F.expr("title COLLATE UNICODE"), "lang")


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<html\b[^>]*\blang=["'']?([^"''\s>]*)', 1), ''), 'en') AS lang,
nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')), '') AS title FROM pages""")
def page_metadata(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", review.page_language(html).alias("lang"), review.page_title(html).alias("title"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Own title' WHEN 1 THEN 'notes' WHEN 2 THEN 'PDF document' WHEN 3 THEN 'h.example' ELSE 'Pasted article' END AS title FROM documents""")
def fallback_titles(spark, d):
    k = F.col("doc_id") % 5
    source = F.when(k == 1, "markdown").when(k == 2, "pdf").otherwise("html")
    title = review.source_title(F.when(k == 0, "Own title"), source, F.when(k == 1, "notes.MD"), F.when(k == 3, "h.example").otherwise(""))
    return table(spark, d, "documents").select("doc_id", title.alias("title"))


@query("""SELECT doc_id, doc_id % 4 IN (0, 1) AS repeated FROM documents""")
def repeated_titles(spark, d):
    k, s = F.col("doc_id") % 4, F.col("source")
    heading = F.when(k == 0, F.upper(s)).when(k == 1, F.concat(s, F.lit(" -- and_more"))).when(k == 2, " - ").otherwise("another heading")
    return table(spark, d, "documents").select("doc_id", review.duplicates_title(heading, F.concat(s, F.lit(" "))).alias("repeated"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract('milliseconds' FROM ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def iso_times(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise(F.concat(F.lit("soon "), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", review.iso_time(raw).alias("iso"))


@query("""SELECT page_id, '> — ' || CASE WHEN page_id % 2 = 0 THEN 'A. Writer, ' ELSE '' END || '*Page ' || page_id || '*' || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' ([source](' || url || '))' END AS line FROM pages""")
def citations(spark, d):
    author = F.when(F.col("page_id") % 2 == 0, "A. Writer")
    line = review.citation(author, F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.when(F.col("page_id") % 3 != 0, F.col("url")))
    return table(spark, d, "pages").select("page_id", line.alias("line"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.txt' ELSE p_name END AS name FROM part""")
def plain_names(spark, d):
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", review.without_extension(F.concat("p_name", F.when(k == 0, ".PDF").when(k == 1, ".txt").otherwise(".Markdown"))).alias("name"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN 'heading ' || o_custkey ELSE 'Chapter ' || o_custkey END AS title FROM orders""")
def chapter_titles(spark, d):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    label = F.when(k == 0, F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))).when(k == 1, " ")
    title = layout.chapter_title(label, F.when(k == 1, F.col("o_orderpriority")), F.when(k == 2, F.concat(F.lit("heading "), n)).otherwise(""), F.concat(F.lit("Chapter "), n))
    return table(spark, d, "orders").select("o_orderkey", title.alias("title"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS n FROM lineitem WHERE l_quantity > 10) SELECT l_orderkey, l_linenumber, l_orderkey || '-c' || lpad(n::VARCHAR, 2, '0') AS id FROM v""")
def admitted_chapter_ids(spark, d):
    admitted = review.ranked_sections(table(spark, d, "lineitem").filter("l_quantity > 10"), "l_orderkey", [F.col("l_linenumber")])
    return admitted.select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit("-c"), F.lpad(F.col("place").cast("string"), 2, "0")).alias("id"))


@query("""WITH e AS (SELECT event_id, user_id, floor(value)::BIGINT % 7 AS epoch FROM events) SELECT event_id, epoch, coalesce(max(epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch, false) AS stale FROM e""")
def stale_results(spark, d):
    results = table(spark, d, "events").select("event_id", "user_id", (F.floor("value") % 7).cast("long").alias("epoch"))
    return layout.current_epochs(results, "user_id", "epoch", "event_id").select("event_id", "epoch", "stale")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def diagnostic_ring(spark, d):
    return layout.ring(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS t, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) > 13.5 AS b, l_extendedprice FROM lineitem),
n AS (SELECT *, sum(coalesce(b::INT, 0)) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS paragraph FROM p) SELECT l_orderkey, paragraph::BIGINT AS paragraph, count(*) AS n, string_agg(t, ' ' ORDER BY l_extendedprice) AS text FROM n GROUP BY ALL""")
def line_paragraphs(spark, d):
    from pyspark.sql import Window as W

    # The SQL leaves lines of one price in any order; here line number and quantity decide, as numbers repeat in an order, so that reruns agree.
    own = W.partitionBy("l_orderkey").orderBy(*map(F.asc_nulls_last, ("l_extendedprice", "l_linenumber", "l_quantity")))
    gap = F.col("l_quantity") - F.lag("l_quantity").over(own) > 13.5
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("t"), gap.alias("b"))
    return layout.paragraphs(lines, ["l_orderkey"], "l_extendedprice", F.col("b"), "t")


@query()
def line_bands(spark, d):
    """No SQL: whether an item opens a band depends on the band's first item."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return layout.line_bands(items, ["l_orderkey"], "x", "y", 6.0)


@query()
def label_agreement(spark, d):
    """No SQL: each label looks behind the match of the label before it."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("a"))
    return rows.select("l_orderkey", layout.agreement(F.expr("a.l_returnflag"), F.reverse(F.expr("a.l_returnflag"))).alias("agreement"))
