"""One query an operator, on the driver's tables as stand-ins, with the SQL it must agree with.

Stand-ins: documents are articles and their lines blocks; pages give URLs and HTML; events are saved positions
(user = article, value = offset); orders are books with lineitems as chapters; conversations are highlights
(turns) of articles (conversations).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn
from ..operators import anchors, blocks, library, merge, pagination
from ..sources import table
from ..streaming.positions import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_BLOCKS = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
     clean AS (SELECT doc_id, line, trim(regexp_replace(raw, '[\t\n\f\r ]+', ' ', 'g')) AS text FROM lines),
     blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS idx, text FROM clean WHERE text <> '')
"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.text_blocks(table(spark, d, "documents"))


@query(_BLOCKS + """SELECT doc_id, idx::INT AS idx, length(text)::BIGINT AS len,
coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks""")
def block_offsets(spark, d):
    return blocks.offset_blocks(table(spark, d, "documents")).select("doc_id", "idx", "len", "start")


@query(_BLOCKS + """, s AS (SELECT doc_id, count(*) AS n_blocks, (sum(length(text)) + count(*) - 1)::BIGINT AS text_length FROM blocks GROUP BY doc_id)
SELECT *, CASE WHEN n_blocks >= 3 AND text_length >= 500 THEN 'confident' ELSE 'low' END AS state,
CASE WHEN n_blocks >= 3 AND text_length >= 500 THEN '' ELSE 'extraction-thin' END AS reason FROM s""")
def extraction_confidence(spark, d):
    return blocks.text_stats(table(spark, d, "documents"))


@query(_BLOCKS + r""", edge AS (SELECT DISTINCT doc_id, lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS key
FROM (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last FROM blocks) WHERE idx = 0 OR idx = last)
SELECT key, count(*) AS n FROM edge GROUP BY key HAVING count(*) >= 3""")
def repeated_furniture(spark, d):
    return blocks.edge_furniture(table(spark, d, "documents"))


@query("SELECT doc_id, length_grapheme(text)::BIGINT AS n_graphemes FROM documents")
def grapheme_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.grapheme_count(F.col("text")).cast("long").alias("n_graphemes"))


@query("SELECT doc_id, 'md-' || substr(sha256(text), 1, 12) AS content_id FROM documents")
def content_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.content_id("md-", F.col("text")).alias("content_id"))


@query("SELECT id, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, substr(sha256(text), 1, 12) AS id FROM documents) GROUP BY id")
def content_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", fn.content_id("", F.col("text")).alias("id"))
    return rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS domain, NOT regexp_matches(trim(html), '<[A-Za-z!/]') AS is_plain FROM pages")
def page_source_kind(spark, d):
    return table(spark, d, "pages").select("page_id", fn.domain(F.col("url")).alias("domain"), fn.looks_like_plain_text(F.col("html")).alias("is_plain"))


@query(r"""WITH u AS (SELECT page_id, replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '.', '-') AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[./_]+', '-', 'g'), '-+', '-', 'g') AS p FROM u)
SELECT page_id, lower(CASE WHEN p = '' THEN host ELSE host || '-' || p END) AS slug FROM s""")
def url_identity(spark, d):
    return table(spark, d, "pages").select("page_id", fn.url_slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(source || ' ' || coalesce(lang, '') || ' ' || coalesce(text, '')), 'src1 en')")
def library_search(spark, d):
    docs = table(spark, d, "documents")
    return library.search(docs, [F.col("source"), F.col("lang"), F.col("text")], " Src1 EN ").select("doc_id", "source", "lang")


@query("""SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def latest_location(spark, d):
    return library.latest_value(table(spark, d, "events"), "user_id", ["value"], "ts", "event_id").select("user_id", "ts", "event_id", "value")


@query("""SELECT user_id, ts FROM (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events)
WHERE r = 1 AND value < 50 ORDER BY ts DESC, user_id LIMIT 3""")
def continue_reading(spark, d):
    newest = library.latest_value(table(spark, d, "events"), "user_id", ["value"], "ts", "event_id")
    return newest.filter("value < 50").orderBy(F.desc("ts"), "user_id").limit(3).select("user_id", "ts")


@query("""SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_quantity >= 0.98 * 40) AS finished, count(*) FILTER (WHERE l_quantity >= 0.98 * 40) / count(*) AS share
FROM lineitem GROUP BY l_orderkey""")
def book_progress(spark, d):
    return library.progress(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), F.lit(40.0))


@query("""SELECT o_orderkey, l_linenumber, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS ordinal
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def book_chapters(spark, d):
    books = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    chapters = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    out = books.join(chapters, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "l_linenumber", "o_orderstatus", (F.row_number().over(W.partitionBy("o_orderkey").orderBy(F.col("l_linenumber").asc_nulls_last())) - 1).cast("long").alias("ordinal"))


_REVIEW = """WITH notes AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT c.conv_id, c.turn, d.source AS article, n.turn AS note, CASE WHEN length(c.text) > 120 THEN substr(c.text, 1, 120) || '…' ELSE c.text END AS excerpt
FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id LEFT JOIN notes n ON c.conv_id = n.conv_id AND c.turn = n.turn WHERE c.role = 'user' OR n.turn IS NOT NULL)
"""


@query(_REVIEW + "SELECT * FROM r")
def review_entries(spark, d):
    turns = table(spark, d, "conversations")
    notes = turns.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("nc")).agg(F.max("turn").alias("note"))
    articles = table(spark, d, "documents").select(F.col("doc_id").alias("ai"), F.col("source").alias("article"))
    out = turns.join(articles, F.col("conv_id") == F.col("ai"), "left").join(notes, (F.col("conv_id") == F.col("nc")) & (F.col("turn") == F.col("note")), "left")
    return out.filter("role = 'user' or note is not null").select("conv_id", "turn", "article", "note", library.excerpt(F.col("text"), 120).alias("excerpt"))


@query("""SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_articles, max(turn) AS newest, min(conv_id) AS first_seen FROM conversations GROUP BY role""")
def review_sections(spark, d):
    turns = table(spark, d, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_articles"), F.max("turn").alias("newest"), F.min("conv_id").alias("first_seen"))


@query("SELECT DISTINCT tag FROM (SELECT unnest([source, lang]) AS tag FROM documents) WHERE tag <> ''")
def all_tags(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array("source", "lang")).alias("tag")).filter("tag <> ''").distinct()


@query("""SELECT event_type, count(*) AS n, (list_sort(list(value)))[(least(count(*) - 1, floor(0.95 * count(*))) + 1)::INT] AS p FROM events GROUP BY event_type""")
def nearest_rank_p95(spark, d):
    return library.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 0.95)


@query("""WITH p AS (SELECT event_type, (list_sort(list(value)))[(least(count(*) - 1, floor(0.95 * count(*))) + 1)::INT] AS p, avg(value) * 1.5 AS budget FROM events GROUP BY event_type)
SELECT event_type, p > budget * 1.1 AS regressed FROM p""")
def budget_regressions(spark, d):
    events = table(spark, d, "events")
    budget = events.groupBy(F.col("event_type").alias("t")).agg((F.avg("value") * 1.5).alias("budget"))
    ranked = library.nearest_rank(events, ["event_type"], "value", 0.95)
    return ranked.join(budget, F.col("event_type") == F.col("t")).select("event_type", (F.col("p") > F.col("budget") * 1.1).alias("regressed"))


@query("""WITH s AS (SELECT l_returnflag, l_quantity, sum(l_linenumber)::BIGINT AS weight, min(l_orderkey) AS seen FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_quantity, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY weight DESC, seen) AS r FROM s) WHERE r = 1""")
def weighted_mode(spark, d):
    return blocks.weighted_mode(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", F.col("l_linenumber").cast("long"), order="l_orderkey")


@query("""WITH g AS (SELECT c_nationkey, c_custkey - lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS gap FROM customer),
c AS (SELECT c_nationkey, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL)
SELECT c_nationkey, gap, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, gap DESC) AS r FROM c) WHERE r = 1""")
def modal_line_gap(spark, d):
    customers = blocks.with_previous(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")
    return blocks.modal_gap(customers, "c_nationkey", "c_custkey", F.col("c_custkey") - F.col("previous"))


_VOTES = """WITH v AS (SELECT l_suppkey, bin, count(*) AS n FROM (SELECT l_suppkey, unnest(generate_series(l_linenumber::BIGINT, l_linenumber::BIGINT + (l_quantity::BIGINT % 5))) AS bin FROM lineitem) GROUP BY ALL)
"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("l_linenumber").cast("long")
    return blocks.votes(table(spark, d, "lineitem"), "l_suppkey", low, low + F.pmod(F.col("l_quantity").cast("long"), F.lit(5)))


@query(_VOTES + "SELECT * FROM v")
def gutter_votes(spark, d):
    return _votes(spark, d)


@query(_VOTES + """, l AS (SELECT *, bin - row_number() OVER (PARTITION BY l_suppkey ORDER BY bin) AS island FROM (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS top FROM v) WHERE n <= 0.5 * top)
SELECT l_suppkey, min(bin) AS first_bin, count(*) AS n_bins FROM l GROUP BY l_suppkey, island""")
def gutter_runs(spark, d):
    return blocks.empty_runs(_votes(spark, d), "l_suppkey", 0.5)


@query("""SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS until FROM orders""")
def chapter_ranges(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("until"))


@query(_BLOCKS + """, o AS (SELECT doc_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks),
p AS (SELECT doc_id, n_chars // 2 AS at FROM documents)
SELECT p.doc_id, p.at, (SELECT max(o.start) FROM o WHERE o.doc_id = p.doc_id AND o.start <= p.at) AS range_start FROM p""")
def containing_block(spark, d):
    docs = blocks.with_block_arrays(table(spark, d, "documents").select("doc_id", "text", F.floor(F.col("n_chars") / 2).alias("at")))
    return docs.select("doc_id", "at", F.array_max(F.filter(F.transform("blocks", lambda b: b["start"]), lambda x: x <= F.col("at"))).alias("range_start"))


@query(_BLOCKS + """, o AS (SELECT doc_id, idx, length(text) AS len, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM blocks),
h AS (SELECT doc_id, n_chars // 4 AS s, n_chars // 2 AS e FROM documents)
SELECT h.doc_id, o.idx::INT AS idx, greatest(s, start) AS from_char, least(e, start + len) AS to_char FROM h JOIN o USING (doc_id) WHERE greatest(s, start) < least(e, start + len)""")
def highlight_fragments(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.floor(F.col("n_chars") / 4).alias("s"), F.floor(F.col("n_chars") / 2).alias("e"))
    cut = lambda b: F.struct(b["idx"].alias("idx"), F.greatest(F.col("s"), b["start"]).alias("from_char"), F.least(F.col("e"), b["start"] + b["len"]).alias("to_char"))
    hits = F.filter(F.transform("blocks", cut), lambda x: x["from_char"] < x["to_char"])
    return blocks.with_block_arrays(docs).select("doc_id", F.inline(hits))


_BUNDLE = """WITH a AS (SELECT doc_id, (doc_id % 3) + 1 AS revision, md5(text) AS digest FROM documents),
l AS (SELECT CASE WHEN doc_id % 4 = 2 THEN -doc_id - 1 ELSE doc_id END AS doc_id, (doc_id % 5) % 3 + 1 AS revision, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents),
v AS (SELECT a.doc_id, a.revision, l.revision AS lr, l.doc_id IS NOT NULL AS present,
CASE WHEN l.doc_id IS NULL THEN NULL WHEN a.revision <> l.revision THEN 'article-revision' WHEN a.digest <> l.digest THEN 'article-content-divergence' END AS kind FROM a LEFT JOIN l USING (doc_id))
"""


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    a = docs.select("doc_id", (i % 3 + 1).alias("revision"), F.md5("text").alias("digest"))
    local = docs.select(F.when(i % 4 == 2, -i - 1).otherwise(i).alias("doc_id"), (i % 5 % 3 + 1).alias("revision"), F.when(i % 7 == 0, "x").otherwise(F.md5("text")).alias("digest"))
    v = merge.versus(a, local, ["doc_id"], {"revision": "lr", "digest": "ld"})
    return v.withColumn("kind", merge.article_conflict(F.col("revision"), F.col("lr"), F.col("digest"), F.col("ld"), F.col("present")))


@query(_BUNDLE + """SELECT kind, count(*) AS n, array_to_string((list_sort(list(doc_id)))[1:5], ',') AS sample FROM v WHERE kind IS NOT NULL GROUP BY kind""")
def import_conflicts(spark, d):
    return merge.summary(_bundle(spark, d), "doc_id")


@query(_BUNDLE + """SELECT doc_id, CASE WHEN NOT present THEN 'add' WHEN kind = 'article-content-divergence' OR (kind = 'article-revision' AND revision > lr) THEN 'replace' ELSE 'skip' END AS action FROM v""")
def merge_plan(spark, d):
    v = _bundle(spark, d)
    return v.select("doc_id", merge.article_action(F.col("kind"), F.col("present"), "overwrite", F.col("revision"), F.col("lr")).alias("action"))


@query("""SELECT vec_id * 2 AS id, 'a' AS origin FROM embeddings UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id NOT IN (SELECT vec_id * 2 FROM embeddings)""")
def library_union(spark, d):
    a = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id"), F.lit("a").alias("origin"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("b").alias("origin"))
    return library.first_wins(a, b, key="id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    kept = library.cascade_delete(gone, {"chapters": (table(spark, d, "lineitem"), "l_orderkey")}, "o_orderkey")
    return kept["chapters"].select("l_orderkey", "l_linenumber")


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_max(value, (ts, value)) AS value FROM
(SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def debounced_saves(spark, d):
    return debounced(table(spark, d, "events"), "user_id", "ts", "value", "6 hours")


@query(r"""WITH c AS (SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f]', '', 'g'), '[/\\<>:"|?*]', '', 'g')), 50000000) AS t FROM documents)
SELECT doc_id, CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' OR regexp_matches(trim(regexp_replace(t, '\s+', ' ', 'g')), '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)') THEN 'article' ELSE substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 120) END AS name FROM c""")
def export_file_names(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.file_name(F.col("text"), "article").alias("name"))


@query("""SELECT c_custkey, (c_custkey * 7919) % 256 AS a, ((c_custkey * 7919) % 256 IN (10, 127, 0)) OR ((c_custkey * 7919) % 256 = 172 AND c_custkey % 256 BETWEEN 16 AND 31)
OR ((c_custkey * 7919) % 256 = 192 AND c_custkey % 256 = 168) OR ((c_custkey * 7919) % 256 = 169 AND c_custkey % 256 = 254)
OR ((c_custkey * 7919) % 256 = 100 AND c_custkey % 256 BETWEEN 64 AND 127) OR (c_custkey * 7919) % 256 BETWEEN 224 AND 239 AS private FROM customer""")
def private_addresses(spark, d):
    a, b = F.col("c_custkey") * 7919 % 256, F.col("c_custkey") % 256
    ip = F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("1"), F.lit("9"))
    return table(spark, d, "customer").select("c_custkey", a.alias("a"), fn.is_private_v4(ip).alias("private"))


@query()
def quote_round_trip(spark, d):
    """Selectors taken at a quarter of each document and found again: confident where the quote is unique."""
    docs = table(spark, d, "documents").withColumn("_g", fn.graphemes(F.col("text"))).withColumn("n", F.size("_g"))
    at = F.floor(F.col("n") / 4).cast("int")
    selected = anchors.derive(docs, "_g", at, F.least(at + 20, F.col("n"))).drop("_g")
    return anchors.resolve(selected, hint=at).select("doc_id", "status", "at", "until")


@query()
def page_layout(spark, d):
    """Lines of blocks packed into pages of 800 px by a line height of 24 px and 70 characters a line."""
    docs = blocks.with_block_arrays(table(spark, d, "documents").select("doc_id", "text"))
    return pagination.paginate(docs.withColumn("m", pagination.measured("blocks", 70, 24.0, 12.0, 16.0)), "doc_id", "m", 800.0)


@query()
def overflow_repair(spark, d):
    """The pages of page_layout after every fifth block turned out a line longer: packed again from the first page that overflows."""
    docs = blocks.with_block_arrays(table(spark, d, "documents").select("doc_id", "text"))
    docs = docs.withColumn("m", pagination.measured("blocks", 70, 24.0, 12.0, 16.0))
    larger = F.transform("m", lambda b: F.struct(*(F.when(b["idx"] % 5 == 0, b["lines"] + 1).otherwise(b["lines"]).alias("lines") if f == "lines" else b[f].alias(f) for f in pagination._FIELDS)))
    pages = pagination.paginate(docs, "doc_id", "m", 800.0)
    return pagination.repaired(pages, docs.withColumn("true", larger), "doc_id", "true", 800.0)


@query("SELECT c_custkey, ((c_custkey * 7919) % 65536) BETWEEN 64512 AND 65023 OR ((c_custkey * 7919) % 65536) BETWEEN 65152 AND 65215 OR ((c_custkey * 7919) % 65536) >= 65280 AS private FROM customer")
def private_addresses_v6(spark, d):
    ip = F.concat(F.lower(F.hex(F.col("c_custkey") * 7919 % 65536)), F.lit(":db8::9"))
    return table(spark, d, "customer").select("c_custkey", fn.is_private_address(ip).alias("private"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ssrf-blocked-scheme' WHEN 1 THEN 'ssrf-blocked-metadata' WHEN 2 THEN 'ssrf-blocked-private-ip' WHEN 3 THEN 'ssrf-blocked-private-ip' ELSE '' END AS refusal FROM pages""")
def fetch_refusals(spark, d):
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.concat(F.lit("ftp:"), F.col("url"))).when(k == 1, "http://Metadata.google.internal/x").otherwise(F.col("url"))
    ips = F.when(k == 2, F.array(F.lit("8.8.8.8"), F.lit("::1"))).when(k == 3, F.array(F.lit("::ffff:c0a8:1"))).otherwise(F.array(F.lit("8.8.8.8"), F.lit("2001:db8::1")))
    return table(spark, d, "pages").select("page_id", fn.fetch_refusal(url, ips).alias("refusal"))
