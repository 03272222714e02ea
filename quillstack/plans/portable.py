"""Bundles against a local library: conflicts of all kinds, plans, deletes and upserts, with their SQL.

Stand-ins: every table is both sides, the local one with some values changed and some keys moved out of reach, so that both are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import portability as port
from ..operators import review
from ..sources import table
from .queries import query

_SIDES = """WITH books AS (SELECT o_orderkey AS id, o_custkey AS h FROM orders), lbooks AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS h FROM orders),
arts AS (SELECT doc_id AS id, doc_id % 3 AS rev, md5(text) AS h FROM documents), larts AS (SELECT CASE WHEN doc_id % 4 = 0 THEN -doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 5 = 0 THEN doc_id % 3 + 1 WHEN doc_id % 10 = 2 THEN doc_id % 3 - 1 ELSE doc_id % 3 END AS rev,
CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents),
highs AS (SELECT conv_id * 1000 + turn AS id FROM conversations), lhighs AS (SELECT CASE WHEN turn % 3 = 0 THEN -conv_id * 1000 - turn - 1 ELSE conv_id * 1000 + turn END AS id FROM conversations),
notes AS (SELECT event_id AS id, user_id AS ref FROM events), lnotes AS (SELECT CASE WHEN event_id % 2 = 0 THEN -event_id - 1 ELSE event_id END AS id FROM events),
locs AS (SELECT l_orderkey AS a, l_linenumber AS r, l_shipdate AS at FROM lineitem), llocs AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS a, l_linenumber AS r, l_shipdate + INTERVAL (l_partkey % 3 - 1) DAY AS at FROM lineitem),
"""
_BOOKS = "jb AS (SELECT b.id, l.id IS NOT NULL AS p, b.h IS NOT DISTINCT FROM l.h AS same FROM books b LEFT JOIN lbooks l USING (id)),"
_ARTS = "ja AS (SELECT a.id, a.rev, l.rev AS lrev, l.id IS NOT NULL AS p, a.h = l.h AS same FROM arts a LEFT JOIN larts l USING (id)),"


def _away(key, when):
    return F.when(when, -key - 1).otherwise(key)


def _books(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("h"))
    k = F.col("o_orderkey")
    local = o.select(_away(k, k % 5 == 0).alias("id"), F.when(k % 7 == 0, F.col("h") + 1).otherwise(F.col("h")).alias("h"))
    return port.against(o.withColumnRenamed("o_orderkey", "id"), local, ["id"], ["h"]).withColumn("same", F.col("h").eqNullSafe(F.col("local_h")))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", (k % 3).alias("rev"), F.md5("text").alias("h"))
    rev = F.when(k % 5 == 0, F.col("rev") + 1).when(k % 10 == 2, F.col("rev") - 1).otherwise(F.col("rev"))
    local = docs.select(_away(k, k % 4 == 0).alias("id"), rev.alias("rev"), F.when(k % 7 == 0, "x").otherwise(F.col("h")).alias("h"))
    return port.against(docs.withColumnRenamed("doc_id", "id"), local, ["id"], ["rev", "h"])


def _highlights(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    return port.against(c, c.select(_away(F.col("id"), F.col("turn") % 3 == 0).alias("id")), ["id"])


def _notes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ref"))
    return port.against(e, e.select(_away(F.col("id"), F.col("id") % 2 == 0).alias("id")), ["id"])


def _locations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("r"), F.col("l_shipdate").alias("at"), k.alias("k"))
    local = rows.select(_away(F.col("a"), F.col("k") == 0).alias("a"), "r", (F.col("at") + F.make_dt_interval((F.col("k") - 1).cast("int"))).alias("at"))
    return port.against(rows, local, ["a", "r"], ["at"])


@query(_SIDES + _BOOKS + _ARTS + """c AS (SELECT 'book' AS kind, id AS ord, id::VARCHAR AS id FROM jb WHERE p AND NOT same UNION ALL SELECT CASE WHEN rev <> lrev THEN 'article-revision' ELSE 'article-content-divergence' END, id, id::VARCHAR FROM ja WHERE p AND (rev <> lrev OR NOT same)
UNION ALL SELECT 'highlight-id', id, id::VARCHAR FROM highs WHERE id IN (SELECT id FROM lhighs) UNION ALL SELECT 'note-id', id, id::VARCHAR FROM notes WHERE id IN (SELECT id FROM lnotes)
UNION ALL SELECT 'location', l.a * 10 + l.r, l.a || '@' || l.r FROM locs l JOIN llocs o ON l.a = o.a AND l.r = o.r),
s AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY ord, id) AS r FROM c)
SELECT kind, count(*) AS n, string_agg(CASE WHEN r <= 5 THEN id END, ',' ORDER BY r) AS sample, list_position(['book', 'article-revision', 'article-content-divergence', 'highlight-id', 'note-id', 'location'], kind) - 1 AS place FROM s GROUP BY kind""")
def conflict_kinds(spark, d):
    ids = lambda rows, kind: rows.select(kind.alias("kind"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"))
    articles = _articles(spark, d).filter("present and (rev <> local_rev or h <> local_h)")
    places = _locations(spark, d).filter("present").select(F.lit("location").alias("kind"), (F.col("a") * 10 + F.col("r")).alias("ord"), F.concat(F.col("a").cast("string"), F.lit("@"), F.col("r").cast("string")).alias("id"))
    return port.conflict_summary([
        ids(_books(spark, d).filter("present and not same"), F.lit("book")),
        ids(articles, F.when(F.col("rev") != F.col("local_rev"), "article-revision").otherwise("article-content-divergence")),
        ids(_highlights(spark, d).filter("present"), F.lit("highlight-id")),
        ids(_notes(spark, d).filter("present"), F.lit("note-id")),
        places,
    ])


@query(_SIDES + _BOOKS + "z AS (SELECT 1) SELECT id, CASE WHEN NOT p THEN 'add' WHEN NOT same THEN 'replace' ELSE 'skip' END AS action FROM jb")
def book_plan(spark, d):
    return _books(spark, d).select("id", port.book_action(F.col("present"), F.col("same"), port.OVERWRITE).alias("action"))


@query(_SIDES + _BOOKS + "z AS (SELECT 1) SELECT id, CASE WHEN NOT p THEN 'add' ELSE 'skip' END AS action FROM jb")
def book_plan_keep_both(spark, d):
    return _books(spark, d).select("id", port.book_action(F.col("present"), F.col("same"), port.KEEP_BOTH).alias("action"))


def _minted(column: str, salt: str) -> str:
    return f"CASE WHEN {column} IN (SELECT id FROM l) THEN substr(sha256('{salt}' || {column}), 1, 32) ELSE {column}::VARCHAR END"


@query(_SIDES + "l AS (SELECT id FROM lhighs) SELECT id, CASE WHEN id IN (SELECT id FROM l) THEN 'mint' ELSE 'add' END AS action, " + _minted("id", "highlight") + " AS written FROM highs")
def highlight_plan(spark, d):
    rows = _highlights(spark, d).withColumn("action", port.id_action(F.col("present"), port.KEEP_BOTH))
    return rows.select("id", "action", port.minted(F.col("id"), F.col("action"), "highlight").alias("written"))


@query(_SIDES + "l AS (SELECT id FROM lnotes) SELECT id, " + _minted("id", "note") + " AS written, CASE WHEN ref % 5 = 0 THEN 'new' || ref ELSE ref::VARCHAR END AS ref FROM notes")
def note_plan(spark, d):
    rewrite = table(spark, d, "events").select("user_id").distinct().filter("user_id % 5 = 0").select(F.col("user_id").alias("old"), F.concat(F.lit("new"), F.col("user_id").cast("string")).alias("new"))
    rows = _notes(spark, d).join(rewrite, F.col("ref") == F.col("old"), "left").withColumn("action", port.id_action(F.col("present"), port.KEEP_BOTH))
    return rows.select("id", port.minted(F.col("id"), F.col("action"), "note").alias("written"), F.coalesce("new", F.col("ref").cast("string")).alias("ref"))


@query(_SIDES + "j AS (SELECT l.a, l.r, o.a IS NOT NULL AS p, l.at > o.at AS newer FROM locs l LEFT JOIN llocs o ON l.a = o.a AND l.r = o.r) SELECT a, r, CASE WHEN NOT p THEN 'add' WHEN newer THEN 'replace' ELSE 'skip' END AS action FROM j")
def location_plan(spark, d):
    return _locations(spark, d).select("a", "r", port.location_action(F.col("present"), F.col("at"), F.col("local_at"), port.OVERWRITE).alias("action"))


@query(_SIDES + _BOOKS + """m AS (SELECT 'books' AS entity, CASE WHEN NOT p THEN 'add' WHEN NOT same THEN 'replace' ELSE 'skip' END AS action FROM jb UNION ALL SELECT 'notes', CASE WHEN id IN (SELECT id FROM lnotes) THEN 'skip' ELSE 'add' END FROM notes)
SELECT entity, count(*) AS incoming, count(*) FILTER (WHERE action = 'add') AS added, count(*) FILTER (WHERE action <> 'skip') AS written, count(*) FILTER (WHERE action = 'skip') AS skipped FROM m GROUP BY entity""")
def import_counters(spark, d):
    books = _books(spark, d).select(F.lit("books").alias("entity"), port.book_action(F.col("present"), F.col("same"), port.OVERWRITE).alias("action"))
    notes = _notes(spark, d).select(F.lit("notes").alias("entity"), port.id_action(F.col("present"), port.SKIP).alias("action"))
    return port.counters(books.unionByName(notes))


@query(_SIDES + "z AS (SELECT 1) SELECT id FROM arts WHERE id NOT IN (SELECT id FROM larts)")
def bundle_difference(spark, d):
    return _articles(spark, d).filter("not present").select("id")


@query("SELECT c_nationkey, count(*) || CASE WHEN count(*) = 1 THEN ' article' ELSE ' articles' END AS said FROM customer GROUP BY c_nationkey")
def import_preview(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", port.preview_sentence(F.col("n"), "article", "articles").alias("said"))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey - 1, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 50 = 1""")
def upserted_rows(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    third = stored.filter(k % 3 == 0).select(k, "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("at"))
    older = third.withColumns({"c_acctbal": F.lit(-1.0), "at": F.lit(1)})
    fresh = stored.filter(k % 50 == 1).select((-k - 1).alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("at"))
    return port.upserted(stored, third.unionByName(older).unionByName(fresh), ["c_custkey"], "at")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)""")
def cascade_delete_book(spark, d):
    declared = table(spark, d, "lineitem").filter("l_suppkey = 1").select("l_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, d, "customer").filter("c_nationkey = 1").select("c_custkey")
    live = orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return port.without(orders, "o_orderkey", port.deletion_ids(declared, live)).select("o_orderkey")


@query("SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def deletion_ids(spark, d):
    return port.deletion_ids(table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 4)")
def delete_highlights(spark, d):
    gone = table(spark, d, "conversations").filter("turn = 4").select(F.col("conv_id").alias("id"))
    return port.without(table(spark, d, "events"), "user_id", gone).select("event_id")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def manifest_duplicates(spark, d):
    return port.repeated_keys(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], "l_linenumber")[1]


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL")
def manifest_items(spark, d):
    return port.repeated_keys(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], "l_linenumber")[0]


@query(r"""WITH u AS (SELECT page_id, replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '.', '-') AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[./_]+', '-', 'g'), '-+', '-', 'g') AS p FROM u)
SELECT lower(CASE WHEN p = '' THEN host ELSE host || '-' || p END) AS slug, min(page_id) AS page_id, count(*) AS n FROM s GROUP BY slug""")
def url_dedup(spark, d):
    return table(spark, d, "pages").groupBy(fn.url_slug(F.col("url")).alias("slug")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey * 3 FROM lineitem UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier)""")
def referenced_fixtures(spark, d):
    refs = [table(spark, d, "lineitem").select(F.col("l_partkey") * 3), table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey")]
    return port.referenced(table(spark, d, "part"), "p_partkey", *refs).select("p_partkey")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'unupgradeable' ELSE 'unavailable' END AS state FROM events")
def storage_errors(spark, d):
    k = F.col("event_id") % 3
    name = F.when(k == 0, "VersionError").when(k == 1, "QuotaExceededError")
    return table(spark, d, "events").select("event_id", review.storage_error(name, F.lit("failed")).alias("state"))


@query("""SELECT o_orderkey, sha256('[{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}]') AS digest FROM orders""")
def block_manifest(spark, d):
    row = F.array(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(row), 256).alias("digest"))
