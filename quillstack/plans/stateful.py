"""Queries that write: an import applied as one state, and streams over the events table with keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators import portability as port
from ..session import shared_folder
from ..sources import keyed, table
from ..sources.store import Store
from ..streaming import state
from .portable import _SIDES, _articles, _books, _highlights
from .queries import query


def _epoch(at):
    return F.unix_timestamp(at.cast("timestamp"))


@query(_SIDES + """ab AS (SELECT b.id FROM books b LEFT JOIN lbooks l USING (id) WHERE l.id IS NULL OR b.h <> l.h),
u AS (SELECT l_orderkey AS a, l_linenumber AS r, max(struct_pack(d := l_shipdate, k := l_partkey % 3)) AS m FROM lineitem GROUP BY ALL), ulocs AS (SELECT a, r, m.d AS "at" FROM u),
ullocs AS (SELECT CASE WHEN m.k = 0 THEN -a - 1 ELSE a END AS a, r, m.d + INTERVAL (m.k - 1) DAY AS "at" FROM u),
aa AS (SELECT a.id FROM arts a LEFT JOIN larts l USING (id) WHERE l.id IS NULL OR (a.rev <> l.rev AND a.rev > l.rev) OR (a.rev = l.rev AND a.h <> l.h)),
al AS (SELECT i.a, i.r FROM ulocs i LEFT JOIN ullocs l ON i.a = l.a AND i.r = l.r WHERE l.a IS NULL OR i.at > l.at)
SELECT 'book' AS entity, id::VARCHAR AS id, h::VARCHAR AS value FROM books WHERE id IN (SELECT id FROM ab) UNION ALL SELECT 'book', id::VARCHAR, h::VARCHAR FROM lbooks WHERE id NOT IN (SELECT id FROM ab)
UNION ALL SELECT 'article', id::VARCHAR, rev || ':' || h FROM arts WHERE id IN (SELECT id FROM aa) UNION ALL SELECT 'article', id::VARCHAR, rev || ':' || h FROM larts WHERE id NOT IN (SELECT id FROM aa)
UNION ALL SELECT 'highlight', id::VARCHAR, 'local' FROM lhighs UNION ALL SELECT 'highlight', CASE WHEN id IN (SELECT id FROM lhighs) THEN substr(sha256('highlight' || id), 1, 32) ELSE id::VARCHAR END, 'bundle' FROM highs
UNION ALL SELECT 'location', a || '@' || r, epoch("at")::BIGINT::VARCHAR FROM ulocs WHERE (a, r) IN (SELECT (a, r) FROM al) UNION ALL SELECT 'location', a || '@' || r, epoch("at")::BIGINT::VARCHAR FROM ullocs WHERE (a, r) NOT IN (SELECT (a, r) FROM al)""")
def atomic_import(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of all kinds written over a local library as one state of a store, and the library read from that state.

    Books and articles are overwritten (articles by higher revisions only), highlights kept both, locations by newer ones.
    """
    text = lambda c: c.cast("string")
    books, articles, highlights = _books(spark, d), _articles(spark, d), _highlights(spark, d)
    places = port.against(_places(spark, d), _places(spark, d, local=True), ["a", "r"], ["at"])
    conflict = merge.article_conflict(F.col("rev"), F.col("local_rev"), F.col("h"), F.col("local_h"), F.col("present"))
    kept = highlights.withColumn("action", port.id_action(F.col("present"), port.KEEP_BOTH))
    spot = F.concat(text(F.col("a")), F.lit("@"), text(F.col("r")))
    planned = {
        "book": books.select(text(F.col("id")).alias("id"), text(F.col("h")).alias("value"), port.book_action(F.col("present"), F.col("same"), port.OVERWRITE).alias("action")),
        "article": articles.select(text(F.col("id")).alias("id"), F.concat(text(F.col("rev")), F.lit(":"), "h").alias("value"), merge.article_action(conflict, F.col("present"), "overwrite", F.col("rev"), F.col("local_rev")).alias("action")),
        "highlight": kept.select(port.minted(F.col("id"), F.col("action"), "highlight").alias("id"), F.lit("bundle").alias("value"), "action"),
        "location": places.select(spot.alias("id"), text(_epoch(F.col("at"))).alias("value"), port.location_action(F.col("present"), F.col("at"), F.col("local_at"), port.OVERWRITE).alias("action")),
    }
    store = Store(spark, shared_folder(spark, "library"))
    store.apply(_local(spark, d))
    now = store.tables()
    store.apply({name: port.after_import(now[name], rows, ["id"]) for name, rows in planned.items()})
    out = None
    for name, rows in store.tables().items():
        rows = rows.select(F.lit(name).alias("entity"), "id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _places(spark: SparkSession, d: str, local: bool = False) -> DataFrame:
    """(a, r, at): one row for each line of an order; in the local library with other times, and some under other keys."""
    newest = F.max(F.struct(F.col("l_shipdate").alias("at"), (F.col("l_partkey") % 3).alias("k"))).alias("m")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("r")).agg(newest).select("a", "r", "m.*")
    if not local:
        return rows.select("a", "r", "at")
    return rows.select(F.when(F.col("k") == 0, -F.col("a") - 1).otherwise(F.col("a")).alias("a"), "r", (F.col("at") + F.make_dt_interval((F.col("k") - 1).cast("int"))).alias("at"))


def _local(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The library that a bundle meets: the tables with some values changed and some keys moved away."""
    text = lambda c: c.cast("string")
    away = lambda key, when: F.when(when, -key - 1).otherwise(key)
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    books = o.select(text(away(k, k % 5 == 0)).alias("id"), text(F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).alias("value"))
    k, h = F.col("doc_id"), F.md5("text")
    rev = F.when(k % 5 == 0, k % 3 + 1).when(k % 10 == 2, k % 3 - 1).otherwise(k % 3)
    articles = table(spark, d, "documents").select(text(away(k, k % 4 == 0)).alias("id"), F.concat(text(rev), F.lit(":"), F.when(k % 7 == 0, "x").otherwise(h)).alias("value"))
    k = F.col("conv_id") * 1000 + F.col("turn")
    highlights = table(spark, d, "conversations").select(text(away(k, F.col("turn") % 3 == 0)).alias("id"), F.lit("local").alias("value"))
    places = _places(spark, d, local=True).select(F.concat(text(F.col("a")), F.lit("@"), text(F.col("r"))).alias("id"), text(_epoch(F.col("at"))).alias("value"))
    return {"book": books, "article": articles, "highlight": highlights, "location": places}


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def _finished(writer, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def streamed_positions(spark: SparkSession, d: str) -> DataFrame:
    """The newest position of each user, put by key as a stream of events comes in."""
    folder = shared_folder(spark, "positions")
    store = Store(spark, f"{folder}/store")
    rows = _event_stream(spark, d).select("user_id", "ts", "event_id", "value")
    _finished(rows.writeStream.foreachBatch(state.newest_rows(store, "positions", ["user_id"], ["ts", "event_id"])), folder)
    return state.kept_rows(store, "positions")


@query("""WITH g AS (SELECT *, epoch_us(ts) // 1000 AS ms, lag(event_type = 'purchase') OVER own AS flushed, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER own AS gap FROM events WINDOW own AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000 OR flushed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM g),
b AS (SELECT user_id, max(ms) AS ms, arg_max(event_id, (ms, event_id)) AS tie, arg_max(value, (ms, event_id)) AS value, count(*) AS n, bool_or(event_type = 'purchase') AS flush FROM s GROUP BY user_id, s)
SELECT user_id, ms::BIGINT AS "at", tie, value, n FROM b WHERE flush OR ms + 21600000 <= (SELECT max(epoch_us(ts) // 1000) FROM events)""")
def streamed_saves(spark: SparkSession, d: str) -> DataFrame:
    """Positions saved six hours after a user's last event, or at once with a purchase, from a stream of events."""
    folder, key = shared_folder(spark, "saves"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    rows = _event_stream(spark, d).withColumn("flush", F.col("event_type") == "purchase")
    kept = state.saves(rows, "user_id", "ts", "event_id", "value", "flush", 21_600_000, "0 seconds")
    spark.conf.set(key, state.ROCKSDB)
    try:
        _finished(kept.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/out")


@query("""WITH old AS (SELECT l_orderkey AS article, l_linenumber AS revision, max(l_partkey) AS w FROM lineitem GROUP BY ALL), new AS (SELECT article, revision, w + 1 AS w FROM old WHERE article % 2 = 0),
m AS (SELECT article, revision, w * 10 AS saved, 'none' AS tag FROM old WHERE article % 2 <> 0 UNION ALL SELECT article, revision, w * 10, 'new' FROM new)
SELECT article, revision, saved, tag FROM m WHERE revision >= 2 AND revision < 5""")
def versioned_store(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as a store in two versions of its schema, merged on read: the revisions from 2 to 4."""
    folder, name, keys = shared_folder(spark, "stores"), f"revisions_{uuid.uuid4().hex}", ["article", "revision"]
    old = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("revision")).agg(F.max("l_partkey").alias("at"))
    keyed.save(old, name, keys, folder, 1)
    keyed.save(old.filter("article % 2 = 0").select(*keys, (F.col("at") + 1).alias("at"), F.lit("new").alias("tag")), name, keys, folder, 2)
    upgrades = {1: lambda df: df.withColumn("tag", F.lit("none")), 2: lambda df: df.withColumnRenamed("at", "saved").withColumn("saved", F.col("saved") * 10)}
    return keyed.load(spark, name, keys, 3, upgrades).filter("revision >= 2 and revision < 5").select("article", "revision", "saved", "tag")
