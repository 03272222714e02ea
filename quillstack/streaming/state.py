"""Keyed state over streams: saves after a pause with a flush, newest rows per key in a store, and downgrades that never go back.

The two processors need Spark's RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Saves(StatefulProcessor):
    """One pending value a key, with the timer that saves it."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "at long, tie long, value double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.pending.get() if self.pending.exists() else None
        if now:
            self.handle.deleteTimer(now[0] + self.gap)
        batch = pd.concat(list(rows)).sort_values(["at", "tie"])
        for at, tie, value, flush in zip(*(batch[c].tolist() for c in ("at", "tie", "value", "flush")), strict=True):
            if now and at + self.gap <= now[0]:
                continue  # of a burst that was saved before
            if now and at >= now[0] + self.gap:
                out.append(now)
                now = None
            if not now:
                now = (at, tie, value, 1)
            elif (at, tie) >= now[:2]:
                now = (at, tie, value, now[3] + 1)
            else:  # late: it belongs to the burst, but is not its newest
                now = (*now[:3], now[3] + 1)
            if flush:
                out.append(now)
                now = None
        if now:
            self.pending.update(now)
            self.handle.registerTimer(now[0] + self.gap)
        else:
            self.pending.clear()
        yield self._saved(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self.pending.get()] if self.pending.exists() else []
        self.pending.clear()
        yield self._saved(key, out)

    def _saved(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["key", "at", "tie", "value", "n"]).astype({"at": "int64", "tie": "int64", "value": "float64", "n": "int64"})

    def close(self) -> None:
        pass


def saves(events: DataFrame, key: str, at: str, tie: str, value: str, flush: str, gap_ms: int, late: str) -> DataFrame:
    """(key, at, tie, value, n) of a stream: the newest value of each burst of events without a pause of gap_ms, once the watermark has passed
    the pause, or at once where `flush` is true. n events were in the burst.

    The state is one row a key, and none once it is saved. Events behind the watermark, `late` behind the newest, are dropped, and so are
    those that come a whole pause behind the pending one.
    at is a timestamp, key a long.
    """
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("time"), F.unix_millis(at).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"), F.coalesce(F.col(flush), F.lit(False)).alias("flush"))
    kept = rows.groupBy("key").transformWithStateInPandas(_Saves(gap_ms), "key long, at long, tie long, value double, n long", "append", "eventTime")
    return kept.withColumnRenamed("key", key)


class _Guard(StatefulProcessor):
    """The pass that is under way, and the kinds that were downgraded for good."""

    def __init__(self, tolerance: float, size: int, kinds: tuple[str, ...]):
        self.tolerance, self.size, self.kinds = tolerance, size, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "number long, sampled int, worst string")
        self.gone = handle.getMapState("gone", "kind string", "drift double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, sampled, worst = self.current.get() if self.current.exists() else (None, 0, "")
        worst = {k: float(v) for k, v in (x.split("=") for x in worst.split(";") if x)}
        gone = {k[0] for k in self.gone.keys()}
        out = []

        def end():
            for kind in sorted(worst):
                self.gone.updateValue((kind,), (worst[kind],))
                gone.add(kind)
                out.append((key[0], number, kind, worst[kind]))
            worst.clear()

        batch = pd.concat(list(rows)).sort_values(["number", "ord"])
        for pass_, kind, drift, last in zip(*(batch[c].tolist() for c in ("number", "kind", "drift", "last")), strict=True):
            if number is not None and pass_ < number:
                continue  # a row of a pass that is over
            if pass_ != number:
                end()
                number, sampled = pass_, 0
            if sampled < self.size and kind in self.kinds and kind not in gone:
                sampled += 1
                if drift > self.tolerance:
                    worst[kind] = max(drift, worst.get(kind, 0.0))
            if last:
                end()
        self.current.update((number, sampled, ";".join(f"{k}={v!r}" for k, v in sorted(worst.items()))))
        yield pd.DataFrame(out, columns=["run", "number", "kind", "drift"]).astype({"number": "int64", "drift": "float64"})

    def close(self) -> None:
        pass


def downgrades(samples: DataFrame, run: str, tolerance: float, size: int = 5, kinds: tuple[str, ...] = ("paragraph", "heading")) -> DataFrame:
    """(run, pass, kind, drift) of a stream of samples (run, pass, ord, kind, predicted, actual, last): kinds whose height drifts by more than
    the tolerance in the first `size` samples of a pass that count, told once, at the end of the pass.

    A downgraded kind is not sampled again and never comes back. A pass ends with its row `last` or with the first one of a later pass;
    rows of earlier passes are left out. The state is one row a run and one for each kind. run is a long.
    """
    drift = F.abs(F.col("actual") - F.col("predicted")).cast("double")
    rows = samples.select(F.col(run).alias("run"), F.col("pass").cast("long").alias("number"), F.col("ord").cast("long").alias("ord"), "kind", F.coalesce(drift, F.lit(0.0)).alias("drift"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("run").transformWithStateInPandas(_Guard(tolerance, size, kinds), "run long, number long, kind string, drift double", "update", "none").withColumnsRenamed({"run": run, "number": "pass"})


def newest_rows(store: Store, name: str, keys: list[str], order: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key (by `order`) in the store's tables `name`-0 to `name`-(buckets - 1).

    Keys are dealt to buckets, and a batch rewrites only buckets that it touches, all in one state, which carries the batch's number: a
    batch that is run again changes nothing, one that fails leaves the state before it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        done = store.mark(name)
        if done is not None and done >= epoch:
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.withColumn("_bucket", bucket).persist()
        try:
            now, changes = store.tables(), {}
            for b in [r[0] for r in batch.select("_bucket").distinct().collect()]:  # numbers below `buckets`
                rows = batch.filter(F.col("_bucket") == b).drop("_bucket")
                rows = rows.unionByName(now[f"{name}-{b}"]) if f"{name}-{b}" in now else rows
                best = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("b"))
                changes[f"{name}-{b}"] = best.select("b.*")
            store.apply(changes, marks={name: epoch})
        finally:
            batch.unpersist()

    return write


def kept_rows(store: Store, name: str) -> DataFrame | None:
    """All rows that `newest_rows` keeps; None before the first."""
    own = [df for table, df in store.tables().items() if table.rpartition("-")[0] == name]
    out = own[0] if own else None
    for df in own[1:]:
        out = out.unionByName(df)
    return out
