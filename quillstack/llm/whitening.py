"""Whitening of embeddings by a tall-skinny QR decomposition (operator 13).

1. Entries become integers, so sums are exact and rows are centred by them: x - S/n is (n*x - S) / n with an exact numerator.
2. Each task keeps an upper triangular R of its rows: it stacks a batch below R and decomposes again. Rs are merged FAN at a
   time, level by level, until one is left. Its singular values s and right vectors are those of the whole centred matrix: the
   components, with variances s*s/n. The covariance matrix is never formed, so its squared condition number is never met.
3. Each row is projected on the components and divided by the square root of their variance. How far the covariance of the
   result is from the identity is measured over all rows in the same way: a count, a mean and a centred product for each
   task, merged as a tree.

A task holds a batch and a square of the dimension; the driver gets the sums, the components and the error, whose size the dimension
bounds, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import shared_checkpoint, table

COMPONENTS, SCALE, SHIFT, FAN = 32, 64, 1_000_000, 16
LARGEST = 2.0**46


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of long) of the rows whose vector is there and has finite entries only.

    An entry is finite if it is neither null, NaN nor infinite; nor may it reach LARGEST, beyond which a double does not hold
    its integer exactly. Vectors without entries are dropped too.
    """
    c = F.col(vector_col)
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: F.coalesce(F.abs(e.cast("double")) < LARGEST, F.lit(False)))
    # The condition stands inside, as Spark may move a filter on the result below this one.
    whole = F.transform(F.when(good, c), lambda e: F.floor(e.cast("double") * SCALE) + SHIFT)
    return df.select(F.col(id_col).alias("id"), whole.alias("x")).filter("x is not null")


def _matrix(batch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, its numerator n*x - S exact: split into whole means and rests, so that products stay small."""
    mean, rest = sums // n, sums % n
    return (x - mean).astype(np.float64) - rest / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n*x - S)^2 for each row, exact; None where it does not fit into a long."""
    mean, rest = sums // n, sums % n
    off = x - mean
    if n * (int(np.abs(off).max(initial=0)) + 1) < np.sqrt(2.0**62 / x.shape[1]):
        y = n * off - rest
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]
    return [d if d < 2**63 else None for d in exact]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def tree_merged(parts: DataFrame, merge: Callable) -> list[np.ndarray] | None:
    """One (part, body) of many, merged FAN at a time in the cluster; merge takes and returns lists of arrays."""

    def merged(rows: pa.Table) -> pa.Table:
        bodies = [_arrays(b) for b in rows.column("body").to_pylist()]
        return pa.table({"part": pa.array([rows.column("up")[0].as_py()], pa.int64()), "body": pa.array([_bytes(merge(bodies))], pa.binary())})

    parts = shared_checkpoint(parts)
    while True:
        most = parts.agg(F.max("part")).head()[0]
        if most is None:
            return None
        if most == 0:
            return _arrays(parts.head().body)
        parts = shared_checkpoint(parts.withColumn("up", F.floor(F.col("part") / FAN)).groupBy("up").applyInArrow(merged, "part long, body binary"))


def _bytes(arrays: list[np.ndarray]) -> bytes:
    """Matrices of doubles one after the other, each behind its shape."""
    return b"".join(np.array(np.atleast_2d(a).shape, dtype=np.int64).tobytes() + np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays)


def _arrays(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        shape = np.frombuffer(body, dtype=np.int64, count=2, offset=at)
        size = int(shape.prod())
        out.append(np.frombuffer(body, dtype=np.float64, count=size, offset=at + 16).reshape(shape))
        at += 16 + 8 * size
    return out


def merged_triangles(bodies: list) -> list[np.ndarray]:
    return [triangle(np.concatenate([b[0] for b in bodies]))]


def merged_moments(bodies: list) -> list[np.ndarray]:
    """(count, mean, centred product) of several sets of rows from those of each."""
    (n, mean, product), *rest = bodies
    for m, other, more in rest:
        apart = other - mean
        product = product + more + apart.T @ apart * float(n[0, 0] * m[0, 0] / (n[0, 0] + m[0, 0]))
        mean = mean + apart * float(m[0, 0] / (n[0, 0] + m[0, 0]))
        n = n + m
    return [n, mean, product]


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _one(body: bytes):
    return pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([body], pa.binary())], names=["part", "body"])


def _triangles(batches, n: int, sums: np.ndarray):
    r = None
    for batch in batches:
        if batch.num_rows:
            y = centred(_matrix(batch), n, sums)
            r = triangle(y if r is None else np.concatenate((r, y)))
    if r is not None:
        yield _one(_bytes([r]))


def _moments(batches, n: int, sums: np.ndarray, axes: np.ndarray):
    """axes: a column for each component, already divided by the root of its variance."""
    now = None
    for batch in batches:
        if batch.num_rows:
            w = centred(_matrix(batch), n, sums) @ axes
            mean = w.mean(axis=0, keepdims=True)
            own = [np.array([[float(len(w))]]), mean, (w - mean).T @ (w - mean)]
            now = own if now is None else merged_moments([now, own])
    if now is not None:
        yield _one(_bytes(now))


def _whitened(batches, n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    k = axes.shape[1]
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            x = _matrix(part)
            w = centred(x, n, sums) @ axes
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                part.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (int, from 1), n, deviation (long), whitened, explained, identity_error (double): a row for each vector
    and component.

    Vectors that are null or empty or hold a null, NaN or infinite entry are dropped; so are those that have not the usual
    number of entries (the most frequent one, the larger one on ties). Repeated rows count as often as they are there, a null
    id stays null. A direction in which the vectors do not vary has no component: there are at most as many components as
    dimensions, and none for a single vector or an empty table, which give no rows. deviation is null where it exceeds a long.
    Other columns are not read.
    """
    rows = valid_vectors(df, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    named = [F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    nothing = df.sparkSession.createDataFrame([], out).select(*named)
    if size is None:
        return nothing
    n, dimension = int(size["count"]), int(size["size"])
    rows = rows.filter(F.size("x") == dimension)
    # As many rows as the vectors have entries.
    totals = rows.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total")).collect()
    sums = np.zeros(dimension, dtype=np.int64)
    for r in totals:
        sums[r["at"]] = r["total"]
    x = rows.select("x")
    root = tree_merged(x.mapInArrow(partial(_triangles, n=n, sums=sums), "part long, body binary"), merged_triangles)
    _, s, right = np.linalg.svd(root[0], full_matrices=False)
    varied = s > s.max(initial=0) * max(n, dimension) * np.finfo(np.float64).eps if s.max(initial=0) > 0 else np.zeros(len(s), dtype=bool)
    keep = np.flatnonzero(varied)[:components]
    if not len(keep):
        return nothing
    variance = s * s / n
    axes = (right[keep] / np.sqrt(variance[keep])[:, None]).T
    n_, _, product = tree_merged(x.mapInArrow(partial(_moments, n=n, sums=sums, axes=axes), "part long, body binary"), merged_moments)
    error = float(np.abs(product / n_[0, 0] - np.eye(len(keep))).max())
    return rows.mapInArrow(partial(_whitened, n=n, sums=sums, axes=axes, explained=variance[keep] / variance.sum(), error=error), out).select(*named)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
