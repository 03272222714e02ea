"""Document quality from a linear-chain conditional random field over lines (operator 9).

Each line is good or bad; its features are measures of itself and of the lines before and after it. A document's
label is the label of all its lines in training. Forward and backward sums give each line's probability of
being good, and their mean, weighted by line length, is the document's raw score. A logistic curve fitted on the
training documents turns that into a probability.

Training uses at most SAMPLE labelled documents, those of smallest id hash, cut into chains of at most
CHAIN lines; scoring covers every line of every document.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from ._text import BYTE_SYMBOL, IS_SPACE, Rolling, chunks, mix, utf8, word_bounds

SAMPLE, CHAIN, ROUNDS, RATE, PENALTY = 3000, 48, 120, 0.08, 0.02
#: Own measures of a line; those of its neighbours follow, then the constant.
OWN = 12
_KIND = np.zeros((7, 256), dtype=bool)
_KIND[0, [ord(c) for c in "#*$%&<>"]] = True
_KIND[1, ord("|")] = True
_KIND[2, ord("!")] = True
_KIND[3, 65:91] = True
_KIND[4, 48:58] = True
_KIND[5, [ord(c) for c in ".,;:?"]] = True
_KIND[6] = ~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of the lines that have a word, and where each document's lines begin."""
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate((at, breaks + 1)))
    begin, stop = edges[:-1], edges[1:]
    start, end = word_bounds(data, at)
    word_at = np.searchsorted(start, edges)
    full = np.diff(word_at) > 0
    begin, stop, first, last = begin[full], stop[full], word_at[:-1][full], word_at[1:][full]
    line_at = np.searchsorted(begin, at)
    if not len(begin):
        return np.zeros((0, 3 * OWN + 1), dtype=np.float32), np.zeros(0, dtype=np.int64), line_at
    totals = np.zeros((7, len(data) + 1), dtype=np.int32)
    np.cumsum(_KIND[:, data], axis=1, out=totals[:, 1:])
    n = (totals[:, stop] - totals[:, begin]).astype(np.float64)
    words = (last - first).astype(np.float64)
    chars = np.maximum(n[6], 1)
    hashes = Rolling(BYTE_SYMBOL[data]).slices(start, end)
    line = np.repeat(np.arange(len(begin)), last - first)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    mixed = mix(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed, kind="stable")
    fresh = np.ones(len(mixed), dtype=bool)
    fresh[1:] = mixed[order][1:] != mixed[order][:-1]
    distinct = np.bincount(line[order][fresh], minlength=len(begin))
    text = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64) + np.uint64(3)), first)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(line_at))
    named = mix(text ^ (doc.astype(np.uint64) << np.uint64(40)))
    _, where = np.unique(named, return_index=True)
    again = np.ones(len(begin))
    again[where] = 0
    own = np.stack([
        n[0] / words, n[1] / words, n[2] / words, n[3] / chars, n[4] / chars, n[5] / words,
        n[6] / words, 1 - distinct / words, np.add.reduceat(echo.astype(np.float64), first) / words,
        again, np.log1p(words), (words < 4).astype(np.float64),
    ], axis=1)
    own = np.minimum(own, 20).astype(np.float32)
    out = np.zeros((len(begin), 3 * OWN + 1), dtype=np.float32)
    out[:, :OWN] = own
    inner = np.ones(len(begin), dtype=bool)
    inner[line_at[:-1][np.diff(line_at) > 0]] = False
    out[1:, OWN : 2 * OWN] = own[:-1] * inner[1:, None]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:] * inner[1:, None]
    out[:, -1] = 1
    return out, (stop - begin).astype(np.int64), line_at


def marginals(score: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(good) of each step of many chains side by side: score (steps, chains) for good over bad, edge (2, 2)."""
    steps, chains = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    ahead, back = np.zeros((steps, chains, 2)), np.zeros((steps, chains, 2))
    ahead[0] = emit[0]
    for t in range(1, steps):
        ahead[t] = emit[t] + np.logaddexp(ahead[t - 1][:, :1] + edge[0], ahead[t - 1][:, 1:] + edge[1])
        ahead[t] -= ahead[t].max(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        after = emit[t + 1] + back[t + 1]
        back[t] = np.logaddexp(after[:, :1] + edge[:, 0], after[:, 1:] + edge[:, 1])
        back[t] -= back[t].max(axis=1, keepdims=True)
    both = ahead + back
    return 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -60, 60))), ahead, back, emit


def train(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, transition scores, and the means and scales of the features, by gradient steps on the likelihood."""
    flat = np.concatenate(docs)
    mean, scale = flat.mean(axis=0), flat.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    chains = [(d[i : i + CHAIN], y) for d, y in zip(docs, labels, strict=True) for i in range(0, len(d), CHAIN)]
    size = np.array([len(c) for c, _ in chains])
    groups = []
    for n in range(1, CHAIN + 1):  # chains of one length are worked side by side
        own = [chains[i] for i in np.flatnonzero(size == n)]
        if own:
            groups.append((np.stack([(c - mean) / scale for c, _ in own], axis=1).astype(np.float64), np.array([y for _, y in own], dtype=np.float64)))
    w, edge = np.zeros(flat.shape[1]), np.zeros((2, 2))
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, edge)]
    for step in range(1, ROUNDS + 1):
        dw, de = -PENALTY * w * len(chains), -PENALTY * edge * len(chains)
        for x, y in groups:
            p, ahead, back, emit = marginals(x @ w, edge)
            dw += np.tensordot(y[None, :] - p, x, axes=([0, 1], [0, 1]))
            for t in range(len(x) - 1):
                pair = ahead[t][:, :, None] + edge + (emit[t + 1] + back[t + 1])[:, None, :]
                pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
                de -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                de[1, 1] += y.sum()
                de[0, 0] += len(y) - y.sum()
        for value, slope, (m, v) in zip((w, edge), (dw / len(chains), de / len(chains)), moment, strict=True):
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            v += 0.01 * slope**2
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, edge, mean, scale


def chain_good(score: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """marginals() of one chain, as log odds along plain floats."""
    a, b, c, d = (float(np.exp(x)) for x in (edge[1, 1], edge[0, 1], edge[1, 0], edge[0, 0]))
    s = np.exp(np.clip(score, -30, 30)).tolist()
    n = len(s)
    ahead, x = [0.0] * n, 0.0
    for t in range(n):  # odds of good over bad from the lines before, this one included
        x = s[t] if t == 0 else s[t] * (x * a + b) / (x * c + d)
        ahead[t] = x
    back, y = [1.0] * n, 1.0
    for t in range(n - 2, -1, -1):
        z = s[t + 1] * y
        y = (z * a + c) / (z * b + d)
        back[t] = y
    odds = np.array(ahead) * np.array(back)
    return odds / (1 + odds)


def document_scores(data: np.ndarray, at: np.ndarray, model: dict) -> np.ndarray:
    """Length-weighted mean of line probabilities; a text without words is scored as one line without features."""
    x, size, line_at = line_features(data, at)
    w = model["w"] / model["scale"]
    score = x @ w - float(model["mean"] @ w)
    blank = np.zeros(len(w))
    blank[-1] = 1
    empty = float(chain_good(np.array([blank @ w - model["mean"] @ w]), model["edge"])[0])
    out = np.full(len(at) - 1, empty)
    for d in range(len(at) - 1):
        a, b = line_at[d], line_at[d + 1]
        if b > a:
            out[d] = np.average(chain_good(score[a:b], model["edge"]), weights=size[a:b])
    return out


def calibrated(raw: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    z = np.log(np.clip(raw, 1e-9, 1) / np.clip(1 - raw, 1e-9, 1))
    return 1 / (1 + np.exp(-np.clip(curve[0] * z + curve[1], -30, 30)))


def _fit_curve(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    z = np.log(np.clip(raw, 1e-9, 1) / np.clip(1 - raw, 1e-9, 1))
    x = np.stack([z, np.ones_like(z)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.linalg.solve(h, x.T @ (labels - p) - 1e-3 * b)
    return float(max(b[0], 1e-3)), float(b[1])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _featured(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for first, last in chunks(at):
            x, size, line_at = line_features(data[at[first] : at[last]], at[first : last + 1] - at[first])
            bodies = [x[a:b].tobytes() for a, b in zip(line_at[:-1], line_at[1:], strict=True)]
            sizes = [size[a:b].tobytes() for a, b in zip(line_at[:-1], line_at[1:], strict=True)]
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(bodies, pa.binary()), pa.array(sizes, pa.binary())], names=["quality", "x", "size"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """A model from at most `sample` labelled documents outside the held-out third; a null label is none."""
    truth = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = truth.orderBy(F.xxhash64("id"), "id").limit(sample)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most `sample` ids.
    rows = docs.join(F.broadcast(chosen), "id").select("quality", "text").mapInArrow(_featured, "quality int, x binary, size binary").collect()
    shape = 3 * OWN + 1
    used = [(np.frombuffer(r.x, dtype=np.float32).reshape(-1, shape), r.quality, np.frombuffer(r.size, dtype=np.int64)) for r in rows if len(r.x)]
    if not used or len({y for _, y, _ in used}) < 2:
        good = float(np.mean([y for _, y, _ in used])) if used else 0.5
        return {"w": np.zeros(shape), "edge": np.zeros((2, 2)), "mean": np.zeros(shape), "scale": np.ones(shape), "curve": (1e-3, float(np.log((good + 0.01) / (1.01 - good))))}
    w, edge, mean, scale = train([x for x, _, _ in used], np.array([y for _, y, _ in used]))
    model = {"w": w, "edge": edge, "mean": mean, "scale": scale}
    raw = np.array([np.average(chain_good((x - mean) / scale @ w, edge), weights=size) for x, _, size in used])
    model["curve"] = _fit_curve(raw, np.array([y for _, y, _ in used], dtype=np.float64))
    return model


def _score(batches, model: dict):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        parts = [np.zeros(0)]
        for first, last in chunks(at):
            parts.append(document_scores(data[at[first] : at[last]], at[first : last + 1] - at[first], model))
        score = calibrated(np.concatenate(parts), model["curve"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], names=["id", "score"])


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, held_out, score (0 to 1, higher is better), predicted (score >= 0.5).

    Learns from labels of ids whose crc32 of the decimal id, modulo 3, is not 1; nothing but the text is an input.
    Null texts count as empty. Rows without an id are scored and not held out. With labels of one kind only,
    every score is their share of good ones. Other columns are not read.
    """
    model = fit(df, labels, id_col, text_col, sample)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(partial(_score, model=model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
