"""Substring dedup over words by greedy factors against reference blocks (operator 3).

The corpus itself is the reference, cut into blocks by content (see `_spans`): a block has all passages that hang on its anchors, so
that a document need not be matched with every block to be matched with every passage. In a block, fragments stand in the order
of their documents. An index of the block gives the first place of each run of W words; a fragment is factored
from left to right against what stands before it: a factor begins where a run of W words is known and is extended
word by word along its place of reference as far as both agree. Where a factor ends, the runs of W words that straddle
the boundary are looked up each for itself. Factors reach over at least W words by this, which makes them duplicate spans;
neighbouring ones are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import covered_windows, ordered, ranges_of, token_mask
from ._tables import table
from ._text import Rolling, chunks, returning_memory, utf8, word_bounds, word_tokens

ANCHOR_WORDS = 12


def known_windows(symbols: np.ndarray, at: np.ndarray, ord_: np.ndarray, window: int) -> np.ndarray:
    """Which windows of a block's fragments lie in a factor that a fragment of smaller order has."""
    count = np.diff(at) - window + 1
    place = ranges_of(at[:-1], count)
    rank = np.repeat(ord_, count)
    key = Rolling(symbols).slices(place, place + window)
    # The index: for each run of words its first place in the order of documents.
    order = np.lexsort((place, rank, key))
    head = np.ones(len(order), dtype=bool)
    head[1:] = key[order][1:] != key[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(head) - 1
    owner = order[np.flatnonzero(head)][number]
    known = rank[owner] < rank
    # A factor goes on while the next run of words is known at the next place of reference.
    source = place[owner]
    begins = np.ones(len(place), dtype=bool)
    begins[1:] = ~(known[1:] & known[:-1] & (np.diff(place) == 1) & (np.diff(source) == 1))
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, len(place)))
    first, length = first[known[first]], length[known[first]]
    if not len(first):
        return known
    own, other = (ranges_of(x[first], length + window - 1) for x in (place, source))
    equal = np.logical_and.reduceat(symbols[own] == symbols[other], np.cumsum(length + window - 1) - (length + window - 1))
    return known if equal.all() else spelled_out(symbols, place, rank, window)


def spelled_out(symbols: np.ndarray, place: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """As the index, with the words themselves as keys: for a block in which two runs of words share a hash."""
    least: dict[bytes, int] = {}
    keys = [symbols[p : p + window].tobytes() for p in place.tolist()]
    for x, r in zip(keys, rank.tolist(), strict=True):
        least[x] = min(r, least.get(x, r))
    return np.array([least[x] < r for x, r in zip(keys, rank.tolist(), strict=True)], dtype=bool)


def remove_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document of smaller id.

    Returns one row a document: id, n_words, n_removed (long), kept (kept words joined by one space),
    spans (array of word ranges [start, end) that went).

    Null and empty texts have no words. Rows without an id rank after all others. Rows of equal id, and
    repeats inside one document, do not remove each other. Other columns are not read.
    """
    found = covered_windows(ordered(df, id_col, text_col), word_tokens, known_windows, window, min(ANCHOR_WORDS, window))

    @returning_memory
    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            bodies = batch.column("bodies").to_pylist()
            words, removed, kept, spans = [], [], [], []
            for first, last in chunks(at):
                part, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
                start, end = word_bounds(part, own)
                cutoff = np.searchsorted(start, own)
                for d in range(last - first):
                    s, e = start[cutoff[d] : cutoff[d + 1]], end[cutoff[d] : cutoff[d + 1]]
                    gone = token_mask(len(s), bodies[first + d], window)
                    words.append(len(s))
                    removed.append(int(gone.sum()))
                    kept.append(joined_words(part, s[~gone], e[~gone]))
                    spans.append(ranges(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ord"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["ord", "n_words", "n_removed", "kept", "spans"],
            )

    out = found.mapInArrow(cut, "ord long, n_words long, n_removed long, kept binary, spans array<array<long>>")
    return out.select(F.when(F.col("ord") != F.lit((1 << 63) - 1), F.col("ord")).alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "spans")


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(start):
        return b""
    size = end - start + 1
    at = np.cumsum(size)
    step = np.ones(int(at[-1]), dtype=np.int64)
    step[0] = start[0]
    step[at[:-1]] = start[1:] - end[:-1]
    source = np.cumsum(step)[:-1]
    out = data[source]
    out[at[:-1] - 1] = 0x20
    return out.tobytes()


def ranges(flags: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_words(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
