"""Dedup of repeated byte strings by prefix-free parsing (operator 10).

Rolling-hash triggers cut each document into phrases that overlap by one string of W bytes, so that no phrase is a
prefix of another and each W-byte string lies in one phrase. Repeated phrases are settled by name, which is what makes
repetitive text cheap (see `_spans`). For the rest, each block builds the dictionary of its distinct phrases, the parse (which phrase
each document has where) and the suffix array of the dictionary: its suffixes sorted by their first W bytes, eight at a
time, only those still tied going on. Suffixes are then put in corpus order by the smallest document of the parse that
has their phrase, and all but the first of equal ones are covered.

A W-byte string never leaves its phrase, so only the first W bytes of a suffix and the parse's documents decide, not what
phrases follow: the parse is read as lists of occurrences and needs no suffix array of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import covered_windows, ordered, ranges_of, token_mask
from ._tables import table
from ._text import returning_memory, utf8
from .substring_dedup import ranges

TRIGGER_BYTES = 26


def raw_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def suffix_groups(text: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of the `length` bytes that begin there, and for each place the number of its group of equal ones."""
    order = np.arange(len(place))
    group = np.zeros(len(place), dtype=np.int64)
    tied = np.arange(len(place))  # positions in order, not yet told apart
    for depth in range(0, length, 8):
        own = place[order[tied]] + depth
        key = np.zeros(len(own), dtype=np.uint64)
        for i in range(min(8, length - depth)):
            key = (key << np.uint64(8)) | text[own + i]
        sub = np.lexsort((key, group[tied]))
        order[tied] = order[tied][sub]
        key, old = key[sub], group[tied]
        fresh = np.zeros(len(tied), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        # A group is named by the position at which it begins.
        fresh[:1] = True
        group[tied] = np.repeat(tied[fresh], np.diff(np.append(np.flatnonzero(fresh), len(tied))))
        size = np.bincount(group, minlength=len(place) + 1)[group[tied]]
        tied = tied[size > 1]
        if not len(tied):
            break
    back = np.empty(len(place), dtype=np.int64)
    back[order] = group
    return order, back


def known_strings(symbols: np.ndarray, at: np.ndarray, ord_: np.ndarray, window: int) -> np.ndarray:
    """Which `window`-byte strings of a block's fragments stand in a fragment of smaller order."""
    raw = symbols.tobytes()
    names: dict[bytes, int] = {}
    parse = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.int64)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, parse, ord_)
    dictionary = np.frombuffer(b"".join(names), dtype=np.uint8)
    size = np.array([len(x) for x in names], dtype=np.int64)
    begin = np.cumsum(size) - size
    count = size - window + 1
    place = ranges_of(begin, count)
    _, group = suffix_groups(dictionary, place, window)
    owner = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(owner, group, np.repeat(least, count))
    at_word = np.cumsum(count) - count
    return owner[group][ranges_of(at_word[parse], count[parse])] < np.repeat(ord_, count[parse])


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts in a document of smaller id.

    Returns one row a document: id, n_bytes, n_removed, n_spans (long), kept (the remaining bytes, which
    need not be valid UTF-8), spans (array of byte ranges [start, end) that went).

    Null texts count as empty. Rows without an id rank after all others. Rows of equal id, and repeats
    inside one document, do not remove each other. The columns `carry` come along in a struct `row`, others
    are not read. With whole_characters a character stays unless all its bytes go, so that kept is valid UTF-8.
    """
    found = covered_windows(ordered(df, id_col, text_col, carry), raw_bytes, known_strings, length, min(TRIGGER_BYTES, length))

    @returning_memory
    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            size, removed, kept, spans = [], [], [], []
            for d, body in enumerate(batch.column("bodies").to_pylist()):
                own = data[at[d] : at[d + 1]]
                size.append(len(own))
                if body:
                    gone = token_mask(len(own), body, length)
                    if whole_characters:
                        first = np.flatnonzero((own & 0xC0) != 0x80)
                        gone = np.repeat(np.minimum.reduceat(gone, first), np.diff(np.append(first, len(own))))
                    removed.append(int(gone.sum()))
                    kept.append(own[~gone].tobytes())
                    spans.append(ranges(gone))
                else:
                    removed.append(0)
                    kept.append(own.tobytes())
                    spans.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("ord"), batch.column("row"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["ord", "row", "n_bytes", "n_removed", "kept", "spans"],
            )

    kind = found.schema["row"].dataType.simpleString()
    out = found.mapInArrow(cut, f"ord long, row {kind}, n_bytes long, n_removed long, kept binary, spans array<array<long>>")
    return out.select(F.when(F.col("ord") != F.lit((1 << 63) - 1), F.col("ord")).alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept", "spans", "row")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
