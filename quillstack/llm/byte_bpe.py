"""Byte-level BPE without a regular expression (operator 2).

Pre-tokenisation works on arrays: every code point gets a class (letter, number, other, apostrophe that opens a
contraction, white space by what follows it), and a small automaton over the classes says where a piece begins.
Its transition functions compose associatively, so blocks of text are scanned side by side: each block
yields the function it applies to a state, a prefix scan over those gives every block its first state, and a
second pass reads off the boundaries. Pieces are merged by rank once and cached; offsets of all
tokens are kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bound_batches, table
from ._text import chunks, returning_memory, utf8

# Classes of code points; a space's class also depends on what follows.
LETTER, NUMBER, OTHER, SHORT, LONG, RUN, GLUE, LONE = range(8)
# States: FREE must start a piece; the others are inside one. TWO and ONE count a contraction's letters left.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, GLUED, ONE, TWO = range(8)
BLOCK = 128
#: Pieces whose tokens a worker keeps, and bytes of text or tokens that it works on at a time.
CACHE_PIECES, SLICE = 1 << 18, 1 << 20
LONGEST_TABLED = 48
_NONE = np.int32(1 << 30)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this code point."""
    if state in (ONE, TWO):
        return (FREE if state == ONE else ONE), False
    if kind in (SHORT, LONG) and state not in (IN_OTHERS, GLUED):
        return (ONE if kind == SHORT else TWO), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}.get(kind)
    if run is not None:
        return run, state not in (run, GLUED)
    if kind == RUN:
        return IN_SPACES, state != IN_SPACES
    return (GLUED if kind == GLUE else FREE), True


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary by class and state. Classes 8-15 are 0-7 at a text's start; 16 changes nothing."""
    to, cut = np.zeros((17, 8), dtype=np.uint8), np.zeros((17, 8), dtype=bool)
    for kind in range(8):
        for state in range(8):
            to[kind, state], cut[kind, state] = _step(state, kind)
            to[kind + 8, state], cut[kind + 8, state] = _step(FREE, kind)[0], True
    to[16] = np.arange(8)
    return to, cut


# Letters and numbers that Unicode 16.0 has and Python's 15.1 tables lack.
_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@cache
def _classes() -> np.ndarray:
    """Class of every code point; white space gets GLUE for 0x20 and LONE for the rest until the next one is known."""
    # The White_Space property of Unicode.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    for kind, ranges in ((LETTER, _LETTERS_16), (NUMBER, _NUMBERS_16)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[spaces] = LONE
    out[0x20] = GLUE
    return out


def classify(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes in context for texts lying end to end; at holds where each begins (no empty texts), and the end."""
    kind = _classes()[points]
    n = len(points)
    after = np.full(n + 2, 0x20, dtype=points.dtype)
    after[:n] = points
    one, two = after[1 : n + 1].copy(), after[2:].copy()
    last = at[1:] - 1
    one[last] = 0x20
    two[last] = 0x20
    two[np.maximum(last - 1, at[:-1])] = 0x20
    space = (kind == GLUE) | (kind == LONE)
    kind[space & (_classes()[one] >= GLUE)] = RUN
    quote = np.flatnonzero(points == ord("'"))
    a, b = one[quote], two[quote]
    kind[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    kind[quote[pair]] = LONG
    kind[at[:-1]] += 8
    return kind


def boundaries(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin, by scanning blocks side by side."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    to, cut = _automaton()
    rows = -(-n // BLOCK)
    kind = np.full(rows * BLOCK, 16, dtype=np.uint8)
    kind[:n] = classify(points, at)
    kind = np.ascontiguousarray(kind.reshape(rows, BLOCK).T)
    flat = to.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in kind:
        whole = flat[(column.astype(np.intp) << 3)[:, None] + whole]
    step = 1
    while step < rows:  # prefix scan: whole[i] becomes the function of blocks 0..i
        later = whole.copy()
        later[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole, step = later, 2 * step
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = whole[:-1, FREE]
    begins = np.empty((BLOCK, rows), dtype=bool)
    cuts = cut.ravel()
    for j, column in enumerate(kind):
        where = (column.astype(np.intp) << 3) + state
        begins[j] = cuts[where]
        state = flat[where]
    return np.flatnonzero(begins.T.ravel()[:n])


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}


class TokenBytes:
    """The bytes of all tokens end to end, for decoding."""

    def __init__(self, rank: dict[bytes, int]):
        token = {r: t for t, r in rank.items()}
        size = max(token) + 1
        self.length = np.array([len(token.get(r, b"")) for r in range(size)], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.frombuffer(b"".join(token.get(r, b"") for r in range(size)), dtype=np.uint8)


class Vocabulary:
    """Ranks of byte strings, the table of mergeable pairs, and the cache of merged pieces."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.length = TokenBytes(self.rank).length
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                left, right = self.rank.get(t[:i]), self.rank.get(t[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = r
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.store, self.used = np.zeros(1 << 18, dtype=np.int32), 0

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Merges short pieces side by side: each round every row merges its leftmost pair of least rank."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.array([len(p) for p in pieces])
        rows = np.zeros((n, width + 1), dtype=np.int32)
        inside = np.arange(width + 1) < size[:, None]
        rows[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = np.full((n, width), _NONE, dtype=np.int32)
        pair = inside[:, 1:]
        ranks[pair] = self.pair_rank(rows[:, :-1][pair], rows[:, 1:][pair])
        out, name = [None] * n, np.arange(n)
        while len(name):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(name)), at]
            done = best == _NONE
            for i in np.flatnonzero(done):
                out[name[i]] = rows[i, : size[i]].copy()
            go = ~done
            name, size, rows, ranks, at, best = name[go], size[go] - 1, rows[go], ranks[go], at[go], best[go]
            if not len(name):
                break
            i, column = np.arange(len(name)), np.arange(rows.shape[1])
            rows[i, at] = best
            rows = np.take_along_axis(rows, np.minimum(column + (column > at[:, None]), rows.shape[1] - 1), axis=1)
            column = np.arange(ranks.shape[1])
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = _NONE
            right = at + 1 < size
            ranks[i[~right], at[~right]] = _NONE
            ranks[i[right], at[right]] = self.pair_rank(rows[i[right], at[right]], rows[i[right], at[right] + 1])
            left = at > 0
            ranks[i[left], at[left] - 1] = self.pair_rank(rows[i[left], at[left] - 1], rows[i[left], at[left]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Merges one long piece with a heap of pairs over a linked list."""
        parts = [int(x) for x in self.single[np.frombuffer(piece, dtype=np.uint8)]]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True)) if not hasattr(self, "_pairs") else self._pairs
        self._pairs = pairs
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pairs.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := pairs.get(parts[a] << 20 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return np.array([p for p in parts if p >= 0], dtype=np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Merges pieces not seen before and keeps their tokens."""
        merged: dict[bytes, np.ndarray] = {}
        short = []
        for p in pieces:
            if (r := self.rank.get(p)) is not None:
                merged[p] = np.array([r], dtype=np.int32)
            elif len(p) > LONGEST_TABLED:
                merged[p] = self.merge_long(p)
            else:
                short.append(p)
        short.sort(key=len)
        for lo in range(0, len(short), 4096):
            merged |= zip(short[lo : lo + 4096], self.merge_many(short[lo : lo + 4096]), strict=True)
        for p, ids in merged.items():
            k = len(self.known)
            if k == len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * k), np.resize(self.counts, 2 * k)
            while self.used + len(ids) > len(self.store):
                self.store = np.resize(self.store, 2 * len(self.store))
            self.starts[k], self.counts[k] = self.used, len(ids)
            self.store[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known[p] = k

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of UTF-8 texts lying end to end, and the number of tokens of each."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        full = np.flatnonzero(np.diff(at))
        starts = np.append(np.searchsorted(lead, at[:-1][full]), len(points))
        begin = lead[boundaries(points, starts)] if len(points) else np.zeros(0, dtype=np.int64)
        cut = begin.tolist()
        pieces = [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)], strict=False)]
        unseen = {p for p in pieces if p not in self.known}
        if unseen:
            if len(self.known) + len(unseen) > CACHE_PIECES:
                self.forget()
                unseen = set(pieces)
            self.learn(sorted(unseen))
        known = self.known
        which = np.array([known[p] for p in pieces], dtype=np.int64)
        count = self.counts[which]
        ids = self.store[spread(self.starts[which], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[np.searchsorted(begin, at)])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] of them, for all i in order."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(ranks(path))


@returning_memory
def _encode(batches, path: str | None):
    vocab = vocabulary(path or default_path())
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for first, last in chunks(at, SLICE):
            own = at[first : last + 1] - at[first]
            ids, counts = vocab.encode(data[at[first] : at[last]], own)
            ends = np.cumsum(np.concatenate(([0], counts))).astype(np.int32)
            length = vocab.length[ids]
            offset = np.cumsum(length) - length - np.repeat(own[:-1], counts)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (ids, offset)]
            rows = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns - 1)), *lists], names=[*rows.schema.names[:-1], "ids", "offsets"])


@returning_memory
def _decode(batches, path: str | None):
    tokens = token_bytes(path or default_path())
    for batch in batches:
        bounds = np.asarray(batch.column("ids").offsets).astype(np.int64)
        for first, last in chunks(bounds, SLICE // 4):
            rows = batch.slice(first, last - first)
            lists, offsets = rows.column("ids"), rows.column("offsets")
            at = bounds[first : last + 1]
            ids = np.asarray(lists.values)[at[0] : at[-1]]
            offset = np.asarray(offsets.values)[offsets.offsets[0].as_py() : offsets.offsets[-1].as_py()].astype(np.int64)
            at = at - at[0]
            length = tokens.length[ids]
            total = np.concatenate(([0], np.cumsum(length)))
            size = np.diff(total[at])
            where = offset + np.repeat(total[at[:-1]], np.diff(at))
            out = np.empty(int(total[-1]), dtype=np.uint8)
            for lo in range(0, len(ids), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                out[spread(where[part], length[part])] = tokens.flat[spread(tokens.offset[ids[part]], length[part])]
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns - 2)), lists, offsets, texts], names=[*rows.schema.names, "decoded"])


@returning_memory
def _round_trip(batches, path: str | None):
    yield from _decode.__wrapped__(_encode.__wrapped__(batches, path), path)


def _over_texts(df: DataFrame, task, path: str | None, text_col: str, keep: tuple[str, ...], more: str) -> DataFrame:
    bound_batches(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(partial(task, path=path), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more]))


def encode_texts(df: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then ids array<int> and offsets array<int> (first byte of each token in its text).

    path names a rank file in tiktoken's form that every executor can open; without one each executor looks up the
    public 50k file for itself. A null text counts as empty and has no tokens; special tokens are never made. Columns other
    than `keep` are dropped, so they cannot clash.
    """
    return _over_texts(df, _encode, path, text_col, keep, "ids array<int>, offsets array<int>")


def decode_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded (binary), the bytes of ids laid out by offsets; the two must be df's last columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded binary"
    return df.mapInArrow(partial(_decode, path=path), schema)


def round_trip(df: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """decode_ids(encode_texts(df)) in one worker, so that a task holds one vocabulary."""
    return _over_texts(df, _round_trip, path, text_col, keep, "ids array<int>, offsets array<int>, decoded binary")


def digests(decoded: DataFrame, *keep: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")), "doc_id")
