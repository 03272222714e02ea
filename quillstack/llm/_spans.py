"""Finding every window of W symbols that also starts in a document of smaller order.

The frame that substring dedup over words (op 3) and over bytes (op 10) share: how texts are cut and dealt to tasks.
What is done inside a block is each operator's own.

1. Parse. A window's trigger is the least rolling K-gram hash inside it (leftmost on ties). Equal
   windows have equal triggers wherever they stand. Consecutive windows with one trigger form a
   phrase. Its text, the window that ends it included, or an end marker where the text ends, names it: no phrase
   is a proper prefix of another, as the same text would have ended there too.
2. Phrases are dealt to buckets by trigger hash. A phrase whose text is already in a
   document of smaller order is covered whole. A trigger with several different phrase texts is in
   doubt: the ends of repeats lie there.
3. Blocks. The symbols of phrases in doubt go to the block of their trigger, where the operator compares them symbol by
   symbol: `Resolve` says which windows stand in a fragment of smaller order.
4. A trigger with more than HEAVY fragments in one batch would gather in one block what a third of all documents
   say. Its windows go on one by one, dealt by their own hash, and so do those windows of its block that are still first there.

Everything a task holds is bounded: one chunk of text when parsing, one bucket afterwards. Before each
shuffle a batch keeps one owner a phrase or window and settles the rest itself, so that a passage
found in a third of all documents sends one row a batch, not one a document.

A phrase is known by 104 bits of hashes and a window of step 4 by 96, so that even 10**13 of them make no false match (about
one chance in a thousand); blocks compare symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches, shared_checkpoint, text_bytes
from ._text import BYTE_SYMBOL, Rolling, mix, returning_memory, sliding_min, utf8

#: Symbols hashed at a time, and bytes of text after which a batch sends what it has found.
CHUNK, FLUSH_BYTES = 1 << 17, 6 << 20
#: Text bytes whose phrases one bucket should get.
BUCKET_BYTES = 8 << 20
NO_ORDER = np.iinfo(np.int64).max
INDEX, COVERED, DOUBT, FRAGMENT, WINDOW, MARK = range(6)
#: Fragments of one trigger that a batch sends to its block at most.
HEAVY = 8
_POSITION_BITS = np.uint64(24)
_END = np.uint64(0xA24BAED4963EE407)
_ROWS = "kind int, bucket int, body binary"

#: (bytes, offsets) -> symbols and their offsets by document
Tokenize = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: (symbols of fragments end to end, their offsets, order of each, window) -> for each window whether a smaller order has it
Resolve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as compressed bytes."""
    head = np.array([len(columns), len(columns[0])], dtype=np.int64).tobytes()
    kinds = b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k, n = np.frombuffer(raw, dtype=np.int64, count=2)
    at, out = 16 + 4 * int(k), []
    for i in range(int(k)):
        kind = np.dtype(raw[16 + 4 * i : 20 + 4 * i].decode().strip())
        out.append(np.frombuffer(raw, dtype=kind, count=int(n), offset=at))
        at += int(n) * kind.itemsize
    return out


def wide(symbols: np.ndarray) -> np.ndarray:
    """Symbols as 64-bit hashes; bytes are kept as bytes until they are needed."""
    return BYTE_SYMBOL[symbols] if symbols.dtype == np.uint8 else symbols


def phrases(symbols: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Document number, first window, number of windows, trigger hash and text hash of each phrase."""
    n = len(symbols) - window + 1
    if n <= 0:
        return (*(np.zeros(0, dtype=np.int64),) * 3, *(np.zeros(0, dtype=np.uint64),) * 2)
    roll = Rolling(wide(symbols))
    gram = roll.grams(k)
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), window - k + 1)
    trigger = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    own = np.flatnonzero(np.arange(n) + window <= at[1:][doc])
    if not len(own):
        return (*(np.zeros(0, dtype=np.int64),) * 3, *(np.zeros(0, dtype=np.uint64),) * 2)
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (np.diff(own) != 1) | (np.diff(trigger[own]) != 0)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(own)))
    start = own[first]
    end = np.minimum(start + count + window, at[1:][doc[start]])
    text = roll.slices(start, end) + (end - start).astype(np.uint64)
    # The end marker: a phrase that the end of the text cuts off.
    text = mix(text) ^ np.where(end < start + count + window, _END, np.uint64(0))
    return doc[start], start - at[:-1][doc[start]], count, gram[trigger[start]], mix(text)


def pieces(at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts a batch into chunks of about CHUNK symbols: (symbol slice bounds, document numbers, shifts).

    A document longer than a chunk is cut with window-1 symbols of overlap, so that each of its
    windows stands in exactly one chunk.
    """
    bounds, docs, shifts, size = [], [], [], 0
    for d in range(len(at) - 1):
        s, e = int(at[d]), int(at[d + 1])
        if e - s < window:
            continue
        lo = s
        while lo + window <= e:
            hi = min(e, lo + CHUNK)
            bounds.append((lo, hi))
            docs.append(d)
            shifts.append(lo - s)
            size += hi - lo
            if size >= CHUNK:
                yield np.array(bounds), np.array(docs), np.array(shifts)
                bounds, docs, shifts, size = [], [], [], 0
            lo = hi - window + 1
    if bounds:
        yield np.array(bounds), np.array(docs), np.array(shifts)


def joined(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(bounds) + 1, dtype=np.int64)
    np.cumsum(bounds[:, 1] - bounds[:, 0], out=at[1:])
    return np.concatenate([symbols[a:b] for a, b in bounds]), at


def spans_by_home(kind: int, ord_: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Runs of windows, neighbours merged: one row for each bucket that is home to some of the documents."""
    if not len(ord_):
        return
    order = np.lexsort((start, tag, ord_))
    ord_, tag, start, end = ord_[order], tag[order], start[order], (start + count)[order]
    split = np.ones(len(ord_), dtype=bool)
    split[1:] = (ord_[1:] != ord_[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(split)
    last = np.maximum.reduceat(end, first)
    ord_, tag, start, count = ord_[first], tag[first], start[first], last - start[first]
    home = (mix(ord_.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    for b, (o, g, s, c) in dealt(home, n_buckets, ord_, tag, start, count):
        yield kind, b, pack(np.diff(o, prepend=0), np.diff(g, prepend=0), s.astype(np.uint32), c.astype(np.uint32))


def settle(key: np.ndarray, check: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Which entries have an entry of smaller order under the same key and check."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((ord_, check, key))
    head = np.ones(len(key), dtype=bool)
    head[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.cumsum(head) - 1
    least = ord_[order][np.flatnonzero(head)]
    later = np.empty(len(key), dtype=bool)
    later[order] = ord_[order] > least[number]
    return later


def contested(trigger: np.ndarray, text: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Entries whose trigger has several texts in several documents."""
    if not len(trigger):
        return np.zeros(0, dtype=bool)
    order = np.argsort(trigger, kind="stable")
    t = trigger[order]
    head = np.ones(len(t), dtype=bool)
    head[1:] = t[1:] != t[:-1]
    first = np.flatnonzero(head)
    number = np.cumsum(head) - 1
    varied = np.ones(len(first), dtype=bool)
    for column in (text, ord_):
        c = column[order]
        varied &= np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    out = np.empty(len(t), dtype=bool)
    out[order] = varied[number]
    return out


class Batch:
    """Columns gathered from chunks until they are sent."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, size: int, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += size

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        return out


def to_arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "bucket", "body"])


def dealt(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if cut[b] < cut[b + 1]:
            rows = order[cut[b] : cut[b + 1]]
            yield b, [c[rows] for c in columns]


def by_document(ord_: np.ndarray, tag: np.ndarray, entry_doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Document orders and tags for entries, stored once a document."""
    used, small = np.unique(entry_doc, return_inverse=True)
    return pack(np.diff(ord_[used], prepend=0), tag[used]), np.diff(small, prepend=0).astype(np.int32)


@returning_memory
def _parse(batches, tokenize: Tokenize, window: int, k: int, n_buckets: int):
    held, docs, sent = Batch(), 0, []
    orders, tags = [], []

    def send():
        nonlocal docs
        if not held.parts:
            return []
        doc, start, count, trigger, text = held.take()
        ord_, tag = np.concatenate(orders), np.concatenate(tags)
        orders.clear(), tags.clear()
        docs = 0
        rows = []
        later = settle(text, trigger, ord_[doc])
        rows += spans_by_home(COVERED, ord_[doc][later], tag[doc][later], start[later], count[later], n_buckets)
        own = ~later
        doc, start, count, trigger, text = (c[own] for c in (doc, start, count, trigger, text))
        doubt = contested(trigger, text, ord_[doc])
        rows += spans_by_home(DOUBT, ord_[doc][doubt], tag[doc][doubt], start[doubt], count[doubt], n_buckets)
        # Of a trigger in doubt one mark goes on, so that phrases elsewhere are put in doubt as well.
        marks = np.unique(trigger[doubt])
        sure = ~doubt
        doc, start, count, trigger, text = (c[sure] for c in (doc, start, count, trigger, text))
        bucket = (trigger % np.uint64(n_buckets)).astype(np.int64)
        mark_rows = dict(dealt((marks % np.uint64(n_buckets)).astype(np.int64), n_buckets, marks)) if len(marks) else {}
        for b, (d, s, c, t, x) in dealt(bucket, n_buckets, doc, start, count, trigger, text):
            table, small = by_document(ord_, tag, d)
            body = pack(small, np.diff(s, prepend=0).astype(np.int32), c.astype(np.uint8 if window < 256 else np.uint32), *(((t >> np.uint64(24)) >> np.uint64(8 * i)).astype(np.uint8) for i in range(5)), *((x >> np.uint64(8 * i)).astype(np.uint8) for i in range(8)))
            m = mark_rows.pop(b, [np.zeros(0, dtype=np.uint64)])[0]
            rows.append((INDEX, b, _frame(table, pack(m >> np.uint64(24)), body)))
        for b, (m,) in mark_rows.items():
            rows.append((INDEX, b, _frame(b"", pack(m >> np.uint64(24)), b"")))
        return rows

    for batch in batches:
        data, at = utf8(batch.column("text"))
        symbols, at = tokenize(data, at)
        orders.append(batch.column("ord").to_numpy(zero_copy_only=False).astype(np.int64))
        tags.append(batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64))
        for bounds, which, shift in pieces(at, window):
            part, part_at = joined(symbols, bounds)
            doc, start, count, trigger, text = phrases(part, part_at, window, k)
            held.add(len(part), which[doc] + docs, start + shift[doc], count, trigger, text)
        docs += batch.num_rows
        if held.size >= FLUSH_BYTES:
            sent = send()
            if sent:
                yield to_arrow(sent)
    sent = send()
    if sent:
        yield to_arrow(sent)


def _frame(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframe(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


@returning_memory
def _index(batches, n_buckets: int):
    """Reads the rows of one bucket: settles the dictionary, passes on what was settled before."""
    parts, marks, passed = [], [np.zeros(0, dtype=np.uint64)], []
    for batch in batches:
        for kind, bucket, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind != INDEX:
                passed.append((kind, bucket, body))
                continue
            table, m, entries = _unframe(body)
            marks += unpack(m)
            if entries:
                ord_, tag = unpack(table)
                small, start, count, *codes = unpack(entries)
                doc = np.cumsum(small.astype(np.int64))
                wide = [sum(c.astype(np.uint64) << np.uint64(8 * i) for i, c in enumerate(x)) for x in (codes[:5], codes[5:])]
                parts.append((np.cumsum(ord_)[doc], tag[doc], np.cumsum(start.astype(np.int64)), count.astype(np.int64), *wide))
    if passed:
        yield to_arrow(passed)
    if parts:
        ord_, tag, start, count, trigger, text = (np.concatenate(c) for c in zip(*parts, strict=True))
        later = settle(text, trigger, ord_)
        rows = list(spans_by_home(COVERED, ord_[later], tag[later], start[later], count[later], n_buckets))
        doubt = (contested(trigger, text, ord_) | np.isin(trigger, np.concatenate(marks))) & ~later
        rows += spans_by_home(DOUBT, ord_[doubt], tag[doubt], start[doubt], count[doubt], n_buckets)
        if rows:
            yield to_arrow(rows)


def ranges_of(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers, then those of the next."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def window_keys(symbols: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, 64 and 32 bits."""
    key = Rolling(wide(symbols)).slices(start, start + window)
    check = Rolling(mix(wide(symbols))).slices(start, start + window)
    return key, (check >> np.uint64(32)).astype(np.uint32)


def window_rows(ord_, tag, start, key, check, n_buckets: int) -> Iterator[tuple]:
    """Windows that go on one by one, dealt by their hash."""
    for b, (o, g, s, x, y) in dealt((key % np.uint64(n_buckets)).astype(np.int64), n_buckets, ord_, tag, start, key, check):
        order = np.lexsort((s, g, o))
        yield WINDOW, b, pack(np.diff(o[order], prepend=0), np.diff(g[order], prepend=0), s[order].astype(np.uint32), x[order], y[order])


@returning_memory
def _fragments(batches, tokenize: Tokenize, window: int, k: int, n_buckets: int):
    """The windows in doubt: those with an owner in their batch are covered, the others go to blocks by trigger."""
    held, texts, size = Batch(), [], 0

    def send():
        nonlocal size
        if not held.parts:
            return []
        ord_, tag, start, place, trigger, key, check = held.take()
        symbols = np.concatenate(texts)
        texts.clear()
        size = 0
        later = settle(key, check, ord_)
        rows = list(spans_by_home(COVERED, ord_[later], tag[later], start[later], np.ones(int(later.sum()), dtype=np.int64), n_buckets))
        ord_, tag, start, place, trigger, key, check = (c[~later] for c in (ord_, tag, start, place, trigger, key, check))
        head = np.ones(len(place), dtype=bool)
        head[1:] = (np.diff(place) != 1) | (trigger[1:] != trigger[:-1])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(place)))
        _, group, many = np.unique(trigger[first], return_inverse=True, return_counts=True)
        heavy = many[group] > HEAVY
        each = np.repeat(heavy, count)
        rows += window_rows(ord_[each], tag[each], start[each], key[each], check[each], n_buckets)
        marks = np.unique(trigger[first][heavy])
        rows += [(MARK, b, pack(m)) for b, (m,) in dealt((marks % np.uint64(n_buckets)).astype(np.int64), n_buckets, marks)]
        first, count = first[~heavy], count[~heavy]
        for b, (f, c) in dealt((trigger[first] % np.uint64(n_buckets)).astype(np.int64), n_buckets, first, count):
            own = symbols[ranges_of(place[f], c + window - 1)]
            rows.append((FRAGMENT, b, _frame(pack(np.diff(ord_[f], prepend=0), np.diff(tag[f], prepend=0), start[f].astype(np.uint32), c.astype(np.uint32), trigger[f]), pack(own))))
        return rows

    for batch in batches:
        data, at = utf8(batch.column("text"))
        symbols, at = tokenize(data, at)
        orders, tags = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ord", "tag"))
        runs, of = [], []
        for d, body in enumerate(batch.column("bodies").to_pylist()):
            start, count = (c.astype(np.int64) for c in unpack(body))
            # Runs of doubt may come from two tasks and meet or overlap; of one window only one is asked.
            low = np.maximum(start, np.concatenate(([0], np.maximum.accumulate(start + count)[:-1])))
            high = np.minimum(start + count, at[d + 1] - at[d] - window + 1)
            runs += [(int(at[d]) + a, int(at[d]) + b + window - 1) for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
            of += [d] * (len(runs) - len(of))
        if not runs:
            continue
        runs, of = np.array(runs), np.array(of)
        # Runs stand in for documents here: each is cut into chunks with window - 1 symbols of overlap.
        text, run_at = joined(symbols, runs)
        for bounds, which, shift in pieces(run_at, window):
            part, part_at = joined(text, bounds)
            doc, start, count, trigger, _ = phrases(part, part_at, window, k)
            place = ranges_of(part_at[:-1][doc] + start, count)
            run = np.repeat(which[doc], count)
            inside = ranges_of(start + shift[doc], count)
            key, check = window_keys(part, place, window)
            held.add(len(part) * 8, orders[of[run]], tags[of[run]], runs[run, 0] - at[of[run]] + inside, place + size, np.repeat(trigger, count), key, check)
            texts.append(part)
            size += len(part)
            if held.size >= FLUSH_BYTES:
                rows = send()
                if rows:
                    yield to_arrow(rows)
    rows = send()
    if rows:
        yield to_arrow(rows)


@returning_memory
def _blocks(batches, resolve: Resolve, window: int, n_buckets: int):
    """One block: all fragments of its triggers, whichever batch they come from."""
    parts, texts, marks, passed = [], [], [np.zeros(0, dtype=np.uint64)], []
    for batch in batches:
        for kind, bucket, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == FRAGMENT:
                head, own = _unframe(body)
                o, g, s, c, t = unpack(head)
                parts.append((np.cumsum(o), np.cumsum(g), s.astype(np.int64), c.astype(np.int64), t))
                texts += unpack(own)
            elif kind == MARK:
                marks += unpack(body)
            else:
                passed.append((kind, bucket, body))
    if passed:
        yield to_arrow(passed)
    if parts:
        ord_, tag, start, count, trigger = (np.concatenate(c) for c in zip(*parts, strict=True))
        symbols = np.concatenate(texts)
        at = np.concatenate(([0], np.cumsum(count + window - 1)))
        later = resolve(symbols, at, ord_, window)
        each = np.repeat(np.arange(len(ord_)), count)
        where = ranges_of(start, count)
        rows = list(spans_by_home(COVERED, ord_[each][later], tag[each][later], where[later], np.ones(int(later.sum()), dtype=np.int64), n_buckets))
        on = ~later & np.isin(trigger, np.concatenate(marks))[each]
        if on.any():
            key, check = window_keys(symbols, ranges_of(at[:-1], count)[on], window)
            rows += window_rows(ord_[each][on], tag[each][on], where[on], key, check, n_buckets)
        if rows:
            yield to_arrow(rows)


@returning_memory
def _meet(batches, n_buckets: int):
    """Windows of one hash range that go on one by one; what was settled before is passed on."""
    parts, passed = [], []
    for batch in batches:
        for kind, bucket, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind != WINDOW:
                passed.append((kind, bucket, body))
                continue
            d, g, s, x, y = unpack(body)
            parts.append((np.cumsum(d), np.cumsum(g), s.astype(np.int64), x, y))
    if passed:
        yield to_arrow(passed)
    if parts:
        ord_, tag, start, key, check = (np.concatenate(c) for c in zip(*parts, strict=True))
        later = settle(key, check, ord_)
        rows = list(spans_by_home(COVERED, ord_[later], tag[later], start[later], np.ones(int(later.sum()), dtype=np.int64), n_buckets))
        if rows:
            yield to_arrow(rows)


def covered_windows(docs: DataFrame, tokenize: Tokenize, resolve: Resolve, window: int, k: int) -> DataFrame:
    """docs (ord, tag, text, ...) -> the same with `bodies`: packed runs of covered windows, null if there are none.

    ord gives the order of documents; ord and tag together name a row. Rows of equal ord never cover
    each other.
    """
    bound_batches(docs.sparkSession)
    n_buckets = max(8, min(1 << 16, -(-text_bytes(docs, "text") // BUCKET_BYTES)))
    parsed = docs.select("ord", "tag", "text").mapInArrow(partial(_parse, tokenize=tokenize, window=window, k=k, n_buckets=n_buckets), _ROWS)
    first = shared_checkpoint(_each_bucket(parsed, partial(_index, n_buckets=n_buckets)))

    def of(kind: int, rows: DataFrame) -> DataFrame:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _gather(batches)

        return rows.filter(F.col("kind") == kind).groupBy("bucket").applyInArrow(one, "o long, g long, bodies binary")

    asked = of(DOUBT, first)
    doubtful = docs.join(asked, (docs.ord == asked.o) & (docs.tag == asked.g), "left").filter(F.col("bodies").isNotNull()).select(*docs.columns, "bodies")
    fragments = doubtful.mapInArrow(partial(_fragments, tokenize=tokenize, window=window, k=k, n_buckets=n_buckets), _ROWS)
    # Nothing is written between here and the result, so that both joins read one exchange of the documents.
    second = _each_bucket(fragments, partial(_blocks, resolve=resolve, window=window, n_buckets=n_buckets))
    third = _each_bucket(second, partial(_meet, n_buckets=n_buckets))
    found = of(COVERED, first.unionByName(third))
    return docs.join(found, (docs.ord == found.o) & (docs.tag == found.g), "left").select(*docs.columns, "bodies")


@returning_memory
def _gather(batches):
    """The spans of one bucket's documents, one row a document."""
    parts = []
    for batch in batches:
        for body in batch.column("body").to_pylist():
            o, g, s, c = unpack(body)
            parts.append((np.cumsum(o), np.cumsum(g), s.astype(np.int64), c.astype(np.int64)))
    ord_, tag, start, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((start, tag, ord_))
    ord_, tag, start, count = (c[order] for c in (ord_, tag, start, count))
    edge = np.ones(len(ord_), dtype=bool)
    edge[1:] = (ord_[1:] != ord_[:-1]) | (tag[1:] != tag[:-1])
    cut = np.append(np.flatnonzero(edge), len(ord_))
    for lo in range(0, len(cut) - 1, 10_000):
        own = cut[lo : lo + 10_001]
        bodies = [pack(start[a:b].astype(np.uint32), count[a:b].astype(np.uint32)) for a, b in zip(own[:-1], own[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ord_[own[:-1]]), pa.array(tag[own[:-1]]), pa.array(bodies, pa.binary())], names=["o", "g", "bodies"])


def _each_bucket(rows: DataFrame, reduce: Callable) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduce(batches)

    return rows.groupBy("bucket").applyInArrow(one, _ROWS)


def ordered(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(ord, tag, text, row): rows without an id come after all others; tag tells rows of one id, and those without one, apart; row carries others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Many rows may lack an id, so theirs is a 64-bit tag.
    tag = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.abs(F.hash(text).cast("long")))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ORDER)).alias("ord"), tag.alias("tag"), text.alias("text"), F.struct(F.lit(True).alias("_"), *carry).alias("row"))


def token_mask(n: int, body: bytes | None, window: int) -> np.ndarray:
    """Which of n tokens lie in a covered window."""
    step = np.zeros(n + 1, dtype=np.int64)
    if body:
        start, count = (c.astype(np.int64) for c in unpack(body))
        end = start + count + window - 1
        inside = end <= n
        np.add.at(step, start[inside], 1)
        np.add.at(step, end[inside], -1)
    return np.cumsum(step[:-1]) > 0
