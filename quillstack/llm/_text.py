"""Byte-level helpers shared by the operators that run NumPy inside Spark tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; on UTF-8 that is the same as the
code-point definition, because those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def returning_memory(task):
    """A task function over batches whose worker, kept by Spark for later stages, gives freed memory back at its end."""

    @functools.wraps(task)
    def run(*args, **kwargs):
        yield from task(*args, **kwargs)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, so that low bytes do not hash to small numbers.
BYTE_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the hash base modulo 2**64 and of its inverse, grown on demand and kept per process."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Polynomial hashes of any slice of a symbol array, from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = Powers.to(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:-1], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k consecutive symbols."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts that lie end to end in a byte array."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    before[at[:-1]] = False
    after[at[1:]] = False
    return np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1


def chunks(at: np.ndarray, size: int = 1 << 18):
    """Ranges of documents of about `size` bytes each."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size)))
        last = min(last, len(at) - 1)
        yield first, last
        first = last


def word_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each document's words begin."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for first, last in chunks(at):
        part, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
        start, end = word_bounds(part, own)
        hashes.append(Rolling(BYTE_SYMBOL[part]).slices(start, end) + (end - start).astype(np.uint64))
        counts.append(np.diff(np.searchsorted(start, own)))
    word_at = np.zeros(len(at), dtype=np.int64)
    np.cumsum(np.concatenate(counts), out=word_at[1:])
    return np.concatenate(hashes), word_at


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; nulls count as empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return flat, at - at[0]
