"""Vectorised splitting and hashing of words in Arrow string columns."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once: it bounds the working arrays of a Python worker.
SLICE_BYTES = 1 << 19
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Poly:
    """Polynomial hashes of any range of an array in a few array operations, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16, min(2 * self.n, SLICE_BYTES + 1))
            self.up, self.down = _powers(self.base, self.n), _powers(_inverse(self.base), self.n)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        self.grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        return (total[end] - total[start]) * self.down[start]


_WORDS = _Poly(0xA0761D6478BD642F)
#: Words of more bytes are hashed one by one.
_LONG = 256
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULT
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_SIZES = mix(np.arange(_LONG + 1, dtype=np.uint64)) * _MULT


class Alphabet:
    """Which bytes belong to words, and how they fold."""

    def __init__(self, member, fold=lambda b: b):
        self.member = np.array([bool(member(b)) for b in range(256)])
        self.fold = np.array([fold(b) for b in range(256)], np.uint8)


def _lower(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


#: Digits, letters with A-Z lower-cased, and all beyond ASCII.
ALNUM = Alphabet(lambda b: 48 <= b <= 57 or 97 <= _lower(b) <= 122 or b >= 128, _lower)
#: Whatever is not ASCII white space.
SPACED = Alphabet(lambda b: not (b == 32 or 9 <= b <= 13))


def eights(data: np.ndarray) -> np.ndarray:
    """For each byte of data the eight from there on, as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each range of bytes: eight bytes at a time are mixed in, so no pattern of bytes cancels out."""
    size, windows = end - start, eights(data)
    short = np.minimum(size, _LONG)
    out = mix(_SIZES[short] + (windows[start] & _KEPT[np.minimum(size, 8)]))
    live, at = np.flatnonzero(short > 8), 8
    while len(live):
        chunk = windows[start[live] + at] & _KEPT[np.minimum(short[live] - at, 8)]
        out[live] = mix(out[live] * _MULT + chunk)
        at += 8
        live = live[short[live] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def same(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether ranges of bytes a are those of b, pair by pair."""
    size = a_end - a_start
    out = size == b_end - b_start
    mine, theirs = eights(a), eights(b)
    live, at = np.flatnonzero(out & (size > 0)), 0
    while len(live):
        differ = ((mine[a_start[live] + at] ^ theirs[b_start[live] + at]) & _KEPT[np.minimum(size[live] - at, 8)]) != 0
        out[live[differ]] = False
        at += 8
        live = live[~differ & (size[live] > at)]
    return out


class Words:
    """The words of several texts.

    ``hash`` has a value per word, ``start`` and ``end`` its bytes in ``data``, and
    ``bounds[i]:bounds[i + 1]`` are text i's words. Null and empty texts have none.
    """

    __slots__ = ("bounds", "data", "end", "hash", "start")

    def __init__(self, data, start, end, bounds, hashes):
        self.data, self.start, self.end, self.bounds, self.hash = data, start, end, bounds, hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each text's place in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(column) else np.zeros(1, np.int64)


def split(column: pa.Array, alphabet: Alphabet) -> Words:
    data, offs = buffers(column)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet.member[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]  # two texts may touch without a gap
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offs)
    return Words(data, start, end, bounds, hashed(alphabet.fold[data], start, end))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place (len - k + 1 values); callers cut at text bounds."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, SLICE_BYTES):
        to = min(n, at + SLICE_BYTES)
        i = np.arange(to - at)
        out[at:to] = _WORDS.ranges(hashes[at : to + k - 1], i, i + k)
    return mix(out + np.uint64(k))


def fits(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n places, whether k items from it stay within one text."""
    ok = np.zeros(n, bool)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
    ok[:] = left[:n] >= k
    return ok


def release() -> None:
    """Give freed memory back: a worker serves many stages, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES):
    """Parts of a batch with about ``most`` bytes of text each, and one row at least."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()
