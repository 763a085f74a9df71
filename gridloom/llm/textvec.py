"""Words of whole Arrow batches as NumPy arrays: boundaries, 64-bit hashes, hashes of runs of words.

Everything works on the UTF-8 bytes in slices of about a megabyte, so memory
stays bounded by the slice or the longest single text. ``freeing`` gives back
what a partition's work has left in the worker, which Spark keeps for others.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E6C63D0876A9A47 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_S33 = np.uint64(33)

#: Bytes of words that end at white space: everything but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes or words hashed at a time; the powers below serve every hash, so no table grows with a text.
CHUNK = 1 << 17


def _powers_of(base: int) -> np.ndarray:
    table = np.full(CHUNK + 1, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWER, _UNDO = _powers_of(_BASE), _powers_of(_INVERSE)


def _prefix(values: np.ndarray) -> np.ndarray:
    """Sums of up to CHUNK values, each times the power of its place, before every place and in all."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWER[: len(values)], out=total[1:])
    return total


def _long_word(data: np.ndarray) -> np.uint64:
    """What ``hashes`` gives, before mixing, for a word of more than CHUNK bytes."""
    out, scale = 0, 1
    for a in range(0, len(data), CHUNK):
        part = int(_prefix(_BYTE[data[a : a + CHUNK]])[-1])
        out = (out + part * scale) % (1 << 64)
        scale = scale * pow(_BASE, CHUNK, 1 << 64) % (1 << 64)
    return np.uint64(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> _S33)
    h *= _MIX[0]
    h ^= h >> _S33
    h *= _MIX[1]
    h ^= h >> _S33
    return h


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], after: Callable[[], None] | None = None):
    """``run`` for ``mapInArrow``, with ``after`` and ``release`` called when its partition ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            release()

    return whole


def texts(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts, as one plain string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    _, offs = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past the last byte
    bound: np.ndarray  # words before each text, and in all: len(texts) + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.bound)

    def owner(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.bound) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self.start), np.uint64)
        at, n = 0, len(self.start)
        while at < n:
            zero = self.start[at]
            to = int(np.searchsorted(self.end, zero + CHUNK, "right"))
            if to == at:
                out[at] = _long_word(self.data[zero : self.end[at]])
                to += 1
            else:
                start, end = self.start[at:to] - zero, self.end[at:to] - zero
                total = _prefix(_BYTE[self.data[zero : zero + end[-1]]])
                out[at:to] = (total[end] - total[start]) * _UNDO[start]
            at = to
        return mix(out)


def words(column: pa.Array, is_word: np.ndarray = NOT_SPACE) -> Words:
    """The maximal runs of bytes marked in ``is_word``, none reaching over two texts."""
    data, offs = buffers(column)
    n = len(data)
    w = is_word[data]
    first, last = w.copy(), w.copy()
    if n:
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        b = offs[:-1]
        b = b[b < n]
        first[b] = w[b]
        e = offs[1:]
        e = e[e > 0] - 1
        last[e] = w[e]
    start = np.flatnonzero(first)
    return Words(data, start, np.flatnonzero(last) + 1, np.searchsorted(start, offs).astype(np.int64))


def runs(h: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row that stay in one text, and the index of each one's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.repeat(bound[1:], np.diff(bound)) - np.arange(len(h))
    at = np.flatnonzero(room >= k)
    return runs_at(h, at, k), at


def runs_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that begin at each of the rising indices ``at``."""
    out = np.zeros(len(at), np.uint64)
    step = CHUNK - k + 1
    for zero in range(0, len(h) if len(at) else 0, step):
        a, z = np.searchsorted(at, (zero, zero + step))
        if a < z:
            total = _prefix(h[zero : zero + CHUNK])
            mine = at[a:z] - zero
            out[a:z] = (total[mine + k] - total[mine]) * _UNDO[mine]
    return mix(out)


def fold(values: np.ndarray, bound: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """``ufunc`` over each text's values; ``empty`` for texts without any."""
    out = np.full(len(bound) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(bound) > 0)
    if len(has):
        out[has] = ufunc.reduceat(values, bound[has])
    return out


def as_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The texts of words by their bytes."""
    raw = data.tobytes()
    return [raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def kept_text(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words of one text joined by single spaces, as bytes."""
    if not len(start):
        return b""
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)])
