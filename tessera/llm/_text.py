"""Vectorised text primitives on Arrow string buffers.

Documents stay UTF-8 bytes in one numpy array per slice; nothing here makes a
Python object per word or per byte.  Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; numpy needs up to a hundred times as much memory per byte, and arrays of this
#: size stay in the processor's cache.  Of a longer document, words are found and hashed in such pieces; what is
#: kept of it takes about ten bytes for each byte.
SLICE_BYTES = 1 << 17
_U = np.uint64
#: Ranges are hashed as polynomials modulo this prime, at a fixed random point; for k elements, two ranges collide with a chance of k / 2**61.
_PRIME = (1 << 61) - 1
_BASE = 0x16A9E3F5D2C84B71
_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte.
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
#: The white space of every word rule here: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _reduce(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 30 and 31 bits."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    middle = a1 * b0 + a0 * b1
    middle = (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31))
    return _reduce(_reduce(_U(2) * (a1 * b1) + middle) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for slot, base in enumerate((_BASE % _PRIME, pow(_BASE, -1, _PRIME))):
            out = np.ones(1, _U)
            while len(out) < size:  # doubling
                out = np.concatenate((out, _times(out, np.full(len(out), pow(base, len(out), _PRIME), _U))))
            _powers[slot] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _sums(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums modulo the prime, starting with 0, of numbers given as low + 2**32 high; up to 2**31 of them."""
    out = np.zeros(len(low) + 1, _U)
    high = np.cumsum(high, dtype=_U)
    high = (high >> _U(29)) + ((high & _U((1 << 29) - 1)) << _U(32))
    out[1:] = _reduce(_reduce(np.cumsum(low, dtype=_U)) + _reduce(high))
    return out


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hash`` takes the hash of any range of 64-bit values."""
    terms = _times(_reduce(values), powers(len(values))[0])
    return _sums(terms & _U(0xFFFFFFFF), terms >> _U(32))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """``prefix_sums`` for bytes: a byte b counts as b + 1."""
    power, value = powers(len(data))[0], data.astype(_U) + _U(1)
    return _sums((power & _U(0xFFFFFFFF)) * value, (power >> _U(32)) * value)


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values in [start, end); equal ranges at other places hash alike."""
    own = sums[end] + (_U(_PRIME) - sums[start])
    own = _times(_reduce(own), powers(len(sums))[1][start])
    return mix(own + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_WRAP = 0x9E3779B97F4A7C15
_wraps = [np.ones(1, _U), np.ones(1, _U)]


def gram_order(data: np.ndarray, size: int) -> np.ndarray:
    """A number for each gram of ``size`` bytes, by which anchors are chosen: equal grams have equal numbers, others seldom.

    Modulo 2**64, so it takes a third of ``range_hash``'s time; crafted grams may
    share a number, so that it never decides equality.
    """
    n = len(data) + 1
    if len(_wraps[0]) < n:
        for slot, base in enumerate((_WRAP, pow(_WRAP, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES + 4096), base, _U)
            steps[0] = 1
            _wraps[slot] = np.cumprod(steps, dtype=_U)
    sums = np.zeros(n, _U)
    np.cumsum(BYTE_VALUE[data] * _wraps[0][: n - 1], out=sums[1:])
    return mix((sums[size:] - sums[: n - size]) * _wraps[1][: n - size])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string column."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some documents: start, end (bytes) and document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~IS_SPACE[data]
        edge = np.flatnonzero(inside[1:] & ~inside[:-1])
        stop = np.flatnonzero(inside[:-1] & ~inside[1:])
        cut = offsets[1:-1]  # a word never goes on into the next document
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut + 1]]
        self.start = np.sort(np.concatenate((edge, cut))) if len(cut) else edge
        self.end = np.sort(np.concatenate((stop, cut))) if len(cut) else stop
        self.doc = np.searchsorted(offsets[1:], self.start, "right")
        bounds = np.searchsorted(self.doc, np.arange(len(offsets)), "left")
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; about SLICE_BYTES of text at a time, whatever the length of a document."""
        out, first = np.zeros(len(self.start), _U), 0
        while first < len(out):
            begin = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, begin + SLICE_BYTES, "right")))
            data = self.data[begin : self.end[last - 1]]
            sums = byte_sums(LOWER[data] if lower else data)
            out[first:last] = range_hash(sums, self.start[first:last] - begin, self.end[first:last] - begin)
            first = last
        return out


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many elements of mask are true in each row."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ngram_hashes(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram inside one document, and the index of its first element."""
    if len(values) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return range_hash(prefix_sums(values), at, at + n), at


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions that [start, end) ranges cover."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == _U else h
