"""Suffix sorting with common-prefix values by external induced sorting.

The recursion is the classical one.  Suffixes are L or S by whether they are
larger or smaller than their right neighbour; the leftmost S suffixes split the
text into substrings, which are named by rank; the string of names is sorted by
the same procedure (or, once it fits, by doubling in memory); its order then
induces first the L and next the S suffixes.

The induction takes suffix tuples (position, common prefix with the tuple
before) from a priority queue and puts each one's left neighbour back under its
first symbol.  Within a symbol tuples leave in the order in which they came, so
the queue keeps a first-in-first-out run for each symbol, and hands out whole
runs at once; runs beyond the memory budget wait on disk.  A common-prefix value
is one more than the smallest value between the two tuples that induced it.

A text is any number of segments, each ended by a separator.  Separators are
pairwise different and smaller than every other symbol, so no common prefix
reaches over one.  Order and values are exact to ``cap`` symbols: suffixes that
agree on ``cap`` symbols stay together, in any order.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyarrow import fs

_NONE = np.iinfo(np.int16).max


class SpillingQueue:
    """First-in-first-out runs of (position, prefix) by symbol; the largest go to files beyond ``budget`` bytes.

    ``folder`` is a URI or path of any file system that pyarrow opens; without
    one nothing is spilled.
    """

    def __init__(self, budget: int, folder: str | None = None) -> None:
        self.budget, self.held, self.spilled = budget, 0, 0
        self._runs: dict[int, list] = defaultdict(list)
        self._bytes: dict[int, int] = defaultdict(int)
        self._folder, self._files = folder, None
        self._left: dict[str, int] = {}  # runs of each file that are still waiting

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self._runs[symbol].append((position, prefix))
        size = position.nbytes + prefix.nbytes
        self._bytes[symbol] += size
        self.held += size
        if self.held > self.budget and self._folder:
            self._spill()

    def _spill(self) -> None:
        """Writes the largest runs to one file, until half of the budget is held."""
        if self._files is None:
            self._files, root = fs.FileSystem.from_uri(self._folder) if ":" in self._folder else (fs.LocalFileSystem(), self._folder)
            self._folder = f"{root.rstrip('/')}/queue-{uuid.uuid4().hex}"
            self._files.create_dir(self._folder)
        name, at, runs = f"{self._folder}/{uuid.uuid4().hex}", 0, 0
        with self._files.open_output_stream(name) as out:
            for symbol in sorted(self._bytes, key=self._bytes.__getitem__, reverse=True):
                if self.held <= self.budget // 2:
                    break
                held = [run for run in self._runs[symbol] if run[0] is not None]
                position, prefix = (np.concatenate(x) for x in zip(*held, strict=True))
                out.write(position.tobytes())
                out.write(prefix.tobytes())
                # those in memory came after those on disk
                self._runs[symbol] = [*self._runs[symbol][: -len(held)], (None, name, at, len(position), position.dtype)]
                at += position.nbytes + prefix.nbytes
                runs += 1
                self.spilled += self._bytes[symbol]
                self.held -= self._bytes.pop(symbol)
        self._left[name] = runs

    def _read(self, name: str, at: int, count: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """A run that waits in a file; the last one of a file deletes it."""
        with self._files.open_input_file(name) as data:
            raw = data.read_at(count * (kind.itemsize + 2), at)
        self._left[name] -= 1
        if not self._left[name]:
            self._files.delete_file(name)
            del self._left[name]
        return np.frombuffer(raw, kind, count), np.frombuffer(raw, np.int16, count, count * kind.itemsize)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a symbol so far, in order; None if there are none."""
        runs = self._runs.pop(symbol, None)
        if not runs:
            return None
        self.held -= self._bytes.pop(symbol, 0)
        parts = [self._read(*run[1:]) if run[0] is None else run for run in runs]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def close(self) -> None:
        if self._files is not None:
            self._files.delete_dir(self._folder)


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, rank = np.unique(x, return_inverse=True)
    return rank.astype(np.int64), len(values)


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one counts as S."""
    n = len(s)
    less = np.ones(n, bool)
    less[:-1] = s[:-1] < s[1:]
    place = np.arange(n)
    place[:-1][s[:-1] == s[1:]] = n
    return less[np.minimum.accumulate(place[::-1])[::-1]]


def _names(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each substring from one leftmost S suffix to the next."""
    code = 2 * s.astype(np.int64) + small
    bits = max(1, int(code.max()).bit_length())
    take = max(1, 62 // bits)
    length = np.append(np.diff(lms) + 1, 1)
    padded = np.concatenate((code, np.zeros(take, np.int64)))

    def packed(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(take):
            out = (out << bits) | np.where(left > i, padded[np.minimum(at + i, len(padded) - 1)], 0)
        return out

    rank, count = _dense(packed(lms, length))
    done, active = take, np.flatnonzero(length > take)
    while len(active):
        more = np.zeros(len(lms), np.int64)
        tail, kinds = _dense(packed(lms[active] + done, length[active] - done))
        more[active] = tail + 1
        rank, count = _dense(rank * (kinds + 1) + more)
        done += take
        active = active[length[active] > done]
    return rank, count


def _double(names: np.ndarray, count: int, cap: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling, exact to cap symbols (a name is two symbols or more)."""
    rank, n, step = names, len(names), 1
    while count < n and 2 * step < cap + 2:
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:] + 1
        rank, count = _dense(rank * (count + 1) + follow)
        step *= 2
    return np.argsort(rank, kind="stable")


class _Words:
    """Common prefixes, eight bytes at a time, of a level whose symbols are bytes; else symbol by symbol."""

    def __init__(self, s: np.ndarray, n_separators: int, cap: int) -> None:
        self.cap = cap
        end = np.where(s < n_separators, np.arange(len(s)), len(s))
        self.left = np.minimum.accumulate(end[::-1])[::-1] - np.arange(len(s))  # symbols before the next separator
        small = int(s.max()) - n_separators < 255
        raw = np.maximum(s.astype(np.int64) - n_separators + 1, 0)
        self.step = 8 if small else 1
        if small:
            self.raw = np.concatenate((raw.astype(np.uint8), np.zeros(cap + 16, np.uint8)))
            self.wide = np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,))
        else:
            self.wide = np.concatenate((raw.astype(np.uint64), np.zeros(cap + 16, np.uint64)))

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.cap)
        out, active, done = most.copy(), np.flatnonzero(most > 0), 0
        while len(active):
            differ = self.wide[a[active] + done] ^ self.wide[b[active] + done]
            stop = differ != 0
            if stop.any():
                at = active[stop]
                x = differ[stop]
                low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest set bit, exact in a double
                same = (np.log2(low).astype(np.int64) // 8) if self.step == 8 else 0
                out[at] = np.minimum(most[at], done + same)
            done += self.step
            active = active[~stop]
            active = active[most[active] > done]
        return out.astype(np.int16)


def _induce(s, kind, sources, prefix, since, queue, cap) -> None:
    """Push the left neighbours of type ``kind`` of a batch of sources, with their common-prefix values."""
    at = sources - 1
    good = np.flatnonzero((at >= 0) & kind[at])
    low = prefix.min()
    if not len(good):
        np.minimum(since, low, out=since)
        return
    at = at[good]
    symbol = s[at]
    order = np.argsort(symbol, kind="stable")
    symbol, at, where = symbol[order], at[order], good[order]
    head = np.ones(len(symbol), bool)
    head[1:] = symbol[1:] != symbol[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(symbol))
    bounds = np.empty((len(where), 2), np.int64)
    bounds[1:, 0] = where[:-1] + 1
    bounds[first, 0] = 0
    bounds[:, 1] = where + 1
    value = np.minimum.reduceat(np.append(prefix, np.int16(_NONE)), bounds.ravel())[::2]
    own = symbol[first]
    value[first] = np.minimum(value[first], since[own])
    value = np.minimum(value + 1, cap).astype(np.int16)
    np.minimum(since, low, out=since)
    tail = np.minimum.accumulate(np.append(prefix[::-1], np.int16(_NONE))[np.r_[len(prefix), 0 : len(prefix)]])  # tail[k]: minimum of the last k
    since[own] = tail[len(prefix) - 1 - where[last - 1]]
    for c, i, j in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
        queue.push(c, at[i:j], value[i:j])


def suffix_sort(s: np.ndarray, n_separators: int, cap: int, budget: int = 32 << 20, base: int = 1 << 22, prefixes: bool = True, folder: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(order of all suffixes, common prefix of each with the one before).

    s: integers; 0 .. n_separators - 1 occur once each, the last symbol is one of
    them.  ``budget`` bytes of queued tuples stay in memory, the others
    in files of ``folder``; a string of at most
    ``base`` names is sorted in memory instead of by recursion.
    """
    n = len(s)
    small = _types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    is_lms |= s < n_separators  # also where separators follow one another
    lms = np.flatnonzero(is_lms)
    if n <= 2 or not len(lms):
        return np.argsort(s, kind="stable"), np.zeros(n, np.int16)
    names, count = _names(s, small, lms)
    if count == len(lms):
        order = np.argsort(names, kind="stable")
    elif len(lms) <= base:
        order = _double(names, count, cap)
    else:
        order = suffix_sort(names, n_separators, cap, budget, base, False, folder)[0]
    lms = lms[order]
    words = _Words(s, n_separators, cap) if prefixes else None
    # without values the same code runs on zeros
    lms_prefix = np.zeros(len(lms), np.int16)
    if words and len(lms) > 1:
        lms_prefix[1:] = words.prefix(lms[:-1], lms[1:])
    pair = (lambda a, b: words.prefix(np.array([a]), np.array([b]))[0]) if words else (lambda a, b: np.int16(0))
    position = np.int32 if n < 1 << 31 else np.int64
    lms = lms.astype(position)
    symbols = np.unique(s[s >= n_separators])
    bound = np.searchsorted(s[lms], np.append(symbols, symbols[-1] + 1 if len(symbols) else 0)) if len(symbols) else np.zeros(1, np.int64)
    large = ~small
    size = int(s.max()) + 1

    queue, since = SpillingQueue(budget, folder), np.full(size, -1, np.int16)
    done = SpillingQueue(budget, folder)  # the sorted L part of each symbol, then its S part
    separators = lms[: bound[0]]
    if len(separators):
        _induce(s, large, separators, np.zeros(len(separators), np.int16), since, queue, cap)
    for k, c in enumerate(symbols.tolist()):
        before = None
        while (run := queue.pop(c)) is not None:
            _induce(s, large, *run, since, queue, cap)
            done.push(c, *run)
            before = run[0][-1]
        own = lms[bound[k] : bound[k + 1]]
        if len(own):
            value = lms_prefix[bound[k] : bound[k + 1]].copy()
            value[0] = 0 if before is None else pair(before, own[0])
            _induce(s, large, own, value, since, queue, cap)
    queue.close()

    queue, since = SpillingQueue(budget, folder), np.full(size, -1, np.int16)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for c in symbols[::-1].tolist():
        seconds = []
        while (run := queue.pop(c)) is not None:
            _induce(s, small, *run, since, queue, cap)
            seconds.append(run)
        ahead = done.pop(c)
        up_position, up_prefix = (np.zeros(0, position), np.zeros(0, np.int16))
        if seconds:
            down, value = (np.concatenate(x) for x in zip(*seconds, strict=True))
            # downwards, value[i] belongs to the pair (i - 1, i); upwards to (i, i - 1)
            up_position = down[::-1]
            up_prefix = np.append(np.int16(0), value[1:][::-1]).astype(np.int16)
        if ahead is not None:
            position_, value = ahead
            join = pair(position_[-1], up_position[0]) if len(up_position) else np.int16(0)
            _induce(s, small, position_[::-1], np.append(join, value[1:][::-1]).astype(np.int16), since, queue, cap)
            value = value.copy()
            value[0] = 0
            if len(up_position):
                up_prefix[0] = join
            up_position, up_prefix = np.concatenate((position_, up_position)), np.concatenate((value, up_prefix))
        parts.append((up_position, up_prefix))
    queue.close()
    done.close()
    parts.append((separators, np.zeros(len(separators), np.int16)))
    sa, lcp = (np.concatenate(x) for x in zip(*reversed(parts), strict=True))
    return sa, lcp if prefixes else None


def sort_segments(segments: list[bytes], cap: int, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix order, common prefixes, start of each segment) of byte segments, each followed by its separator."""
    lengths = np.array([len(x) + 1 for x in segments])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    s = data.astype(np.int32) + len(segments)
    s[starts + lengths - 1] = np.arange(len(segments))
    return *suffix_sort(s, len(segments), cap, **options), starts
