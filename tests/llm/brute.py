"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op1(docs: list[tuple[int, str | None]], size: int = 200) -> list[tuple]:
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def op4(docs: list[tuple[int, str | None]], size: int = 50) -> list[tuple]:
    data = [(d, words(t)) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, w in data:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in data:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def op6(pages: list[tuple[int, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    for p, h in pages:
        b = (h or "").encode()
        first[b] = min(first.get(b, p), p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]))
    return sorted(out)


def op7(docs: list[tuple[int, str | None]]) -> list[tuple]:
    out = []
    for d, t in docs:
        w, lines, seen, dup = words(t), (t or "").split("\n"), set(), 0
        for x in lines:
            if words(x):
                dup += x in seen
                seen.add(x)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return sorted(out)


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def op8(docs: list[tuple[int, str | None]]) -> list[tuple]:
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def op10(docs: list[tuple[int, str | None]]) -> list[tuple]:
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(UP)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out)
