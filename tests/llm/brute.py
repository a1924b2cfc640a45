"""Plain, slow versions of the operators' results."""

from __future__ import annotations

import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = b" \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    out, now = [], bytearray()
    for b in (text or "").encode():
        if b in SPACE:
            if now:
                out.append(bytes(now))
            now = bytearray()
        else:
            now.append(b)
    return [*out, bytes(now)] if now else out


def simhash(text: str | None, size: int = 4) -> int:
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    shingles = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints: list[int], distance: int = 4) -> list[int]:
    """The lowest index that each index reaches."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(a) for a in range(len(prints))]


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    """The lowest id each id reaches over pairs of Jaccard ``similarity`` or more."""
    sets = {d: shingles(t) for d, t in sorted(texts.items())}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in sets.items():
        for b, y in sets.items():
            if b < a and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and (x == y or len(x & y) / len(x | y) >= similarity):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in sets}


def repeated(docs: list[tuple[int, str | None]], n: int = 50) -> dict[int, dict[int, int]]:
    """doc -> start of each n-word stretch that two documents hold -> the lowest
    doc that holds it."""
    where = defaultdict(set)
    for doc, text in docs:
        w = words(text)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add((doc, k))
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for spots in where.values():
        if len({d for d, _ in spots}) > 1:
            for d, k in spots:
                out[d][k] = min(x for x, _ in spots)
    return out


def cut(text: str, starts: list[int], n: int = 50) -> str:
    """``text`` without the stretches at ``starts``."""
    raw, spans, at = text.encode(), [], 0
    for w in words(text):
        at = raw.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    gone = {k for s in starts for k in range(s, s + n)}
    parts, k = [], 0
    while k < len(spans):
        if k in gone:
            k += 1
            continue
        e = k
        while e + 1 < len(spans) and e + 1 not in gone:
            e += 1
        parts.append(raw[0 if k == 0 else spans[k][0] : len(raw) if e + 1 == len(spans) else spans[e][1]])
        k = e + 1
    return b"\n".join(parts).decode()


def best_fit(lengths: list[int], capacity: int) -> int:
    """Bins that best-fit decreasing opens, piece by piece."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(best := min(fits))
            rooms.append(best - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def top_k(vectors: list[tuple[int, list | None]], k: int = 10, every: int = 100) -> list[tuple[int, int, int, int]]:
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in kept if i % every == 0}):
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for own, q in kept if own == i for j, c in kept if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = 200) -> dict[tuple, float]:
    weight, total = dict(cells), sum(cells.values())
    for _ in range(rounds):
        for axis, want in enumerate(targets):
            have = Counter()
            for c, v in weight.items():
                have[c[axis]] += v
            whole = sum(want.values())
            weight = {c: v * (want[c[axis]] / whole * total / have[c[axis]] if have[c[axis]] else 1) for c, v in weight.items()}
    return {c: weight[c] / cells[c] if cells[c] else 1.0 for c in cells}


def unit(doc: int, seed: int = 7) -> float:
    """xxhash64(doc_id, seed) as a fraction."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
    return (h >> 11) / float(1 << 53)


def kneser_ney(trusted: list[list[int]], size: int, cut_off) -> callable:
    """Interpolated modified Kneser-Ney trigrams by the textbook; ``cut_off``
    turns counts of counts into discounts."""
    tri, bi, uni = Counter(), Counter(), Counter()
    for s in trusted:
        s = [0, 0, *s]
        tri.update(zip(s, s[1:], s[2:]))
    for _, v, w in tri:
        bi[v, w] += 1
    for _, w in bi:
        uni[w] += 1
    d3, d2, d1 = (cut_off([sum(1 for c in t.values() if c == k) for k in (1, 2, 3, 4)]) for t in (tri, bi, uni))
    whole = sum(uni.values())
    spare1 = sum(d1[min(c, 3)] for c in uni.values()) / whole

    def p1(w):
        return max(uni[w] - d1[min(uni[w], 3)], 0) / whole + spare1 / size

    after2, after3 = defaultdict(dict), defaultdict(dict)
    for (v, w), c in bi.items():
        after2[v][w] = c
    for (u, v, w), c in tri.items():
        after3[u, v][w] = c

    def p2(v, w):
        row = after2[v]
        if not row:
            return p1(w)
        n = sum(row.values())
        return max(row.get(w, 0) - d2[min(row.get(w, 0), 3)], 0) / n + sum(d2[min(c, 3)] for c in row.values()) / n * p1(w)

    def p3(u, v, w):
        row = after3[u, v]
        if not row:
            return p2(v, w)
        n = sum(row.values())
        return max(row.get(w, 0) - d3[min(row.get(w, 0), 3)], 0) / n + sum(d3[min(c, 3)] for c in row.values()) / n * p2(v, w)

    def perplexity(s):
        if not s:
            return None
        s = [0, 0, *s]
        return float(np.exp(-np.mean([np.log(p3(*x)) for x in zip(s, s[1:], s[2:])])))

    return perplexity
