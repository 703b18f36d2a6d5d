"""Plain versions of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def crc(doc_id, mod: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def groups(n: int, near) -> list[int]:
    """Root (least index) of each of n things under the relation near(i, j)."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if near(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, width: int = 3) -> int:
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows: list[tuple], radius: int = 2) -> list[tuple]:
    """(id, fingerprint, component id) of rows (id, text)."""
    fps = [simhash(t) for _, t in rows]
    roots = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r].append(i)
    return [(i, f"{f:016x}", min(least[r]) if least[r] else None) for (i, _), f, r in zip(rows, fps, roots, strict=True)]


def remove_repeats(rows: list[tuple], size: int = 35) -> list[tuple]:
    """(id, words, removed, kept) of rows (id, text)."""
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def targets(sizes: dict, share: float = 1.5, most: float = 2.0, weights=(3, 1, 2)) -> dict:
    """Round by round: deal by weight, cap, deal the excess again to those that are not capped."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[k] for k in free)
        over = [k for k in free if left * w[k] / total > most * sizes[k]]
        if not over:
            return out | {k: left * w[k] / total for k in free}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            free.discard(k)
    return out


def line_dedup(rows: list[tuple], ratio: float = 0.1, least: int = 2) -> list[str | None]:
    """Kept text of rows (host, text)."""
    pages = Counter(h for h, _ in rows)
    held = Counter((h, x) for h, t in rows if t is not None for x in set(t.split("\n")) if x)
    bad = {k for k, n in held.items() if n >= least and n > pages[k[0]] * ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for h, t in rows]


def leaks(docs: list[tuple], items: list[tuple], width: int = 5, share: float = 0.8) -> set[tuple]:
    """(doc id, item id, shared, shingles) of rows (id, text)."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        w = split(t)
        if not w:
            continue
        k = min(width, len(w))
        own = cut(w, k)
        held = defaultdict(set)
        for d, x in docs:
            held[d] |= own & cut(split(x), k)
        out |= {(d, i, len(h), len(own)) for d, h in held.items() if len(h) >= math.ceil(len(own) * share - 1e-9)}
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def similar(texts: list, width: int = 5, least: float = 0.8) -> list[int]:
    """Least index of each text's group under links of equal or similar shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({b" ".join(w)} if w else set()))
    return groups(len(sets), lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9)
