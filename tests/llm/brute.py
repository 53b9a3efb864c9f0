"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter


def repeats(texts: dict[int, str | None], length: int) -> dict[int, tuple]:
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    data = {k: (t or "").encode("utf-8", "surrogatepass") for k, t in texts.items()}
    seen = Counter(d[i : i + length] if length < 64 else hash(d[i : i + length]) for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            s = d[i : i + length]
            if seen[s if length < 64 else hash(s)] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_list(text: str | None) -> list[str]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = (text or "").translate(str.maketrans(upper, upper.lower()))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text: str | None, size: int = 5) -> set[tuple]:
    w = word_list(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_duplicates(texts: dict[int, str | None], percent: int, size: int = 5) -> dict[int, tuple]:
    """{id: (n_shingles, component_id, kept)}."""
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    holders: dict[tuple, list[int]] = {}
    for k in sorted(sets):
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    both = Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}
