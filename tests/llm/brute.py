"""Plain restatements of what the corpus operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def top_entropy(s: str, window: int) -> float:
    return max([0.0, *(entropy(s[i : i + window]) for i in range(len(s) - window + 1))])


def substring_dedup(docs: list[tuple[int | None, str | None]], window: int = 20) -> list[tuple[int | None, int, int, str]]:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = [(i, (t or "").encode().split()) for i, t in docs]
    rank = lambda i: (1 << 63) - 1 if i is None else i
    least: dict[tuple, int] = {}
    for i, words in rows:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            least[w] = min(least.get(w, rank(i)), rank(i))
    out = []
    for i, words in rows:
        gone, seen = [False] * len(words), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if least[w] < rank(i) or w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text: str | None, k: int = 4) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(keys: list[int], near) -> list[int]:
    """The least index that each key reaches over near pairs."""
    up = list(range(len(keys)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]
