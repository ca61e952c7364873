"""Vectorised 64-bit hashes of bytes, words and shingles."""

from __future__ import annotations

import numpy as np

#: An odd base and its inverse modulo 2**64; powers are kept as far as they were needed.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: What each byte adds: drawn once from a fixed seed.
BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 512, dtype=np.uint64).reshape(2, 256) | np.uint64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray, row: int = 0) -> np.ndarray:
    """Sums of byte values times powers; ``between`` takes the hash of any stretch from them."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[row][data] * powers(len(data)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identity of the bytes from start up to end, the same wherever they stand; lengths are part of it."""
    h = (sums[end] - sums[start]) * powers(len(sums), True)[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: ASCII white space as the shingle operators have it.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has. A-Z count as a-z."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    limits = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    return between(prefix(data), starts, ends), counts


#: Characters that are hashed together.
TOGETHER = 1 << 20


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``width`` words; with fewer words, all of them as one; without, none."""
    out: list[np.ndarray] = []
    a, size = 0, 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or b + 1 == len(texts):
            out += _shingle_sets(texts[a : b + 1], width)
            a, size = b + 1, 0
    return out


def _shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(width, n)
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ w[j : n - k + 1 + j]) * BASE
            h ^= h >> np.uint64(29)
        out.append(np.unique(mix(h)))
    return out
