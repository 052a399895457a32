"""Word, shingle and MinHash arithmetic on NumPy arrays, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 20)) * _GOLD)


class WordHasher:
    """64-bit word hashes, remembered within one partition up to a fixed number of words."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k consecutive words, sorted; empty below k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            acc = mix(acc + words[i : i + n] + _GOLD)
    return np.unique(acc)


def set_digest(items: np.ndarray) -> int:
    """64-bit digest of a sorted set, as a signed integer for Spark's BIGINT."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).astype(np.int64)))


def minhash(sets: list[np.ndarray], perms: np.ndarray, block: int = 16) -> np.ndarray:
    """Row i: the minima of sets[i] under each permutation. Sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(perms)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(perms), block):
            p = perms[i : i + block]
            h = (flat[:, None] ^ p[None, :]) * (p | np.uint64(1))[None, :]
            h ^= h >> np.uint64(29)
            h *= _M2
            out[:, i : i + block] = np.minimum.reduceat(h, starts, axis=0)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of `rows` signature columns; the band number is part of it."""
    n, m = sig.shape
    bands = m // rows
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(seeds(bands, 77)[None, :], (n, bands)).copy()
        for r in range(rows):
            acc = mix(acc + sig[:, r : bands * rows : rows])
    return acc.astype(np.int64)


def low_bits(sig: np.ndarray, bits: int = 8) -> np.ndarray:
    """b-bit fingerprint of the signature. The top bits of a minimum are nearly all zero, so it is mixed first."""
    return (mix(sig) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def segment_keys(code: np.ndarray, width: int) -> np.ndarray:
    """The segments of `width` bytes (at most 6) of each code as numbers; the segment's number is part of it."""
    n, m = code.shape
    segments = m // width
    acc = np.broadcast_to(np.arange(segments, dtype=np.int64)[None, :], (n, segments)).copy()
    for r in range(width):
        acc = (acc << 8) | code[:, r : segments * width : width].astype(np.int64)
    return acc
