"""Word shingles as 64-bit hashes, in numpy: shared by near-duplicate search and its brute-force tests."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit word hashes with a memory of frequent words; the memory is emptied when it holds `most` words."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in words:
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, hasher: WordHasher, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles of the text; with fewer words, of the whole sequence; empty without words.

    Only A-Z are lower-cased; words are split at space and U+0009 to U+000D, which is what bytes.split() does.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out ^ (h[i : i + n] * _MUL[i % 8] + np.uint64(i)))
    return np.unique(out)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, on sorted distinct arrays; false where either is empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)
