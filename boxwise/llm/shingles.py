"""Words, hashed five-word shingles and MinHash bands, vectorised over blocks of texts."""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import numpy as np

WORDS = 5
WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        found = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(texts: list[str], hashes: WordHashes, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, one after the other, and the number that each text has.

    A text of fewer words has one shingle, its words padded; a text without words has none."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = words(text)
        if own:
            flat += own
            if len(own) < n:
                flat += [""] * (n - len(own))
            counts[k] = max(len(own), n)
    if not flat:
        return np.zeros(0, np.uint64), counts
    w = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
    total = len(w) - n + 1
    s = np.zeros(total, np.uint64)
    for k in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + w[k : k + total]
    ends = np.cumsum(counts)
    keep = np.ones(total + n - 1, bool)
    for k in range(1, n):  # the last n - 1 words of a text start no shingle
        keep[(ends[counts > 0] - k)] = False
    return mix(s[keep[:total]]), np.maximum(counts - (n - 1), 0)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The number of bands of so many rows that gives a pair at the threshold at least this chance to meet."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def minhash_bands(flat: np.ndarray, counts: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """64-bit band keys, one row per text; texts without shingles get zeros."""
    out = np.zeros((len(counts), bands), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.cumsum(counts[full]) - counts[full]
    x = (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat(x * a[k] + b[k], starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        out[full, band] = key
    return out


def intersections(sets: list[np.ndarray], often: int = 12) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted distinct arrays.

    Values that few sets hold are counted pair by pair, the others by products of 0/1 matrices."""
    n = len(sets)
    inter = np.zeros((n, n), np.float32)
    col = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(col):
        return inter
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    starts = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    counts = np.diff(np.r_[starts, len(col)])
    for c in range(2, often + 1):
        own = starts[counts == c]
        if not len(own):
            continue
        members = doc[own[:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        for lo in range(0, len(own), max(1, 2_000_000 // len(i))):
            part = members[lo : lo + max(1, 2_000_000 // len(i))]
            inter += np.bincount((part[:, i] * n + part[:, j]).ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    own = np.flatnonzero(counts > often)
    wide = max(1, min(4096, 8_000_000 // n))
    for lo in range(0, len(own), wide):
        part = own[lo : lo + wide]
        c = counts[part]
        at = np.repeat(starts[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        m = np.zeros((n, len(part)), np.float32)
        m[doc[at], np.repeat(np.arange(len(part)), c)] = 1
        inter += np.triu(m @ m.T, 1)
    return inter + inter.T
