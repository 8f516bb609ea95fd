"""Words of whole texts as 64-bit numbers, computed for many texts at once.

A word is a longest run of 0-9, a-z and characters beyond ASCII, after A-Z are
made lower case; in UTF-8 that is a property of single bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = IS_LETTER[128:] = True
IS_SOLID = np.ones(256, bool)
IS_SOLID[32] = IS_SOLID[9:14] = False
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            step = np.full(max(n, 1 << 16), x, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_words(
    data: np.ndarray, ends: np.ndarray, members: np.ndarray = IS_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start byte, end byte) of every word in texts laid end to end; ``ends`` are n + 1 offsets.

    ``members`` says of each lower-cased byte whether it belongs to a word.
    """
    low = LOWER[data]
    inside = members[low]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    up, down = powers(n)
    value = (low.astype(np.uint64) + np.uint64(1)) * up
    value[~inside] = 0
    sums = np.add.reduceat(value, start) * down[start]
    return mix(sums + (stop - start).astype(np.uint64)), np.searchsorted(ends, start, "right") - 1, start, stop


def shingles(words: np.ndarray, owner: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row and the text of each; a shorter text with words is one shingle of them all."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.bincount(owner, minlength=texts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    if n >= k:
        sums = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            sums += words[j : n - k + 1 + j] * factors[j]
        ok = owner[: n - k + 1] == owner[k - 1 :]
        full, of = mix(sums[ok]), owner[: n - k + 1][ok]
    else:
        full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = counts[short].astype(np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            sums[has] += words[begin[short[has]] + j] * factors[j]
        full, of = np.concatenate([full, mix(sums)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return full, of


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    words, owner, _, _ = find_words(data, ends)
    texts = len(ends) - 1
    hashes, of = shingles(words, owner, texts, k)
    cut = np.searchsorted(of, np.arange(texts + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def set_key(items: np.ndarray) -> bytes | None:
    """A 128-bit name of a set of hashes; none for an empty set."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None
