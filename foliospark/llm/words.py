"""Word sequences and their alignment, used inside Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """The words of a text; case, spacing and punctuation do not count."""
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


class Hashes(dict):
    """64-bit hashes of words, worked out once; emptied when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(tokens: list[str], known: Hashes) -> np.ndarray:
    """64-bit hashes of the tokens; ``known`` keeps what was hashed before."""
    return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(a: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of the SplitMix generator)."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, given the hashes of the words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
