"""Word hashing for the operators that work on word n-grams.

Words are the maximal runs between white space. Their hashes are kept in a bounded table in each Python
worker, so that a word costs one dictionary look-up when it comes again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

#: Entries after which a worker's table of known words starts anew; bounds its memory to about 50 MB.
KNOWN_WORDS = 250_000


class WordTable(dict):
    """word -> number, computed by ``number`` on the first sight of a word."""

    def __init__(self, number, limit: int = KNOWN_WORDS):
        super().__init__()
        self._number, self._limit = number, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._number(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


EDGES = re.compile(r"^\W+|\W+$")


def bare(word: str) -> str:
    """Lower case without the punctuation around it; pure punctuation stays as it is."""
    low = word.lower()
    return low if low.isalnum() else EDGES.sub("", low) or low


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(bare(word))


#: Multipliers that give each place of an n-gram its weight (odd 64-bit numbers, from the golden ratio).
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of ``size``-word shingles, sorted; a text of fewer words is one shingle, none has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(size, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(GOLDEN) + words[i : n - k + 1 + i] + np.uint64(k))
    return np.unique(total)


#: Bytes of a word from which its digest stands for it in tables that are broadcast, so that their size has a bound.
LONG_WORD = 64
#: Bytes of a text that are cut into words at a time.
CHUNK_BYTES = 4 << 20


def byte_table(kept: str) -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, bytes of ``kept`` and of non-ASCII characters as they are, all others a space."""
    stay = {*kept.encode(), *range(0x80, 0x100)}
    return bytes(b if b in stay else b + 32 if 0x41 <= b <= 0x5A and b + 32 in stay else 0x20 for b in range(256))


def chunks(text: bytes, table: bytes):
    """The translated text in pieces of about CHUNK_BYTES that end between words; a longer word is not cut."""
    if len(text) <= CHUNK_BYTES:
        yield text.translate(table)
        return
    lo = 0
    whole = text.translate(table)
    while lo < len(whole):
        hi = whole.find(b" ", lo + CHUNK_BYTES)
        hi = len(whole) if hi < 0 else hi
        yield whole[lo:hi]
        lo = hi


def short(word: bytes) -> bytes:
    """The word, or a mark that no word has and its SHA-256 if it is long."""
    return word if len(word) <= LONG_WORD else b"\x01" + hashlib.sha256(word).hexdigest().encode()
