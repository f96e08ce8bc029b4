"""Words and their five-word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
WORD_CACHE, LONG_WORD = 250_000, 100
#: ASCII characters that are no letters or digits part words; what is above ASCII stays.
WORD_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and characters above ASCII."""
    return text.lower().encode().translate(WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one to one, every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    return x


class Hashes(dict):
    """64-bit hashes of words, made when they are first asked for; long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


class WordHasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self) -> None:
        self.known = Hashes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def windows_at(words: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at these places."""
    out = None
    for k in range(size):
        part = words[at.start + k : at.stop + k] if isinstance(at, slice) else words[at + k]
        out = part * STEP if out is None else (out ^ (out >> np.uint64(29))) * MIX[0] + part * STEP
    return mix(out + np.uint64(size))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of a shorter, non-empty text its one run of all words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    return windows_at(words, slice(0, n - size + 1), size)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct shingles in ascending order; a text of one to four words has one shingle, an empty text has none."""
    return np.unique(windows(words, SHINGLE))
