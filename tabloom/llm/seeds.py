"""Word sequences of a small query set, looked up in every document."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import repeat

import numpy as np

WORD = re.compile(r"\w+")
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_SPACED = bytes(c if chr(c).isalnum() or c == ord("_") or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores, in UTF-8. What ``WORD`` finds in the lower-cased text, faster."""
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end, in characters of ``text``, of each of its ``words``."""
    lowered = text.lower()
    found = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
    if len(lowered) == len(text):
        return found
    at = [i for i, c in enumerate(text) for _ in c.lower()]      # some letters are longer when lower-cased
    return [(at[a], at[b - 1] + 1) for a, b in found]


class Vocabulary:
    """Numbers of the words of the query set; 0 for all others."""

    def __init__(self, texts: Iterable[Sequence[bytes]]):
        self.numbers: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                self.numbers.setdefault(word, len(self.numbers) + 1)

    def of(self, text: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, text, repeat(0)), dtype=np.int64, count=len(text))


def grams(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the word groups of ``size`` words that are all in the vocabulary."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    known = np.concatenate([[0], np.cumsum(numbers == 0)])
    places = np.flatnonzero(known[size:] == known[:n])
    h = np.zeros(len(places), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ numbers[places + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return places, h


class Index:
    """Places of chosen word groups in the query set, by hash; every hit is checked word by word by the alignment."""

    def __init__(self, entries: Iterable[tuple[int, int, int]]):
        found = sorted(entries)                                        # hash, query, place
        self.hashes = np.array([f[0] for f in found], dtype=np.uint64)
        self.query = np.array([f[1] for f in found], dtype=np.int64)
        self.place = np.array([f[2] for f in found], dtype=np.int64)

    def hits(self, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and diagonal (document place less query place) of every group of a document that is indexed."""
        first = np.searchsorted(self.hashes, hashes, "left")
        count = np.searchsorted(self.hashes, hashes, "right") - first
        chosen = np.flatnonzero(count)
        count = count[chosen]
        entry = np.repeat(first[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.query[entry], np.repeat(places[chosen], count) - self.place[entry]
