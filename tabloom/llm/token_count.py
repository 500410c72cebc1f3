"""Token counts of byte-level byte-pair vocabularies, by heap and linked list."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabloom.llm.common import id_and_text, map_arrow

# fixed value: how byte-level vocabularies cut a text into pieces before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1 << 19       # pieces whose count a worker remembers
CACHED_CHARS = 32      # longer pieces are counted anew


def _byte_names() -> list[str]:
    """Characters that stand for the 256 bytes: printable ones for themselves, the rest from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(free)
            free += 1
    return [names[b] for b in range(256)]


class TokenCounter:
    """Counts the tokens of texts as the library for the vocabulary file gives them, without making their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or parts["normalizer"] or cut["add_prefix_space"] \
                or not cut.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        names = {c: b for b, c in enumerate(_byte_names())}
        symbols: dict[bytes, int] = {bytes([b]): b for b in range(256)}

        def number(name: str) -> int:
            return symbols.setdefault(bytes(names[c] for c in name), len(symbols))

        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[number(left), number(right)] = rank, number(left + right)
        special = [t for t in parts["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take in their surroundings aren't known")
        special = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def of_piece(self, piece: bytes) -> int:
        """Symbols at first, less one for every merge: the lowest-ranked adjacent pair, leftmost of equals, goes first."""
        n = count = len(piece)
        symbol, following, previous = list(piece), [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(*found, i) for i in range(n - 1) if (found := ranks.get((symbol[i], symbol[i + 1])))]
        heap = [(rank, i, symbol[i], symbol[i + 1], made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = following[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue                      # one of the two has been merged since
            symbol[i], symbol[j] = made, -1
            after = following[i] = following[j]
            count -= 1
            if after >= 0:
                previous[after] = i
                if found := ranks.get((made, symbol[after])):
                    heapq.heappush(heap, (found[0], i, made, symbol[after], found[1]))
            if (before := previous[i]) >= 0 and (found := ranks.get((symbol[before], made))):
                heapq.heappush(heap, (found[0], before, symbol[before], made, found[1]))
        return count

    def of_text(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens count as one token each."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.of_text(p) for p in parts)
        known, total = self.known, 0
        for piece, times in Counter(self.pieces.findall(text)).items():
            count = known.get(piece)
            if count is None:
                count = self.of_piece(piece.encode("utf-8"))
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = count
            total += times * count
        return total


_counters: dict[str, TokenCounter] = {}      # one per worker and file; it remembers pieces from task to task


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every document.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's form, readable on every executor.
    Counts are those of the library without added tokens; special strings inside a text count as one token, as the
    library takes them. A piece is merged by a heap of adjacent pairs over a linked list, so a piece of any length
    costs n log n. Documents are independent: one pass, no shuffle; a worker remembers a bounded number of pieces.

    NULL text counts as empty: 0 bytes, 0 tokens. NULL ids and repeated rows are returned as they are. An empty table
    gives an empty result.
    """
    rows = id_and_text(docs, id_column, text_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            texts = batch["text"].to_pylist()
            tokens = np.array([counter.of_text(t) for t in texts], dtype=np.int64)
            sizes = np.array([len(t.encode("utf-8")) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
