"""Benchmark items that stand in training documents, also edited ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.align import GAP, MATCH, MISMATCH, align, bands
from tabloom.llm.common import by_id, map_arrow
from tabloom.llm.seeds import Index, Vocabulary, grams, words

SEED_WORDS = 3
SIMILARITY = 0.6             # score of the alignment, as a share of that of the whole item
BLOCK_WORDS = 1_000_000      # words of the items that are looked up in one pass
FOUND = "item_id {item}, similarity double, matched_words int, item_words int, first_word int, last_word int"


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with words, in blocks of about ``block_words`` words; the driver holds one block at a time."""
    counted = items.withColumn("size", F.size(F.split(F.trim("text"), "\\s+")))
    total = counted.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text")
        if block := [(r["item_id"], w) for r in part.collect() if (w := words(r["text"]))]:
            yield block


def _groups(item: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    numbers = vocabulary.of(item)
    size = min(SEED_WORDS, len(numbers))
    return *grams(numbers, size), size


def _seeds(block: list[list[bytes]], vocabulary: Vocabulary) -> dict[int, set[tuple[int, int, int]]]:
    """All word groups of the items as (hash, item, place), by size of the group."""
    entries: dict[int, set] = {}
    for number, item in enumerate(block):
        places, hashes, size = _groups(item, vocabulary)
        entries.setdefault(size, set()).update(zip(hashes.tolist(), repeat(number), places.tolist()))
    return entries


def spare_groups(size: int, similarity: float) -> int:
    """How many groups of an item of ``size`` words may go unindexed and still leave one that stands unchanged.

    An alignment that reaches ``similarity`` loses at most ``MATCH * size * (1 - similarity)``. A replaced or left-out
    word costs ``MATCH`` and ``-MISMATCH`` or ``-GAP`` and touches ``SEED_WORDS`` groups; a word cut off at an end costs
    ``MATCH`` and touches one. What is not touched, but for one, may be left out.
    """
    inside, rest = divmod(MATCH * size * (1 - similarity) + 1e-9, MATCH + min(-MISMATCH, -GAP))
    touched = SEED_WORDS * int(inside) + int(rest / MATCH)
    return max(0, size - SEED_WORDS + 1 - touched - 1)


def _rare(entries: dict[int, set[tuple[int, int, int]]], counts: dict[int, int], sizes: list[int],
          similarity: float) -> dict[int, Index]:
    """Indexes of the groups that occur in the corpus, without the commonest of each item, as many as it can spare."""
    indexes = {}
    for size, found in entries.items():
        of_item: dict[int, list] = {}
        for entry in found:
            if counts.get(entry[0]):
                of_item.setdefault(entry[1], []).append(entry)
        chosen: list[tuple[int, int, int]] = []
        for number, groups in of_item.items():
            spare = spare_groups(sizes[number], similarity) if size == SEED_WORDS else 0
            groups.sort(key=lambda e: (counts[e[0]], e))
            chosen += groups[:max(1, len(groups) - spare)]
        indexes[size] = Index(chosen)
    return indexes


def _counted(rows: DataFrame, shared) -> dict[int, int]:
    """How often every word group of the block stands in all documents; at most one number a word of the block."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted = shared.value
        totals = {size: np.zeros(len(hashes), dtype=np.int64) for size, hashes in wanted.items()}
        for batch in batches:
            for text in batch["text"]:
                document = vocabulary.of(words(text.as_py()))
                for size, hashes in wanted.items():
                    found = grams(document, size)[1]
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    np.add.at(totals[size], at[hashes[at] == found], 1)
        for size, hashes in wanted.items():
            met = np.flatnonzero(totals[size])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[met].view(np.int64)), pa.array(totals[size][met])],
                                             ["hash", "n"])

    total = map_arrow(rows.select("text"), count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    return {r["hash"] & (1 << 64) - 1: r["n"] for r in total.collect()}


def _passages(item: np.ndarray, document: np.ndarray, diagonals: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Bands of diagonals around hits in which the item can have ``least`` words in the document.

    Hits up to a quarter of the item apart share a band. Wide bands are cut into pieces that overlap by half, which is
    further than an alignment with ``least`` agreeing words can drift at one point lost a gap.
    """
    size = len(item)
    reach = max(size, math.ceil(MATCH * (size - least)))
    for low, high in bands(diagonals, max(4, size // 4)):
        for start in range(low, max(high - reach, low + 1), reach):
            end = min(start + 2 * reach, high)
            if np.isin(item, document[max(0, start):max(0, end + size)]).sum() >= least:
                yield start, end


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pairs of document and benchmark item that the document holds, whole or edited.

    Columns: ``doc_id``, ``item_id``, ``similarity`` (score of the best local alignment as a share of the score of the
    whole item), ``matched_words``, ``item_words``, ``first_word`` and ``last_word`` (place of the passage among the
    document's words). One row per pair whose similarity is at least ``similarity``.

    Texts are compared as lower-cased words. The items (``item_id``, ``text``) are the query set: they are looked up in
    blocks of about ``block_words`` words, so what the driver holds and broadcasts is bounded, and every block meets all
    documents. A first pass counts the items' groups of three words over all documents. Seeds are the groups that occur
    at all, without the commonest of each item: as many are left out as ``spare_groups`` allows, so a passage that
    reaches ``similarity`` with words replaced, left out or cut off at the ends always keeps a seed, if the item has nine
    words or more; in shorter items every group is a seed. An inserted word costs less than it touches: a passage is
    then sure to be found while more groups stand unchanged than were left out. A second pass joins documents to items
    on the seeds and aligns each item in bands around its hits, where enough of its words stand. Only counts are
    shuffled, and a document is never compared with an item without a seed.

    NULL and empty texts, of documents or items, match nothing. Items shorter than three words are their own seed.
    Repeated items are looked up once, repeated documents give a row each. Empty tables give an empty result.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    items = items.select("item_id", "text").where("text IS NOT NULL")
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((rows, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, {FOUND.format(item=kinds[1])}"
    result = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, block_words):
        vocabulary = Vocabulary(item for _, item in block)
        numbers = [vocabulary.of(item) for _, item in block]
        entries = _seeds([item for _, item in block], vocabulary)
        context = docs.sparkSession.sparkContext
        wanted = {s: np.unique(np.array([e[0] for e in found], dtype=np.uint64)) for s, found in entries.items()}
        counts = _counted(rows, context.broadcast((vocabulary, wanted)))
        indexes = _rare(entries, counts, [len(n) for n in numbers], similarity)
        shared = context.broadcast((vocabulary, indexes, numbers, [name for name, _ in block]))
        result = result.unionByName(map_arrow(rows, _matcher(shared, similarity, kinds), schema))
    return result


def _matcher(shared, similarity: float, kinds: list[bytes]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, indexes, numbers, names = shared.value
        stands = np.zeros(len(vocabulary.numbers) + 1, dtype=bool)     # words of the block that the document has
        for batch in batches:
            out: list[tuple] = []
            for place, text in enumerate(batch["text"]):
                document = vocabulary.of(words(text.as_py()))
                hits = [index.hits(*grams(document, size)) for size, index in indexes.items()]
                query, diagonal = (np.concatenate(x) for x in zip(*hits))
                if not len(query):
                    continue
                stands[document] = True
                likely = [k for k in np.unique(query).tolist() if stands[numbers[k]].sum() >= similarity * len(numbers[k])]
                stands[document] = False
                for k in likely:
                    item = numbers[k]
                    # every word that agrees adds MATCH at most, so a passage needs this share of the item's words
                    found = (align(item, document, low, high)
                             for low, high in _passages(item, document, diagonal[query == k], similarity * len(item)))
                    best = max(found, key=lambda a: a.score, default=None)
                    if best and best.score >= similarity * MATCH * len(item):
                        out.append((place, names[k], best.score / (MATCH * len(item)), best.matches, len(item),
                                    best.text_start, best.text_end - 1))
            if out:
                columns = list(zip(*out))
                types = [batch["doc_id"].type, pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(columns[0])), pa.array(columns[1]), pa.array(columns[2], types[1]),
                     *(pa.array(c, types[2]) for c in columns[3:])],
                    ["doc_id", "item_id", "similarity", "matched_words", "item_words", "first_word", "last_word"])
    return match


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, without those that hold a benchmark item."""
    found = contaminated(docs, items, similarity, id_column=id_column, text_column=text_column)
    return by_id(docs, found.select("doc_id"), "left_anti", id_column)
