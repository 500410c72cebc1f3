"""How document filters interact: what each removes, and what is left to it, in every order of application."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
SEGMENT_CELLS = 1 << 15        # cells of a segment of the sketch: the bits of one built-in bitmap
SEGMENT_TEXTS = 1 << 11        # texts that a segment is planned for, so 16 cells each
CELL_BITS = 15
SENT_BYTES = 256 << 20         # a sketch up to this size is sent to every executor, a larger one is joined
MOST_FILTERS = 6               # every order is reported, and there are factorially many


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words (A), repeated words (B), capitals (C), symbols (D)."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return {"A": F.size(words) < 100,
            "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def _cells(text_hash: Column, segments: int) -> list[Column]:
    """Segment of the sketch and the text's two cells in it, from separate bits of a 64-bit hash."""
    def bits(start: int, size: int) -> Column:
        return F.shiftrightunsigned(text_hash, start).bitwiseAND(F.lit((1 << size) - 1))
    return [text_hash.bitwiseAND(F.lit(segments - 1)).alias("segment"),
            bits(64 - CELL_BITS, CELL_BITS).alias("one"), bits(64 - 2 * CELL_BITS, CELL_BITS).alias("two")]


def repeat_sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """Counting Bloom filter of the 64-bit hashes in the first column: per ``segment`` a bitmap of the cells met twice.

    Every task counts its own cells and the counts are added up, so a text of any frequency sends one count per task and
    cell. Only whether a count reaches two is kept. ``segments`` is a power of two.
    """
    segment, one, two = _cells(F.col(hashes.columns[0]), segments)
    met = (hashes.select(segment, F.explode(F.array_distinct(F.array(one, two))).alias("cell"))
           .groupBy("segment", "cell").count().where("count > 1"))
    return met.groupBy("segment").agg(F.bitmap_construct_agg("cell").alias("bits"))


def _is_set(bits: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (cell % 8).cast("int")) == 1


def possible_repeats(rows: DataFrame, sketch: DataFrame, segments: int, hash_column: str) -> DataFrame:
    """The rows whose two cells were both met twice; every other row's text is the only one of its kind."""
    size = sketch.count() * SEGMENT_CELLS // 8
    names = rows.columns
    segment, one, two = _cells(F.col(hash_column), segments)
    right = sketch.withColumnRenamed("segment", "__segment").withColumnRenamed("bits", "__bits")
    # the check above bounds what is sent; a larger sketch is joined by segment, which Spark may split
    right = F.broadcast(right) if size <= SENT_BYTES else right
    placed = rows.select("*", segment.alias("__at"), one.alias("__one"), two.alias("__two"))
    return (placed.join(right, F.col("__at") == F.col("__segment"))
            .where(_is_set(F.col("__bits"), F.col("__one")) & _is_set(F.col("__bits"), F.col("__two"))).select(*names))


def first_ids(repeats: DataFrame) -> DataFrame:
    """``key`` (SHA-256 of the text) and ``first`` (smallest id) of the texts that occur more than once, compared whole."""
    return (repeats.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select(_key(F.col("text")).alias("key"), "first"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filter_masks(docs: DataFrame, labels: DataFrame | None = None,
                 filters: Callable[[Column], dict[str, Column]] = standard_filters, id_column: str = "doc_id",
                 text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """Number of documents per ``part`` and ``mask`` of failed filters, with those of good quality and the toxic ones.

    Bit ``k`` of ``mask`` stands for the ``k``-th filter; the bit above fails documents whose text a smaller id has too.
    Texts are read twice: once for the other filters and the hashes, once with the merged sketch, which clears texts that
    occur once for certain. Only the others are shuffled, combined per task first, and grouped whole; their smallest ids
    come back to the documents by SHA-256, a plain equi-join that Spark may split where one text is frequent.

    Columns: ``part``, ``mask``, ``n``, ``good`` (label quality 1), ``toxic`` (label toxic 1). NULL text counts as empty,
    a NULL part as an empty string. A NULL id is neither smaller nor larger than another. Several labels of an id count
    once: good or toxic if any of them is. Repeated rows count each. An empty table gives an empty result.
    """
    base = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"),
                       F.coalesce(docs[part_column].cast("string"), F.lit("")).alias("part"))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(filters(F.col("text")).values())]
    slim = stored(base.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"),
                              F.xxhash64("text").alias("text_hash"), _key(F.col("text")).alias("key")), "filter-masks")
    segments = 1 << max(0, (slim.count() - 1) // SEGMENT_TEXTS).bit_length()
    sketch = stored(repeat_sketch(slim.select("text_hash"), segments), "repeat-sketch")
    texts = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    firsts = stored(first_ids(possible_repeats(texts, sketch, segments, "text_hash")), "first-ids")
    late = F.when(F.col("doc_id") > F.col("first"), 1 << len(bits)).otherwise(0)
    rows = slim.join(firsts, "key", "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"))
    if labels is None:
        rows = rows.select("part", "mask", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    else:
        marks = labels.groupBy(F.col(id_column).alias("label_id")).agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"))
        rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
            "part", "mask", F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic"))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("is_good").alias("good"),
                                            F.sum("is_toxic").alias("toxic"))


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """What every filter does at every step of every order, from the counts that ``filter_masks`` gives.

    ``letters`` names the filters, that of repeats last. One row, zeros included, per ``part``, ``filter_order`` (all
    orders of the letters) and ``step`` (from 1): documents ``kept`` after it, ``removed`` by it, ``redundant`` (failing
    it, removed before), ``unique_fails`` (failing it alone), ``good_lost`` and ``toxic_lost`` (among the removed), and
    ``shapley``, what the filter removes summed over all orders. A mask of ``c`` filters is removed by each of them in
    one order of ``c``, so every number is a sum over the masks of a part; there are at most ``2 ** len(letters)``.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed")
    steps = [(order, k + 1, sum(1 << letters.index(c) for c in order[:k]), 1 << letters.index(order[k]))
             for order in map("".join, permutations(letters)) for k in range(len(letters))]
    names = ("filter_order", "step", "before", "own")
    plan = F.from_json(F.lit(json.dumps([dict(zip(names, s)) for s in steps])),
                       "array<struct<filter_order: string, step: int, before: int, own: int>>")
    each = masks.select("*", F.inline(plan))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    early = F.col("mask").bitwiseAND(F.col("before")) != 0
    passes = F.col("mask").bitwiseAND(F.col("own").bitwiseOR(F.col("before"))) == 0

    def total(condition: Column, count: str | Column = "n") -> Column:
        return F.sum(F.when(condition, F.col(count) if isinstance(count, str) else count).otherwise(F.lit(0).cast("bigint")))

    orders = factorial(len(letters))
    return each.groupBy("part", "filter_order", "step").agg(
        total(passes).alias("kept"), total(fails & ~early).alias("removed"), total(fails & early).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~early, "good").alias("good_lost"),
        total(fails & ~early, "toxic").alias("toxic_lost"),
        total(fails, F.expr(f"n * {orders} div bit_count(mask)")).alias("shapley"))
