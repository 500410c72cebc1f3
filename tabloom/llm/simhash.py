"""Near duplicates by SimHash fingerprints, compared at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import by_id, id_and_text, map_arrow, stored
from tabloom.llm.components import components

SEED = 42
MASK = (1 << 64) - 1
CHUNK = 65536          # shingles whose bits are counted at a time
CODE_BITS = 31         # length of the Hamming code whose words are the anchors; covering radius 1
HALVES = (0, 32)       # where the compared halves of a fingerprint start
FIRST_DRAWS = 2        # draws that group most copies, before the others are linked
NEXT_DRAWS = 6         # further draws linked at a time
FIRST_BITS = (1, 2, 3) # bits at which the first draws are linked, one after the other, before the largest number


def _mixed(hashes: np.ndarray, draw: int) -> np.ndarray:
    """The hashes themselves for draw 0, other hashes of the same shingles for every further draw."""
    if not draw:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(draw * 0x9E3779B97F4A7C15 & MASK)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest first; 255 rows at a time fit a byte."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    return counts + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, words: int, draws: int = 1) -> list[int]:
    """Bits set in over half the hashes of the text's word shingles, repeats counted; 0 without words. One per draw."""
    found = text.encode("utf-8").lower().split()      # of bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D only
    if not found:
        return [0] * draws
    size = min(words, len(found))
    total = len(found) - size + 1
    counts = np.zeros((draws, 64), dtype=np.int64)
    for start in range(0, total, CHUNK):
        piece = found[start:min(start + CHUNK, total) + size - 1]
        shingles = map(b" ".join, zip(*(piece[i:] for i in range(size))))
        hashes = np.frombuffer(b"".join(xxhash.xxh64_digest(s, SEED) for s in shingles), dtype=">u8").astype(np.uint64)
        for draw in range(draws):
            counts[draw] += _bit_counts(_mixed(hashes, draw))
    return [int.from_bytes(np.packbits(2 * c > total).tobytes(), "big") for c in counts]


def fingerprints(docs: DataFrame, words: int = 3, draws: int = 1, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fps``, the 64-bit fingerprints of all draws, of every document."""
    rows = id_and_text(docs, id_column, text_column)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words, draws) for t in batch["text"]]
            flat = np.array(values, dtype=np.uint64).reshape(-1).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * draws), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], fps], ["doc_id", "fps"])

    return map_arrow(rows, of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fps array<bigint>")


def _syndrome(x: Column) -> Column:
    """Exclusive-or of the numbers (from 1) of the bits that are set; 0 for code words."""
    masks = [sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> j & 1) for j in range(5)]
    bit = [F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(m))) % 2, j) for j, m in enumerate(masks)]
    return sum(bit[1:], bit[0])


def _home(x: Column, syndrome: Column) -> Column:
    """The anchor within the covering radius: the bit that the syndrome names is turned."""
    return F.when(syndrome == 0, x).otherwise(x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), syndrome - 1)))


def linked(fps: DataFrame, max_bits: int = 2, apart: str | None = None) -> DataFrame:
    """``draw`` and pairs ``a`` < ``b`` of its distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits (5 at most).

    With the name of a column in ``apart``, only fingerprints that differ in it are linked, and the pairs of its values
    are returned as ``a`` and ``b``, once for every link.

    One half of the two fingerprints differs in at most ``max_bits // 2`` bits. 31 bits of each half are covered by
    the words of the Hamming code: every value has its home anchor within one bit. Fingerprints are replicated to the
    16 anchors within two bits and compared anchor by anchor. With up to 3 bits in all, a half differs in one, so
    the replicas meet the other fingerprint at its home anchor. With 4 or 5, a half differs in two; the home anchor
    of the value between them then lies within two bits of both. Either way each pair is compared at one anchor of
    a half. There are 2^26 anchors per half, so they stay small as the number of fingerprints grows.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("max_bits is 0 to 5")
    if max_bits == 0:
        return fps.select(*([] if apart else ["draw"]), *(F.col(apart or "fp").alias(c) for c in "ab")).where("false")

    def half(fp: str, slot: Column) -> Column:
        start = F.when(slot % 2 == 0, HALVES[0]).otherwise(HALVES[1])
        return F.call_function("shiftrightunsigned", F.col(fp), start).bitwiseAND(F.lit((1 << CODE_BITS) - 1))

    # the slot, draw and half of an anchor, stands above its bits, so that key and fingerprint are all that is moved
    group = [F.col(apart).alias("group")] if apart else []
    halves = (fps.select("fp", *group, F.explode(F.array(F.col("draw") * 2, F.col("draw") * 2 + 1)).alias("slot"))
              .withColumn("x", half("fp", F.col("slot"))).withColumn("s", _syndrome(F.col("x"))))
    above = F.call_function("shiftleft", F.col("slot").cast("bigint"), F.lit(CODE_BITS))
    halves = halves.withColumn("home", _home(F.col("x"), F.col("s")).bitwiseOR(above))
    others = F.expr(f"""transform(filter(sequence(1, {CODE_BITS}), i -> i < (i ^ s)),
        i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1) | shiftleft(bigint(slot), {CODE_BITS}))""")
    replicas = halves.withColumn("anchor", F.explode(F.concat(F.array("home"), others)))
    def side(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col(key).alias("anchor"), F.col("fp").alias(name), *([F.col("group").alias(f"{name}_group")] if apart else []))

    far = side(replicas, "anchor", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    if apart:
        close &= F.col("a_group") != F.col("b_group")
    slot = F.shiftright("anchor", CODE_BITS)
    if max_bits // 2 <= 1:
        pairs = side(halves, "home", "a").join(far, "anchor").where(close)
    else:
        a, b = half("a", slot), half("b", slot)
        gap = a.bitwiseXOR(b)
        between = F.when(F.bit_count(gap) == 2, a.bitwiseXOR(gap.bitwiseAND(-gap))).otherwise(a)
        here = F.col("anchor").bitwiseAND(F.lit((1 << CODE_BITS) - 1)) == _home(between, _syndrome(between))
        pairs = side(replicas, "anchor", "a").join(far, "anchor").where(close & here)
    if apart:
        return pairs.select(F.col("a_group").alias("a"), F.col("b_group").alias("b"))
    return pairs.select((slot / 2).cast("int").alias("draw"), "a", "b").distinct()


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of every document.

    Texts are lower-cased in A-Z and cut at ASCII white space; the component is the smallest id that can be reached
    over fingerprints that differ in at most ``max_bits`` bits. Documents of one fingerprint are one class; only
    distinct fingerprints are compared, and only linked ones take part in the search for components.

    NULL and blank texts have fingerprint zero and are linked like any other. NULL ids are left out of the smallest id
    (a component of NULL ids only has NULL). Repeated rows are all returned. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, words, 1, id_column, text_column).select("doc_id", F.col("fps")[0].alias("fp")),
                  "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(classes.select(F.lit(0).alias("draw"), "fp"), max_bits))
    joined = classes.join(roots, classes["fp"] == roots["node"])
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined.join(smallest, "root").select(F.col("fp").alias("moved_fp"), "component_id")
    found = classes.join(moved, F.col("fp") == F.col("moved_fp"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component_id", "least").alias("component_id"))
    found = stored(found, "fingerprint-components")
    return rows.join(found, F.col("fp") == F.col("class_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, max_bits: int = 5, draws: int = 14, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, of every group of near copies the document with the smallest id.

    Documents are near copies if any of ``draws`` fingerprints of their shingles, each over other hashes, differ in at
    most ``max_bits`` bits. One fingerprint alone finds a quarter of the pairs of similarity 0.8 or more, fourteen find nine
    in ten. Groups reach over links as in ``near_groups``, through the links of all draws together. Two draws run first, then
    six at a time; between these steps all documents keep their fingerprints under the smallest id of their group so far, and
    only pairs of different groups are linked, so a large group is not linked over and over. The first two draws are linked at
    one bit, then two, three and all: a fingerprint has at most 64 others within one bit, and where a group is so dense that
    many pairs are within a few bits, the steps before have joined them. Documents without id stay.

    Documents of one fingerprint are of one group from the first step of their draw on. Later steps of the draw therefore
    carry the group with the fingerprint, and documents get theirs from it when the next draws begin: every step more costs
    the driver memory for its plans, stages and threads, whatever the number of rows.
    """
    left = stored(fingerprints(docs, words, draws, id_column, text_column).where("doc_id IS NOT NULL"), "fingerprints")
    left = left.withColumn("root", F.col("doc_id"))
    gone = None
    starts = [0, *range(FIRST_DRAWS, draws, NEXT_DRAWS)]
    for first, last in zip(starts, [*starts[1:], draws]):
        each = left.select("root", F.posexplode(F.slice("fps", first + 1, last - first)).alias("draw", "fp"))
        classes = stored(each.groupBy("draw", "fp").agg(F.min("root").alias("least")), "fingerprint-classes")
        links = each.join(classes, ["draw", "fp"]).where("root <> least").select(
            F.col("root").alias("a"), F.col("least").alias("b"))
        steps = [*(bits for bits in FIRST_BITS if bits < max_bits and not first), max_bits]
        for number, bits in enumerate(steps, 1):
            near = linked(classes, bits, "least")
            copies = components(near if number > 1 else links.unionByName(near)).where("node <> root")
            gone = copies.select("node") if gone is None else gone.unionByName(copies.select("node"))
            # by the group so far, not by the document: a later step links only the roots of the groups before it
            lower = copies.select(F.col("node").alias("least"), F.col("root").alias("lower"))
            classes = classes.join(lower, "least", "left").select("draw", "fp", F.coalesce("lower", "least").alias("least"))
            if number < len(steps):
                classes = stored(classes, "fingerprint-classes")
        if last < draws:
            groups = classes.where("draw = 0").select(F.col("fp").alias("head"), F.col("least").alias("root"))
            left = stored(left.drop("root").join(groups, F.col("fps")[first] == F.col("head")).select(
                "doc_id", "fps", "root"), "fingerprints")
    return by_id(docs, gone, "left_anti", id_column)
