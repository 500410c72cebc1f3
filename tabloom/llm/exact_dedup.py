"""Exact duplicates by 128-bit content hash, with a byte comparison inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_hash, by_id, id_and_text, stored


def exact_groups(docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text",
                 content_hash: Callable[[Column], Column] = binary_hash) -> DataFrame:
    """Every row of ``docs`` with its group of byte-identical texts.

    Columns: ``doc_id``, ``keep_id`` (the ``smallest`` or ``largest`` id of the group stays), ``group_size``, ``kept``,
    ``text_sha256``. Rows are grouped by hash and bytes together, combined before the shuffle, so a group of any size
    sends one row per task and texts that share a hash by accident stay apart. The slim group table is then joined
    back by hash alone, a join whose large keys Spark may split; only hashes that stand for several texts, normally
    none, go back to the bytes.

    NULL text counts as empty. A NULL id never beats a known one; a group of NULL ids keeps NULL. Rows that repeat the
    kept id and text are the same document and are all marked ``kept``. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_column, text_column).withColumn("hash", content_hash(F.col("text")))
    best = {"smallest": F.min, "largest": F.max}[keep]("doc_id")
    groups = (rows.groupBy("hash", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    groups = stored(groups, "exact-groups")
    shared = groups.groupBy("hash").count().where("count > 1").select("hash")
    found = rows.select("doc_id", "hash")
    if shared.isEmpty():
        found = found.join(groups, "hash")
    else:
        apart = rows.join(shared, "hash", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        by_bytes = apart.groupBy("hash", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = (found.join(groups.join(shared, "hash", "left_anti"), "hash")
                 .unionByName(apart.join(by_bytes, ["hash", "text"]).drop("text")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


def drop_exact_copies(docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, one document of every group of identical texts."""
    groups = exact_groups(docs, keep, id_column, text_column)
    return by_id(docs, groups.where("kept").select("doc_id"), "left_semi", id_column)
