"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored

KEY_BITS = 60          # from the key; as many again tell rows of one key apart
STEP = 8               # bits a directory grows by at a time


def _bits(value):
    number = F.conv(F.substring(F.md5(value), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    return F.lpad(F.bin(number), KEY_BITS, "0")


def _directory(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """Cells of ``depth`` bits with the bucket they end in; NULL where even the cell is too large."""
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    cells = stored(cells, "shard-cells")
    levels = (cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth))))
              .withColumn("shard", F.expr("substring(cell, 1, depth)")))
    buckets = levels.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("shard_bytes"),
                                                   F.sum("n_rows").alias("shard_rows"))
    final = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
                          | (F.col("depth") == 2 * KEY_BITS))
    ends = (levels.select("cell", "depth", "shard").join(final, ["depth", "shard"])
            .groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("end")))
    return stored(cells.select("cell").join(ends, "cell", "left").select("cell", "end.*"), "shard-directory")


def shards(items: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows of ``items`` (columns ``key``, ``n_bytes``, and any other) with their shard.

    Adds ``shard`` (the hash prefix as a string of bits), ``depth`` (its length), ``shard_bytes`` and ``shard_rows``.
    The directory starts with as many prefix bits as the total size calls for; only buckets above ``limit_bytes``
    take another bit, until each fits or holds a single row. Sizes are summed per prefix before the shuffle; the
    directory holds a few cells per shard and is joined by prefix, so no key of the data ever decides a task's share.

    Rows that share a key, however many, are told apart by a second hash over their row number. A row above the
    limit gets a shard of its own. NULL sizes count as zero, a NULL key is a key like any other. An empty table gives
    an empty result.
    """
    rows = (items.withColumn("n_bytes", F.coalesce(F.col("n_bytes"), F.lit(0)).cast("bigint"))
            .withColumn("__row", F.monotonically_increasing_id()))
    key = F.coalesce(F.col("key").cast("string"), F.lit("\0"))
    rows = stored(rows.withColumn("bits", F.concat(_bits(key), _bits(F.concat_ws("#", key, "__row")))), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start = min(KEY_BITS, max(0, math.floor(math.log2(max(1, total) / limit_bytes))))
    found, rest = None, rows
    while True:
        depth = min(start + STEP, 2 * KEY_BITS)
        directory = _directory(rest, start, depth, limit_bytes)
        joined = rest.withColumn("cell", F.substring("bits", 1, depth)).join(directory, "cell").drop("cell")
        done = joined.where("shard IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        if directory.where("shard IS NULL").isEmpty():
            return found.drop("bits", "__row")
        rest = stored(joined.where("shard IS NULL").drop("depth", "shard", "shard_bytes", "shard_rows"), "shard-rest")
        start = depth + 1


def shard_documents(docs: DataFrame, limit_bytes: int, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Shard of every document, keyed by its id and weighed by the UTF-8 bytes of its text (NULL: none)."""
    items = docs.select(docs[id_column].alias("key"), F.octet_length(docs[text_column]).alias("n_bytes"))
    return shards(items, limit_bytes).withColumnRenamed("key", "doc_id")


def write_shards(docs: DataFrame, folder: str, limit_bytes: int, id_column: str = "doc_id",
                 text_column: str = "text") -> None:
    """Writes ``docs`` below ``folder``, one folder of Parquet per shard; each shard is the work of one task."""
    items = docs.select(docs[id_column].alias("key"), F.octet_length(docs[text_column]).alias("n_bytes"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__doc"))
    (shards(items, limit_bytes).select("__doc.*", F.concat(F.lit("b"), "shard").alias("__shard"))
     .repartition("__shard").write.partitionBy("__shard").parquet(folder))
