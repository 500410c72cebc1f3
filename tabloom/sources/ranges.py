"""Records of large files whose line ends or commas may stand inside quotes, read by many tasks.

A text file is cut at every line end (CSV) or comma (JSON) wherever these stand, which any byte range can do by itself.
Neighbouring pieces are stored as chunks together with what they do to the state of a reader: an odd number of quotes turns
"inside quotes" over, brackets outside quotes change the depth. Running sums over these few numbers tell in which state
each chunk begins, and then every chunk finds its records alone. What is left at the ends of chunks is put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import work_folder

CHUNK_BYTES = 1 << 22
BATCH_BYTES = 1 << 22        # bytes handed to Python at a time; a batch of so many rows would hold all chunks of a task
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
CHUNK = ("path string, block bigint, number int, data binary, quotes bigint, depth_outside bigint, depth_inside bigint")
PIECE = "path string, block bigint, number int, side int, data binary"
WHOLE, TAIL, MIDDLE, HEAD = 0, 1, 2, 3      # records, and the begin, middle and end of one that goes over several chunks
FIRST, STRAY = 4, 5                         # the first record of a file, and the mark of a chunk with stray quotes
MARK = b"\xef\xbb\xbf"                       # of UTF-8, may stand at the start of a file


@contextmanager
def _small_batches(spark: SparkSession):
    """Batches for Python bounded by bytes while a table is written."""
    held = spark.conf.get(_BATCH_LIMIT, None)
    spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_LIMIT) if held is None else spark.conf.set(_BATCH_LIMIT, held)


def _chunker(separator: bytes, escapes: bool, limit: int):
    """Task that gathers neighbouring pieces of a file's byte range into chunks and counts quotes and brackets."""
    def unescaped(data: bytes) -> bytes:
        return data.replace(b"\\\\", b"__").replace(b'\\"', b"__") if escapes else data

    def depth(parts: list[bytes]) -> int:
        text = b"".join(parts)
        return text.count(b"[") + text.count(b"{") - text.count(b"]") - text.count(b"}")

    def chunk(path, block, number, pieces):
        data = separator.join(pieces) + separator
        parts = unescaped(data).split(b'"')
        return path, block, number, data, len(parts) - 1, depth(parts[::2]), depth(parts[1::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, held, size = None, 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(chunk(*place, number, held), (
                    pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                ["path", "block", "number", "data", "quotes", "depth_outside", "depth_inside"])

        for batch in batches:
            for path, block, data in zip(*(batch[c].to_pylist() for c in ("path", "block", "data"))):
                if (path, block) != place or size > limit:
                    if held:
                        yield out()
                    number = number + 1 if (path, block) == place else 0
                    place, held, size = (path, block), [], 0
                held.append(data)
                size += len(data) + 1
        if held:
            yield out()
    return run


def chunks_of(spark: SparkSession, path: str | list[str], separator: str, escapes: bool,
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored chunks of the files, each of neighbouring pieces of one byte range, in the order of ``block`` and ``number``.

    They are stored because byte ranges may be cut elsewhere when a file is read again.
    """
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("data"))
    folder = work_folder(spark, "chunks")
    with _small_batches(spark):
        lines.mapInArrow(_chunker(separator.encode(), escapes, chunk_bytes), CHUNK).write.parquet(folder)
    return spark.read.schema(CHUNK).parquet(folder)


def start_states(chunks: DataFrame) -> DataFrame:
    """``path``, ``block``, ``number``, ``inside`` (a quote is open) and ``depth`` at the start of every chunk.

    Sums run over the chunks of each byte range and over the ranges of each file, so a window holds few short rows.
    """
    place = ["path", "block", "number"]
    slim = chunks.select(*place, "quotes", "depth_outside", "depth_inside")
    in_block = Window.partitionBy("path", "block").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(in_block), F.lit(0)) % 2      # before the chunk, counted from its block's start

    def change(inside: Column) -> Column:
        return F.when(inside % 2 == 0, F.col("depth_outside")).otherwise(F.col("depth_inside"))

    within = (slim.withColumn("odd", odd).withColumn("change_0", change(F.col("odd"))).withColumn("change_1", change(F.col("odd") + 1)))
    within = within.withColumns({f"before_{h}": F.coalesce(F.sum(f"change_{h}").over(in_block), F.lit(0)) for h in (0, 1)})
    blocks = within.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.sum("change_0").alias("change_0"),
                                                 F.sum("change_1").alias("change_1"))
    in_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start_inside", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2)
    step = F.when(F.col("start_inside") == 0, F.col("change_0")).otherwise(F.col("change_1"))
    blocks = blocks.withColumn("start_depth", F.coalesce(F.sum(step).over(in_file), F.lit(0)))
    joined = within.join(blocks.select("path", "block", "start_inside", "start_depth"), ["path", "block"])
    before = F.when(F.col("start_inside") == 0, F.col("before_0")).otherwise(F.col("before_1"))
    return joined.select(*place, ((F.col("start_inside") + F.col("odd")) % 2).alias("inside"),
                         (F.col("start_depth") + before).alias("depth"))


def _cutter(separator: int, level: int, escapes: bool, field: bytes = b""):
    """Task that cuts chunks, which know their state, behind the separators outside quotes at one depth.

    With a ``field`` separator, the first record of a file is told apart, and so is every chunk where a quote opens after
    something else than a separator or closes before something else.
    """
    quote = 34

    def one_of(raw: np.ndarray, characters: bytes) -> np.ndarray:
        return np.isin(raw, np.frombuffer(characters, dtype=np.uint8))

    def stray(raw: np.ndarray, outside: np.ndarray) -> bool:
        around = np.concatenate([[separator], raw, [separator]])
        border = one_of(around, field + b'\r\n\t "')
        is_quote = raw == quote
        # a quote that leaves the text inside opens a value, one that leaves it outside closes one
        return bool((is_quote & ~outside & ~border[:-2] | is_quote & outside & ~border[2:]).any())

    def pieces(data: bytes, inside: int, depth: int, first: bool):
        plain = data.replace(b"\\\\", b"__").replace(b'\\"', b"__") if escapes else data
        raw = np.frombuffer(plain, dtype=np.uint8)
        outside = (np.cumsum(raw == quote, dtype=np.uint8) + np.uint8(inside)) % 2 == 0      # a byte keeps whether it is odd
        cut = (raw == separator) & outside
        start = len(MARK) if first and data.startswith(MARK) else 0
        fresh, over = first or not inside, False
        if level:
            opens, closes = one_of(raw, b"[{") & outside, one_of(raw, b"]}") & outside
            deep = depth + np.cumsum(opens.astype(np.int64) - closes)
            cut = cut & (deep == level) | closes & (deep == level - 1)      # the end of the array ends its last element
            begin = np.flatnonzero(opens & (deep == level))                 # the bracket that opens the array
            start = int(begin[0]) + 1 if first and len(begin) else 0
            fresh = first or not inside and depth == level
            over = not len(raw) or int(deep[-1]) < level                    # nothing counts behind the array
        elif field and stray(raw[start:], outside[start:]):
            yield STRAY, b""
        at_first = bool(first and field)
        for edge in np.flatnonzero(cut).tolist():
            if edge >= start:
                yield (FIRST if at_first else WHOLE if fresh else HEAD), data[start:edge]
                start, fresh, at_first = edge + 1, True, False
        if start < len(data) and not over:
            yield (TAIL if fresh else MIDDLE), data[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, block, number, inside, depth, data = (batch[c][row].as_py() for c in (
                    "path", "block", "number", "inside", "depth", "data"))
                found = list(pieces(data, inside, depth, block == 0 and number == 0))
                for k in range(0, len(found), 10_000):
                    part = found[k:k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([block] * len(part), pa.int64()),
                         pa.array([number] * len(part), pa.int32()), pa.array([p[0] for p in part], pa.int32()),
                         pa.array([p[1] for p in part], pa.binary())], ["path", "block", "number", "side", "data"])
    return run


def _pieces(chunks: DataFrame, separator: str, level: int, escapes: bool, field: str = "") -> DataFrame:
    """The chunks cut at the borders of records, stored by kind."""
    spark = chunks.sparkSession
    cut = (chunks.select("path", "block", "number", "data").join(start_states(chunks), ["path", "block", "number"])
           .select("path", "block", "number", "inside", "depth", "data")
           .mapInArrow(_cutter(ord(separator), level, escapes, field.encode()), PIECE))
    folder = work_folder(spark, "pieces")
    with _small_batches(spark):
        cut.write.partitionBy("side").parquet(folder)
    return spark.read.schema(PIECE).parquet(folder)


def _spread(pieces: DataFrame) -> DataFrame:
    """``path`` and ``data`` of the records that go over several chunks, of which a chunk has at most two."""
    order = Window.partitionBy("path").orderBy("block", "number", (F.col("side") == TAIL).cast("int"))
    parts = pieces.where(F.col("side").isin(TAIL, MIDDLE, HEAD)).withColumn(
        "record", F.count(F.when(F.col("side") == TAIL, 1)).over(order))
    parts = parts.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("block", "number", "data"))).alias("p"))
    return parts.select("path", F.expr("aggregate(p, X'', (a, x) -> a || x.data)").alias("data"))


def _plain(data: Column) -> Column:
    """Bytes as characters of the same codes."""
    return F.decode(data, "ISO-8859-1")


def _less(data: Column, ends: str) -> Column:
    """Without the last byte, if that is one of ``ends``."""
    last = F.right(_plain(data), F.lit(1))
    return F.when(last.isin(*ends), F.substring(data, F.lit(1), F.length(data) - 1)).otherwise(data)


def quoted_records(spark: SparkSession, path: str | list[str], separator: str = ",",
                   chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, list[str]]:
    """Records of CSV files with the line ends that quotes hold: first ones, other ones, and files with stray quotes.

    Both tables have ``path`` and ``data`` (bytes without the line end); the first record of a file is its header. A quote
    counts wherever it stands, so files where one stands inside a value without quotes are named, not read. Blank records
    are left out. A quote that is never closed gives a last record up to the end of the file.
    """
    pieces = _pieces(chunks_of(spark, path, "\n", False, chunk_bytes), "\n", 0, False, separator)
    stray = sorted(r["path"] for r in pieces.where(F.col("side") == STRAY).select("path").distinct().collect())
    regular = pieces.where(~F.col("path").isin(stray)) if stray else pieces

    def ended(rows: DataFrame) -> DataFrame:
        return rows.select("path", _less(F.col("data"), "\r").alias("data")).where(F.trim(_plain(F.col("data"))) != "")

    whole = regular.where(F.col("side") == WHOLE).select("path", "data")
    spread = _spread(regular).select("path", _less(F.col("data"), "\n").alias("data"))
    return ended(regular.where(F.col("side") == FIRST)), ended(whole.unionByName(spread)), stray


def array_elements(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path`` and ``data`` (bytes) of every element of JSON files that hold one array each.

    What is left of a last element in a file that ends too early is returned as it stands there. Blank elements are
    left out.
    """
    pieces = _pieces(chunks_of(spark, path, ",", True, chunk_bytes), ",", 1, True)
    whole = pieces.where(F.col("side") == WHOLE).select("path", "data")
    spread = _spread(pieces).select("path", _less(F.col("data"), ",").alias("data"))      # put there by the chunker
    return whole.unionByName(spread).where(F.trim(_plain(F.col("data")), F.lit(" \t\r\n")) != "")


def text_rows(df: DataFrame, column: Column):
    """A column as the JVM's table of texts, which its CSV and JSON readers take instead of files."""
    encoder = df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return getattr(df.select(column.cast("string").alias("value"))._jdf, "as")(encoder)
