"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabloom.session import work_folder

ARROW_BYTES = 4 * 1024 * 1024       # text handed to Python at a time, whatever the number of rows
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()             # applications that have the package


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared work folder and read again.

    Cuts the lineage: what follows neither repeats the work before it nor depends on files of one executor.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, so that very long texts don't pile up in a Python worker.

    Workers import this package; it is sent along once per session, as ``--py-files`` would.
    """
    spark = df.sparkSession
    if spark.conf.get(_ARROW_LIMIT, None) != str(ARROW_BYTES):
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _sent:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _sent.add(context.applicationId)
    return df.mapInArrow(work, schema)


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns can't clash. NULL text counts as empty."""
    return docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))


def by_id(docs: DataFrame, chosen: DataFrame, how: str, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with all their columns whose id is (``left_semi``) or isn't (``left_anti``) in ``chosen``."""
    ids = chosen.select(F.col(chosen.columns[0]).alias("__chosen_id")).distinct()
    return docs.join(ids, docs[id_column].eqNullSafe(ids["__chosen_id"]), how)


def binary_hash(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))
