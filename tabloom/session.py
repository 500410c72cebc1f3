"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed partition may also be split when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python call site per column expression: wide projections are built many times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tabloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the folder all executors share.

    Where it is unset, a master on this machine only (as in tests) gets a local folder; any other is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tabloom-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(spark, "checkpoints"))
    return df.checkpoint()


def written(df, name: str):
    """``df`` written once to the shared folder and read again; unlike a checkpoint, its work is done once only."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
