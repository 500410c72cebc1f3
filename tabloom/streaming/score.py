"""Records scored as they arrive. Stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.columns import coerce_record, require_columns
from tabloom.operators.fitted import FeatureTransformer
from tabloom.plans.classify import Trained
from tabloom.plans.score import make_predictions


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).format(kind)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def record_scorer(trained: Trained, kinds: Mapping[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Required features checked, loose text made typed, one result struct per record."""
    def score(records: DataFrame) -> DataFrame:
        require_columns(records, list(kinds))
        return make_predictions(coerce_record(records, kinds), trained)
    return score


def feature_scorer(fitted: FeatureTransformer) -> Callable[[DataFrame], DataFrame]:
    """Fitted features are projections, so a stream takes them as a table does."""
    return fitted.transform


def run_to_end(stream: DataFrame, output: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Process what is there in batches of files and stop; restarts go on from the checkpoint."""
    query = (stream.writeStream.format(kind).outputMode("append").option("path", output)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
