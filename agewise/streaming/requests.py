"""Structured Streaming: score incoming JSON requests as they arrive.

The per-request operators (request parsing, feature rows, signal directions,
risk bands) are stateless, so the same functions serve batch and streaming
DataFrames.  A fitted ``PipelineModel`` can be applied in the stream too, as
its stages are row-wise at transform time.  Exactly-once output comes from
the checkpointed file sink.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import signal_direction
from ..operators.features import request_features
from ..sources.readers import split_requests
from ..spec import CohortPreset

REQUEST_SCHEMA = "entity bigint, name string, request string"


def request_stream(spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of request records (JSON lines) arriving in ``path``."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def request_signals(requests: DataFrame, preset: CohortPreset, signal_stats, keep=("entity",)) -> DataFrame:
    """Feature row of every request plus the first-year signal words."""
    feats = request_features(requests, preset, keep=keep)
    first = preset.delta_ages[0]
    cols = {f"signal_{s}": signal_direction(F.col(preset.delta_fmt.format(stat=s, raw=s, age=first)))
            for s in signal_stats}
    return feats.withColumns(cols)


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Feature rows of a stream with a fitted model's columns."""
    return model.transform(stream)


def run_with_rejects(requests: DataFrame, out_path: str, rejects_path: str, checkpoint: str, make, json_col: str = "request") -> None:
    """Process everything available now: ``make`` of the usable requests into ``out_path``, the rejected ones with
    their reason into ``rejects_path``.  A batch is read once; both tables carry its number (``batch``), and a batch
    that is run again after a failure replaces its own part, so nothing comes twice."""
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        good, rejected = split_requests(kept, json_col)
        for rows, path in ((make(good), out_path), (rejected, rejects_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available now into ``out_path`` and stop; the
    checkpoint makes a restart resume without duplicates."""
    q = (df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
