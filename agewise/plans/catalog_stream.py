"""Registered streaming query: JSON requests scored as a stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..spec import FIXTURE_BINARY as BN
from ..streaming.requests import request_signals, request_stream, run_to_table, run_with_rejects
from . import oracle as O
from .catalog import ORACLE, mixed_requests, query
from .catalog_ml import scratch

SIGNAL_STATS = ("par", "ast", "usg")


def _stream_requests(spark, d):
    base = scratch(spark, "requests-stream")
    src = os.path.join(base, "in")
    fx.requests(spark, d).write.mode("overwrite").json(src)
    feats = request_signals(request_stream(spark, src), BN, SIGNAL_STATS, keep=("entity",))
    run_to_table(feats, os.path.join(base, "out"), os.path.join(base, "checkpoint"))
    return spark.read.parquet(os.path.join(base, "out"))


_SIG = O.signal_sql("{c}")


def _sql() -> str:
    cols = ["entity"]
    for s in BN.panel.stats:
        cols.append(f"CAST(json_extract(request, '$.age_28.{s}') AS DOUBLE) AS {s}_age28")
    for a in BN.delta_ages:
        for s in BN.panel.stats:
            cols.append(f"CAST(json_extract(request, '$.age_{a}.{s}') AS DOUBLE) - "
                        f"CAST(json_extract(request, '$.age_28.{s}') AS DOUBLE) AS {s}_delta_age{a}")
    inner = "SELECT " + ", ".join(cols) + " FROM requests"
    sig = ", ".join(_SIG.format(c=f"{s}_delta_age29") + f" AS signal_{s}" for s in SIGNAL_STATS)
    return O.sql(f"SELECT *, {sig} FROM ({inner}) x")


query("stream_request_features", _sql())(_stream_requests)


def _stream_checked(spark, d):
    """Good and rejected requests of a stream, each with the reason it has."""
    base = scratch(spark, "requests-mixed")
    mixed_requests(spark, d).repartition(3).write.json(os.path.join(base, "in"))
    source = request_stream(spark, os.path.join(base, "in"), max_files_per_trigger=1)
    run_with_rejects(source, os.path.join(base, "good"), os.path.join(base, "rejected"), os.path.join(base, "checkpoint"),
                     lambda good: request_signals(good, BN, SIGNAL_STATS, keep=("entity",)))
    good = spark.read.parquet(os.path.join(base, "good")).select("entity", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(spark.read.parquet(os.path.join(base, "rejected")).select("entity", "reason"))


query("stream_requests_checked", ORACLE["requests_checked"])(_stream_checked)
