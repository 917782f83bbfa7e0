"""SparkSession construction and the few session settings the package relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "agewise", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster pass ``master=None`` and let spark-submit decide; the shuffle
    partition count then stays whatever the cluster configured.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of tables no longer referenced are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, target_partition_bytes: int = 128 << 20,
                   min_partitions: int = 200, max_partitions: int = 200_000) -> dict:
    """Partition sizing for a given input volume: scan splits and shuffle
    partitions of about ``target_partition_bytes`` each, so that a task's
    share fits in executor memory; AQE then coalesces or splits at run time
    (skewed partitions of joins are split by the skew-join rule)."""
    parts = min(max_partitions, max(min_partitions, -(-input_bytes // target_partition_bytes)))
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int, **kw) -> dict:
    """Set :func:`scale_settings` on a running session (all are runtime SQL settings)."""
    conf = scale_settings(input_bytes, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset on a local master (local runs,
    tests) a scratch folder is created and registered.  On any other master
    that would be a folder of the driver alone, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="agewise-ckpt-", dir=os.environ.get("AGEWISE_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df):
    """Cut a lineage that several jobs re-read: a reliable checkpoint into the
    shared ``spark.checkpoint.dir`` (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
