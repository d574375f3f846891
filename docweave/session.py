"""Session defaults and shared-storage locations.

The settings below mirror the JSON semantics the operators rely on:

* ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` and
  ``spark.sql.variant.allowDuplicateKeys=true`` make a repeated key keep its
  last value, as a JSON object parsed into a map does.
* ``spark.sql.caseSensitive=true``: JSON keys that differ only in case are
  different keys.
* ANSI mode stays on (the Spark 4 default); every operator uses ``try_*``
  functions so a bad value becomes NULL instead of failing the job.
* AQE is on so skewed join partitions are split at run time and small
  shuffles are coalesced.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DOC_SETTINGS = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.caseSensitive": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings for large inputs: many shuffle partitions that AQE coalesces to
# ~128 MB each, 256 MB file splits, and skew handling for partitions above
# 5x the median and 256 MB.  A 100 TB scan then runs as ~400k tasks of
# bounded size; no partition has to fit a whole key group in memory.
CLUSTER_SETTINGS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
}


def configure(spark: SparkSession, cluster: bool = False) -> SparkSession:
    """Apply the document settings to an existing session (runtime confs only).

    ``cluster=True`` also applies ``CLUSTER_SETTINGS`` for large inputs.
    """
    for key, value in {**DOC_SETTINGS, **(CLUSTER_SETTINGS if cluster else {})}.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app: str = "docweave",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the document settings applied.

    ``master`` is only set when given, so on a cluster the submitter decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("DOCWEAVE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DOC_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, state snapshots and stream outputs.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there).  Only when it is unset *and* driver and executors are one machine
    -- local runs and tests -- a private folder is created once per
    application; elsewhere executors could not see it, so this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="docweave-ckpt-")
        root = _LOCAL_ROOTS[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
