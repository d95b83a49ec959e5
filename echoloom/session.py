"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts, some of them long: bounds what a Python worker holds
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def _carry_functions() -> None:
    """Send the package's task functions with the task, so that executors need no install."""
    package = sys.modules[__name__.split(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs need to an existing session."""
    _carry_functions()
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "echoloom", **extra: str) -> SparkSession:
    """Create a session; `master` is only for local runs, a cluster sets its own."""
    _carry_functions()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at the shared folder the cluster names.

    `spark.checkpoint.dir` wins. Only a local-mode session without that setting gets a
    folder of its own; a cluster without it is a configuration error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if named:
        if not active:
            context.setCheckpointDir(named)
        return named
    if active:
        return active
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="echoloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()
