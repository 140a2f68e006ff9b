"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings the queries are written for; each can be overridden by the caller.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Aggregates that collect lists hash that many groups in a task before they sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # The padded webhook secret, wherever a plan is shown.
    "spark.sql.redaction.string.regex": "[0-9A-Fa-f]{128}",
}


def builder(app_name: str = "auditlake") -> SparkSession.Builder:
    """A session builder with the settings above."""
    configured = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        configured = configured.config(key, value)
    return configured


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its
    own, which is then set so that later calls agree.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="auditlake-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" in base or base.startswith("file:"):
        return f"{base.rstrip('/')}/{uuid4().hex}"
    return str(PurePosixPath(base) / uuid4().hex)


def freed(spark: SparkSession) -> None:
    """Has the driver look for frames that are gone; the shuffles they have left on disk are deleted with them, which
    otherwise may not happen before a long query ends."""
    spark.sparkContext._jvm.System.gc()


def kept(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, computed now and kept in the shared folder, so that whatever reads them later
    reads them from there, also after an executor was lost."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    freed(spark)
    return frame.checkpoint()
