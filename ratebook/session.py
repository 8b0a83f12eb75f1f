"""Session helpers: where shared working files live."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Root folder for working tables and stream checkpoints, on the file system of the cluster.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of the warehouse is
    taken, which executors and driver share as well; never a folder of one machine's own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
