"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir.

    The setting is looked for in the session, then in the context (setCheckpointDir).
    Where neither has one, a local folder serves in local mode; on a cluster, where
    executors wouldn't see it, that is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"{tempfile.gettempdir()}/scoreloom-shared"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
