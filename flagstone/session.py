"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # recording a Python call site for every column costs more than planning these expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # sessions of one key are merged before the shuffle, so a busy key arrives as few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "flagstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win for the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stream checkpoints and materialised steps.

    It lives under ``spark.checkpoint.dir``, the folder every executor can reach. Only a local
    master may fall back to a temporary folder; on a cluster the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="flagstone-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
