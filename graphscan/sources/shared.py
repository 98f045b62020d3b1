"""The folder for intermediate files that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "graphscan-tables")
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
