"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below ``spark.checkpoint.dir``; where that is unset and Spark runs on this machine alone, below a folder of
    our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{str(base).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
