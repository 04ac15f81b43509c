"""What a session needs before an operator cuts its lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the checkpoint folder that the session names. Where it names none, a session on this machine alone gets a folder here,
    and a cluster an error, as its executors need a shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "kinspark-lineage"))
    return spark
