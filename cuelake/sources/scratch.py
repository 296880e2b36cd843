"""Files that a query writes to read them back, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path in spark.checkpoint.dir; only where that is not set and the master is local, as in tests, one is made for it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(rows: DataFrame, fmt: str) -> str:
    """The path to which rows were written."""
    path = folder(rows.sparkSession)
    rows.write.format(fmt).save(path)
    return path
