"""Where lineage is cut: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, tempfile.TemporaryDirectory] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, written to spark.checkpoint.dir and read from there. In local mode a temporary folder takes its place where it is unset."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "" not in _local:
            _local[""] = tempfile.TemporaryDirectory(prefix="varispark-")
            atexit.register(_local[""].cleanup)
        where = f"file://{_local[''].name}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)
