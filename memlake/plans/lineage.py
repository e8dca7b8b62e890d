"""Cutting lineage in loops: the shared checkpoint folder of the cluster, or a temporary one in local runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names, else one for this process (local runs only)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, path, True)
        context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_folder(spark)
    return df.checkpoint(eager=True)
