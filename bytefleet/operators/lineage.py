"""Cutting the lineage of iterative operators by checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a folder of its own, but only if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        import tempfile

        _OWN.append(tempfile.mkdtemp(prefix="shared-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
