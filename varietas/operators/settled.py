"""Frames that are computed once and read several times: kept in the shared checkpoint folder, lineage cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one, as in tests, gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="varietas-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept; a settled frame comes back as it is."""
    if getattr(df, "_settled", False):
        return df
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._settled = True
    return out


def view(df: DataFrame) -> DataFrame:
    """``df``, a few rows or columns of a settled frame, which counts as settled too."""
    df._settled = True
    return df
