"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir; where that is unset and all runs on one machine, a new temporary folder is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="coverscope-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed and kept in the folder of checkpoints."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
