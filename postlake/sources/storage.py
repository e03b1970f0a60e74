"""The folder that all executors share, and what is kept there between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The one named in spark.checkpoint.dir; a temporary one in local sessions without; an error on a cluster without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
