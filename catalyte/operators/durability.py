"""Cutting lineage in a folder that survives a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the folder that ``spark.checkpoint.dir``
    names, or in local mode, where none is named, a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="catalyte-ckpt-"))
    return df.checkpoint()
