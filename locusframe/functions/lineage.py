"""Rows that are computed once: kept in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in spark.checkpoint.dir, so that nothing behind it runs twice; only a local session without that setting gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="locusframe-kept-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
