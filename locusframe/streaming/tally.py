"""Incremental catalogues: an extension, for variant or segment rows that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_tally(stream: DataFrame, label: Callable[[DataFrame], DataFrame], component: str) -> DataFrame:
    """Counts per (sample, component) of a stream of rows, for update or complete mode.

    label must work row by row (no windows over neighbours), as label_sbs and
    label_40_48 do; its state is one count per sample and component.
    """
    d = label(stream).where(F.col(component).isNotNull())
    return d.groupBy("sample", F.col(component).alias("component")).agg(F.count("*").alias("n"))
