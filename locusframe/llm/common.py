"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the control characters TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text handed to one step of a Python operator at most (one row may exceed it).
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):  # executors of local-cluster are processes of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="locusframe-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (as long) and the text; all other columns, whatever their names, stay outside."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def slices(batch: pa.RecordBatch, text_at: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice take about `limit` bytes, whatever the length of single texts."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(text_at)
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    start = size = 0
    for i, k in enumerate(lengths):
        if i > start and size + k > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    yield batch.slice(start, n - start)


def raw_texts(batch: pa.RecordBatch, text_at: int = 1) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
