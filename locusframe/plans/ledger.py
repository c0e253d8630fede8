"""Long jobs that go on where they stopped.

A ledger is a folder of Parquet files with one or more rows for each task that
is done. A task is known by a key, the fingerprint of everything that its result
depends on, and by what tells tasks of a key apart. Results are appended block
by block; a later call takes up what the ledger has and computes only the tasks
that an anti-join leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locusframe.functions.lineage import settled


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of values of any kind, each with its length, so that no two lists of parts run together."""
    text = [F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("null")) for p in parts]
    return F.sha2(F.concat_ws("", *[x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)]), 256)


def table_fingerprint(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and partitions; rows that repeat count each."""
    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(h, F.lit("salt"))).alias("x")).first()
    return f"{','.join(sorted(df.columns))}|{r['n']}|{r['s']}|{r['x']}"


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the ledger holds now. Its files are named one by one: Spark takes two scans of a folder for the same, though files have come between them."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath().toString() for f in fs.listStatus(at)] if fs.exists(at) else []
    files = sorted(f for f in files if f.endswith(".parquet"))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def remembered(tasks: DataFrame, ids: Sequence[str], work: Callable[[DataFrame], DataFrame], path: str, blocks: int = 10) -> DataFrame:
    """work(tasks), with tasks that the ledger at `path` holds taken from it and all others appended to it.

    tasks has a column key and the columns ids; work returns both beside its
    results, at least one row for a task. The pending tasks are dealt into
    blocks, each appended when it is done. Rows that two jobs wrote at the same
    time are taken once.
    """
    spark = tasks.sparkSession
    keys = ["key", *ids]
    schema = work(tasks.limit(0)).schema
    done = _read(spark, path, schema).select(*keys).distinct()
    pending = settled(tasks.join(done, keys, "left_anti"))
    counts = pending.groupBy(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("b")).count().orderBy("b").collect()  # a row a block
    for r in counts:
        part = pending.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == r["b"])
        work(part).write.mode("append").parquet(path)
    return _read(spark, path, schema).dropDuplicates().join(tasks.select(*keys).distinct(), keys, "left_semi")
