"""Sharding by extendible hashing.

Every row has a hash of BITS bits. The directory starts with the whole space as
one bucket; only a bucket over the byte limit splits on its next bit, until
each shard fits. Bytes are summed per hash prefix before anything is shuffled,
STEP bits a round, so a task sends at most 2**STEP sums for each oversized
prefix and never the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut, fresh, read

#: Bits by which a round looks ahead, and bits of the hash.
STEP, BITS = 10, 60
#: Bytes of text in a shard of the registered query.
LIMIT = 16 << 20


def hash_bits(*keys: Column) -> Column:
    """The first BITS bits of the MD5 of the keys; null keys hash like the word null."""
    joined = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")


def _depths(cells: DataFrame, low: int, at: int, limit: int) -> DataFrame:
    """For each cell (prefix p of `at` bits, bytes b, rows n) the least depth from `low` on at which its bucket fits or is one row; null if none."""
    wide = cells.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(at)))).withColumn("q", F.expr(f"shiftright(p, {at} - k)"))
    fits = wide.groupBy("k", "q").agg(F.sum("b").alias("s"), F.sum("n").alias("m")).where((F.col("s") <= limit) | (F.col("m") == 1)).select("k", "q")
    return cells.select("p").join(wide.join(fits, ["k", "q"]).groupBy("p").agg(F.min("k").alias("depth")), "p", "left")


def _dealt(equal: DataFrame, h: str, b: str, limit: int) -> DataFrame:
    """The rows of equal with part: rows of one hash are counted off into parts that fit the limit, a part being one row where the largest row alone exceeds it.

    Rows are counted within the task that read them; tasks hand on their counts,
    of which a hash has one per task, so no hash meets as a whole anywhere.
    """
    task, rank, before, most, part = fresh(equal, "task", "rank", "before", "most", "part")
    d = cut(equal.withColumn(task, F.monotonically_increasing_id()))  # kept, so that a repeated task counts alike
    d = d.withColumn(rank, F.col(task)).withColumn(task, F.shiftright(task, 33))
    per = d.groupBy(h, task).agg(F.count("*").alias("n"), F.max(b).alias("m"))
    own = Window.partitionBy(h).orderBy(task)
    start = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(h, task, start.alias(before), F.max("m").over(Window.partitionBy(h)).alias(most))
    d = d.join(per, [h, task]).withColumn(rank, F.row_number().over(Window.partitionBy(h, task).orderBy(rank)))
    rows = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col(most), F.lit(1))), F.lit(1))
    d = d.withColumn(part, F.floor((F.col(before) + F.col(rank) - 1) / rows).cast("string")).drop(task, rank, before, most)
    return d.select(*equal.columns, F.col(part))


def assign_shards(rows: DataFrame, size: Column, limit: int, keys: list[Column]) -> DataFrame:
    """rows with shard (the bits of its bucket), depth (how many) and bytes.

    Give keys that tell rows apart. Rows whose whole hashes are equal (repeated
    rows) are counted off into parts that fit where they exceed the limit
    together: a plus sign and an ordinal follow the bits. A single row over the
    limit is a shard of its own. A null size counts 0. An empty table gives no
    rows. Columns of rows that are named shard, depth or bytes are replaced; all
    others pass, whatever their names.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    h, b, p, depth, shard = fresh(rows, "h", "b", "p", "depth", "shard")
    prefix = lambda k: F.shiftright(F.col(h), BITS - k)
    d = rows.withColumns({h: hash_bits(*keys), b: F.coalesce(size.cast("long"), F.lit(0).cast("long"))})
    total = lambda df, at: cut(df.groupBy(prefix(at).alias("p")).agg(F.sum(b).alias("b"), F.count("*").alias("n")))
    at, low, leaves = STEP, 0, []
    cells = total(d, at)
    while True:
        settled = cut(_depths(cells, low, at, limit))
        leaves.append((at, settled.where("depth IS NOT NULL")))
        over = settled.where("depth IS NULL").select(F.col("p").alias(p))
        if at >= BITS or over.isEmpty():
            break
        rest = d.withColumn(p, prefix(at)).join(over, p, "left_semi")
        at, low = at + STEP, at + 1
        cells = total(rest, at)
    out, found = d, []
    for k, leaf in leaves:
        found.append(f"{depth}{k}")
        out = out.withColumn(p, prefix(k)).join(leaf.select(F.col("p").alias(p), F.col("depth").alias(found[-1])), p, "left").drop(p)
    out = out.withColumn(depth, F.coalesce(*found, F.lit(BITS))).drop(*found)
    out = out.withColumn(shard, F.call_function("substring", F.lpad(F.bin(h), BITS, "0"), F.lit(1), F.col(depth)))
    if at >= BITS:
        whole, equal = out.where(F.col(depth) < BITS), out.where(F.col(depth) >= BITS)
        dealt = _dealt(equal, h, b, limit)
        part = dealt.columns[-1]
        out = whole.unionByName(dealt.withColumn(shard, F.concat(shard, F.lit("+"), part)).drop(part))
    return out.withColumns({"shard": F.col(shard), "depth": F.col(depth), "bytes": F.col(b)}).drop(h, b, shard, depth)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a shard meet in one task, which its limit bounds."""
    sharded.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, depth, bytes of every document, shards of up to LIMIT bytes of text."""
    docs = read(spark, sf_dir, "documents")
    d = docs.select("doc_id", "text")
    return assign_shards(d, F.octet_length("text"), LIMIT, [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))]).select("doc_id", "shard", F.col("depth").cast("long").alias("depth"), "bytes")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, ('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || chr(31) || md5(coalesce(text, ''))), 1, {BITS // 4}))::BIGINT AS h FROM documents),
k AS (SELECT unnest(range(0, 41))::INTEGER AS k),
s AS (SELECT k, h >> ({BITS} - k) AS q, sum(b) AS s, count(*) AS n FROM d, k GROUP BY ALL),
f AS (SELECT k, q FROM s WHERE s <= {LIMIT} OR n = 1),
m AS (SELECT doc_id, h, b, min(k) AS depth FROM d, f WHERE f.q = d.h >> ({BITS} - f.k) GROUP BY doc_id, h, b)
SELECT doc_id, substring(lpad(CASE WHEN h = 0 THEN '0' ELSE ltrim(bin(h), '0') END, {BITS}, '0'), 1, depth) AS shard, depth::BIGINT AS depth, b::BIGINT AS bytes FROM m
"""
