"""Domain views over the driver's star-schema tables.

Each view is one SELECT that both Spark SQL and DuckDB read alike: integer
arithmetic, CASE and concat only. `view` gives the DataFrame, `with_views` the
WITH clause that an oracle puts before its own query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_POWER = "CASE l_linenumber % 6 WHEN 0 THEN 1000 WHEN 1 THEN 10000 WHEN 2 THEN 100000 WHEN 3 THEN 1000000 WHEN 4 THEN 10000000 ELSE 100000000 END"
_LETTER = "substr('ACGT', CAST(1 + ({}) % 4 AS INT), 1)"
_OTHER = "substr('ACGTACG', CAST(2 + ({0}) % 4 + ({1}) % 3 AS INT), 1)"

VIEWS = {
    # Segments of copy number; t1 to t4 break ties of start_pos within (sample, chromosome).
    "segments": f"""SELECT concat('s', CAST(l_suppkey AS STRING)) AS sample, concat('chr', CAST(1 + l_partkey % 22 AS STRING)) AS chromosome,
      1 + (l_orderkey % 400) * 500000 + l_linenumber * 37000 AS start_pos,
      1 + (l_orderkey % 400) * 500000 + l_linenumber * 37000 + {_POWER} * (1 + CAST(l_quantity AS BIGINT) % 9) AS end_pos,
      CAST(l_quantity AS BIGINT) % 8 AS seg_val, l_partkey % 3 AS minor_cn, l_orderkey AS t1, l_partkey AS t2, l_linenumber AS t3, l_extendedprice AS t4 FROM lineitem""",
    # The same records as a careless file has them: mixed chromosome names, missing and fractional values.
    "raw_segments": f"""SELECT concat('s', CAST(l_suppkey AS STRING)) AS sample,
      concat(CASE l_linenumber % 3 WHEN 0 THEN 'CHR' WHEN 1 THEN '' ELSE 'chr' END, CASE WHEN l_partkey % 25 = 22 THEN '23' WHEN l_partkey % 25 = 23 THEN 'x' WHEN l_partkey % 25 = 24 THEN 'MT' ELSE CAST(1 + l_partkey % 25 AS STRING) END) AS chromosome,
      1 + (l_orderkey % 400) * 500000 + l_linenumber * 37000 AS start_pos, 1 + (l_orderkey % 400) * 500000 + l_linenumber * 37000 + {_POWER} AS end_pos,
      CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) + 0.25 END AS seg_val, l_partkey AS t1, l_orderkey AS t2, l_extendedprice AS t3 FROM lineitem""",
    "chrom_sizes": "SELECT concat('chr', CAST(k AS STRING)) AS chrom, 250000000 - k * 5000000 AS size, 90000000 - k * 1500000 AS cen_left, 93000000 - k * 1500000 AS cen_right FROM (SELECT DISTINCT 1 + l_partkey % 22 AS k FROM lineitem) AS u",
    "bands": "SELECT concat('chr', CAST(k AS STRING)) AS chrom, 1 + b * 10000000 AS start_pos, (b + 1) * 10000000 AS end_pos, concat('b', CAST(b AS STRING)) AS band FROM (SELECT DISTINCT 1 + l_partkey % 22 AS k FROM lineitem) AS u CROSS JOIN (SELECT DISTINCT p_size % 20 AS b FROM part) AS v",
    "variants": f"""SELECT concat('s', CAST(l_suppkey AS STRING)) AS sample, concat('chr', CAST(1 + l_partkey % 22 AS STRING)) AS chrom, 1 + l_orderkey % 5000 AS pos,
      {_LETTER.format("l_partkey")} AS ref, {_OTHER.format("l_partkey", "l_suppkey")} AS alt,
      concat({_LETTER.format("l_orderkey")}, {_LETTER.format("l_orderkey DIV4")}, {_LETTER.format("l_partkey")}, {_LETTER.format("l_linenumber + l_orderkey")}, {_LETTER.format("l_linenumber + l_suppkey")}) AS context,
      l_orderkey AS t1, l_partkey AS t2, l_linenumber AS t3, l_extendedprice AS t4 FROM lineitem""".replace("l_orderkey DIV4", "l_orderkey * 3 + l_partkey"),
    "indels": f"""SELECT concat('s', CAST(l_suppkey AS STRING)) AS sample, l_orderkey AS t1, l_partkey AS t2, l_linenumber AS t3, l_extendedprice AS t4, 1000 + l_orderkey AS pos,
      CASE l_linenumber % 3 WHEN 0 THEN concat({_LETTER.format("l_partkey")}, {_LETTER.format("l_orderkey")}, {_LETTER.format("l_suppkey")}) WHEN 1 THEN {_LETTER.format("l_partkey")} ELSE concat({_LETTER.format("l_partkey")}, {_LETTER.format("l_orderkey")}) END AS ref,
      CASE l_linenumber % 3 WHEN 1 THEN concat({_LETTER.format("l_partkey")}, {_LETTER.format("l_suppkey")}) ELSE {_LETTER.format("l_partkey")} END AS alt,
      concat({_LETTER.format("l_suppkey")}, {_LETTER.format("l_orderkey")}, {_LETTER.format("l_suppkey")}) AS upstream,
      concat({_LETTER.format("l_orderkey")}, {_LETTER.format("l_suppkey")}, {_LETTER.format("l_orderkey")}, {_LETTER.format("l_suppkey")}, {_LETTER.format("l_orderkey")}, {_LETTER.format("l_linenumber")}) AS downstream FROM lineitem""",
    "sv": """SELECT concat('s', CAST(l_suppkey AS STRING)) AS sample, concat('chr', CAST(1 + l_partkey % 6 AS STRING)) AS chr1, 1 + l_orderkey * 1000 AS start1, 1 + l_orderkey * 1000 + 10 AS end1,
      concat('chr', CAST(1 + (l_partkey + CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) % 6 AS STRING)) AS chr2, 1 + l_orderkey * 1000 + CASE l_linenumber % 6 WHEN 0 THEN 300 WHEN 1 THEN 5000 WHEN 2 THEN 50000 WHEN 3 THEN 500000 WHEN 4 THEN 5000000 ELSE 50000000 END AS start2,
      11 + l_orderkey * 1000 + CASE l_linenumber % 6 WHEN 0 THEN 300 WHEN 1 THEN 5000 WHEN 2 THEN 50000 WHEN 3 THEN 500000 WHEN 4 THEN 5000000 ELSE 50000000 END AS end2,
      CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand1, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand2, l_partkey AS t1, l_extendedprice AS t2 FROM lineitem""",
    "catalog": "SELECT CAST(c_nationkey AS STRING) AS sample, concat(o_orderpriority, ':', o_orderstatus) AS component, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CAST(c_nationkey AS STRING), concat(o_orderpriority, ':', o_orderstatus)",
    "exposure": "SELECT CAST(c_nationkey AS STRING) AS sample, c_mktsegment AS sig, count(*) AS amount FROM customer GROUP BY CAST(c_nationkey AS STRING), c_mktsegment",
    "signature": "SELECT p_brand AS sig, p_type AS component, count(*) AS n FROM part GROUP BY p_brand, p_type",
    "traits": "SELECT c_custkey AS id, c_mktsegment AS grp, CAST(c_nationkey % 5 AS STRING) AS region, c_nationkey % 3 = 0 AS flag, CAST(floor(c_acctbal) AS BIGINT) AS score, c_custkey % 97 AS extra FROM customer",
    "bootstrap": "SELECT p_brand AS sample, p_type AS sig, concat('Rep_', CAST(p_partkey AS STRING)) AS type, CAST(floor(p_retailprice) AS BIGINT) AS exposure FROM part",
    "transcripts": "SELECT concat('chr', CAST(1 + p_partkey % 22 AS STRING)) AS chrom, 1 + (p_partkey * 37) % 5000 AS start_pos, 1 + (p_partkey * 37) % 5000 + 40 AS end_pos, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, concat('g', CAST(p_partkey AS STRING)) AS gene FROM part",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
