"""Registered queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import catalog as C
from locusframe.operators import classify as K
from locusframe.operators import intervals as I
from locusframe.operators import rearrangements as R
from locusframe.operators import segments as S
from locusframe.operators import stats as T
from locusframe.operators import tables as B
from locusframe.operators import variants as V
from locusframe.plans import extraction as X
from locusframe.plans import grouping as P
from locusframe.plans import solutions as N
from locusframe.plans import tally as Y
from locusframe.sources import genomes as G
from locusframe.sources.readers import component_opportunities, opportunities, reordered
from locusframe.sources.domain import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORD = "start_pos, t1, t2, t3, t4"
AUTO = "chromosome IN (" + ", ".join(f"'{c}'" for c in S.AUTOSOMES) + ")"


def query(name: str, *views: str, sql: str | None = None):
    """Registers fn(*views) under the name; sql is the oracle behind the views' WITH clause."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[view(spark, sf_dir, v) for v in views])
        if sql is not None:
            ORACLES[name] = f"{with_views(*views)}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return fn

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def base(df: DataFrame) -> DataFrame:
    return df.select("sample", "chromosome", "start_pos", "end_pos", "seg_val")


# Cleaning

_NORM = "concat('chr', CASE WHEN upper(regexp_replace(chromosome, '^(chr|CHR)', '')) IN ('X', '23') THEN 'X' WHEN upper(regexp_replace(chromosome, '^(chr|CHR)', '')) IN ('Y', '24') THEN 'Y' ELSE regexp_replace(chromosome, '^(chr|CHR)', '') END)"
_KNOWN = "c IN (" + ", ".join(f"'{c}'" for c in S.CHROMOSOMES) + ")"


@query("normalize_chrom", "raw_segments", sql=f"SELECT {_NORM} AS chromosome, count(*) AS n FROM raw_segments GROUP BY 1")
def _(raw):
    return raw.groupBy(S.normalize_chromosome(F.col("chromosome")).alias("chromosome")).agg(F.count("*").alias("n"))


@query("read_segments_clean", "raw_segments", sql=f"SELECT sample, c AS chromosome, start_pos, end_pos, CAST(round_even(least(seg_val, 20), 0) AS INTEGER) AS seg_val FROM (SELECT *, {_NORM} AS c FROM raw_segments) WHERE seg_val IS NOT NULL AND {_KNOWN}")
def _(raw):
    return base(S.clean_segments(raw)[0])


@query("drop_invalid_segments", "raw_segments", sql=f"SELECT c AS chromosome, count(*) AS n FROM (SELECT *, {_NORM} AS c FROM raw_segments) WHERE seg_val IS NOT NULL AND NOT {_KNOWN} GROUP BY 1")
def _(raw):
    return S.clean_segments(raw)[1].groupBy("chromosome").agg(F.count("*").alias("n"))


@query("min_segnum_filter", "segments", sql="SELECT sample, count(*) AS n FROM segments GROUP BY sample HAVING count(*) >= 590")
def _(s):
    return S.at_least(s, 590).groupBy("sample").agg(F.count("*").alias("n"))


_GAPS = "CASE WHEN chromosome = 'chr7' AND sample LIKE '%1' THEN 'chrX' ELSE chromosome END"


# Gaps arise where chr7 goes by the name of chrX, so that some samples have none of the one and the others none of the other.
@query("complement_chromosomes", "segments", "chrom_sizes", sql=f"""
, f AS (SELECT sample, {_GAPS} AS chromosome, start_pos, end_pos, seg_val FROM segments), z AS (SELECT chrom, size FROM chrom_sizes UNION ALL SELECT 'chrX', 155000000 UNION ALL SELECT 'chrY', 57000000), p AS (SELECT sample, chrom, size FROM (SELECT DISTINCT sample FROM f), z WHERE chrom <> 'chrY')
SELECT sample, chromosome, start_pos, end_pos, seg_val FROM f UNION ALL SELECT sample, chrom, 1, size, 2 FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.sample = p.sample AND f.chromosome = p.chrom)""")
def _(s, sizes):
    sex = sizes.sparkSession.createDataFrame([("chrX", 155_000_000), ("chrY", 57_000_000)], "chrom string, size long")
    return base(S.complement_chromosomes(s.withColumn("chromosome", F.expr(_GAPS)), sizes.select("chrom", "size").unionByName(sex)))


_LOH = "seg_val >= 1 AND least(seg_val - minor_cn, minor_cn) = 0 AND end_pos - start_pos > 9999"


@query("label_loh", "segments", sql=f"SELECT sample, chromosome, count(*) AS n, CAST(sum(CASE WHEN {_LOH} THEN 1 ELSE 0 END) AS BIGINT) AS n_loh FROM segments GROUP BY 1, 2")
def _(s):
    return S.label_loh(s).groupBy("sample", "chromosome").agg(F.count("*").alias("n"), F.sum(F.col("loh").cast("int")).alias("n_loh"))


@query("sex_adjust_cn", "segments", sql="SELECT sample, CAST(sum(CASE WHEN chromosome = 'chr7' AND sample LIKE '%1' THEN seg_val * 2 ELSE seg_val END) AS BIGINT) AS total FROM segments GROUP BY 1")
def _(s):
    x = s.withColumn("chromosome", F.when(F.col("chromosome") == "chr7", "chrX").otherwise(F.col("chromosome")))
    sex = s.select("sample").distinct().withColumn("sex", F.when(F.col("sample").endswith("1"), "male").otherwise("female"))
    return S.sex_adjust(x, sex).groupBy("sample").agg(F.sum("seg_val").alias("total"))


@query("subset_segments", "segments", sql="SELECT sample, CAST(sum(CASE WHEN seg_val > 3 AND minor_cn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN seg_val > 3 AND minor_cn > 0 THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM segments GROUP BY 1")
def _(s):
    kept, dropped = S.subset(s, "seg_val > 3 AND minor_cn > 0")
    both = kept.withColumn("k", F.lit(1)).unionByName(dropped.withColumn("k", F.lit(0)))
    return both.groupBy("sample").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("dropped"))


# Segment core

@query("merge_adjacent_segments", "segments", sql=f"""
, a AS (SELECT *, CASE WHEN lag(seg_val) OVER w = seg_val THEN 0 ELSE 1 END AS f, row_number() OVER w AS rn FROM segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY {ORD})),
b AS (SELECT *, sum(f) OVER (PARTITION BY sample, chromosome ORDER BY rn) AS g FROM a)
SELECT sample, chromosome, min(start_pos) AS start_pos, arg_max(end_pos, rn) AS end_pos, any_value(seg_val) AS seg_val, count(*) AS n_merged FROM b GROUP BY sample, chromosome, g""")
def _(s):
    return S.merge_adjacent(s)


_SUM = f"""SELECT sample, count(*) AS n_of_seg, count(*) FILTER (seg_val <> 2) AS n_of_cnv, count(*) FILTER (seg_val > 2) AS n_of_amp, count(*) FILTER (seg_val < 2) AS n_of_del,
count(DISTINCT chromosome) FILTER ({AUTO} AND seg_val <> 2) AS n_of_vchr, round(sum(CASE WHEN {AUTO} AND seg_val <> 2 THEN end_pos - start_pos + 1 ELSE 0 END) / %s, 6) AS cna_burden FROM segments GROUP BY sample"""


@query("cn_summary_called", "segments", sql=_SUM % f"sum(CASE WHEN {AUTO} THEN end_pos - start_pos + 1 END)")
def _(s):
    return S.cn_summary(s, digits=None).withColumn("cna_burden", F.round("cna_burden", 6))


@query("cn_summary_wg", "segments", sql=_SUM % "2881033286")
def _(s):
    return S.cn_summary(s, 2881033286, digits=None).withColumn("cna_burden", F.round("cna_burden", 6))


@query("cn_ploidy", "segments", sql="SELECT sample, round(sum((end_pos - start_pos + 1) * seg_val) / sum(end_pos - start_pos + 1), 6) AS ploidy FROM segments GROUP BY sample")
def _(s):
    return S.ploidy(s, digits=None).select("sample", *r6("ploidy"))


@query("ploh_score", "segments", "chrom_sizes", sql="SELECT sample, round(sum(CASE WHEN seg_val >= 1 AND minor_cn = 0 THEN end_pos - start_pos + 1 ELSE 0 END) / (SELECT sum(size) FROM chrom_sizes), 6) AS ploh FROM segments GROUP BY sample")
def _(s, sizes):
    return S.ploh_score(s, sizes).select("sample", *r6("ploh"))


_ARM = """, a AS (SELECT s.*, size, cen_left AS pe, cen_right AS qs, CASE WHEN end_pos <= cen_left AND start_pos >= 1 THEN 1 WHEN end_pos <= size AND start_pos >= cen_right THEN 2 WHEN start_pos >= 1 AND start_pos <= cen_left AND end_pos >= cen_right AND end_pos <= size THEN 3
  WHEN start_pos < cen_left AND end_pos < cen_right THEN 4 WHEN start_pos > cen_left AND start_pos < cen_right AND end_pos > cen_right THEN 5 ELSE 6 END AS flag FROM segments s LEFT JOIN chrom_sizes ON chrom = chromosome),
b AS (SELECT *, CASE WHEN flag IN (1, 4) THEN 'p' WHEN flag IN (2, 5) THEN 'q' ELSE 'pq' END AS arm, CASE flag WHEN 1 THEN (end_pos - start_pos + 1) / pe WHEN 2 THEN (end_pos - start_pos + 1) / (size - qs + 1) WHEN 4 THEN (pe - start_pos + 1) / pe WHEN 5 THEN (end_pos - qs + 1) / (size - qs + 1) ELSE 2 * (end_pos - start_pos + 1) / size END AS fraction FROM a)"""


@query("arm_annotation", "segments", "chrom_sizes", sql=_ARM + " SELECT sample, chromosome, start_pos, end_pos, concat(substr(chromosome, 4), arm) AS location, flag AS arm_flag, round(fraction, 6) AS fraction FROM b")
def _(s, c):
    return S.arm_annotation(s, c).select("sample", "chromosome", "start_pos", "end_pos", "location", "arm_flag", *r6("fraction"))


@query("aneuploidy_score", "segments", "chrom_sizes", sql=_ARM + """, c AS (SELECT sample, concat(substr(chromosome, 4), h) AS name, seg_val * CASE WHEN arm = 'pq' THEN fraction / 2 ELSE fraction END AS x FROM b, (VALUES ('p'), ('q')) AS v(h) WHERE NOT (arm = 'pq' AND round_even(fraction, 0) < 1) AND (arm = h OR arm = 'pq')),
d AS (SELECT sample, name, sum(x) AS cn FROM c GROUP BY 1, 2) SELECT sample, CAST(sum(abs(greatest(least(round_even(cn - 2, 0), 1), -1))) AS BIGINT) AS ascore FROM d GROUP BY sample""")
def _(s, c):
    return S.aneuploidy_score(S.arm_annotation(s, c))


@query("cn_freq_by_band", "segments", "bands", sql="""SELECT chrom, b.start_pos, b.end_pos, band, round(count(DISTINCT sample) FILTER (seg_val > 2) / (SELECT count(DISTINCT sample) FROM segments), 6) AS amp, round(count(DISTINCT sample) FILTER (seg_val < 2) / (SELECT count(DISTINCT sample) FROM segments), 6) AS del
FROM bands b LEFT JOIN segments s ON chrom = chromosome AND s.start_pos <= b.end_pos AND s.end_pos >= b.start_pos GROUP BY 1, 2, 3, 4""")
def _(s, b):
    return S.freq_by_band(s, b).select("chrom", "start_pos", "end_pos", "band", *r6("amp", "del"))


@query("seg_band_matrix", "segments", "bands", sql="SELECT chrom, band, sample, CAST(max(seg_val) AS BIGINT) AS value FROM bands b JOIN segments s ON chrom = chromosome AND s.start_pos <= b.end_pos AND s.end_pos >= b.start_pos GROUP BY 1, 2, 3")
def _(s, b):
    return S.band_values(s, b, F.max("seg_val"))


# Scores

@query("score_cna_load", "segments", sql="SELECT sample, round(log2(count(*) FILTER (seg_val <> 2) + 1), 6) AS cna_load FROM segments GROUP BY sample")
def _(s):
    return S.cna_load(s, None).select("sample", *r6("cna_load"))


@query("score_macn", "segments", sql="SELECT sample, round(avg(seg_val), 6) AS macn, round(sum(seg_val * (end_pos - start_pos + 1)) / sum(end_pos - start_pos + 1), 6) AS weighted_macn FROM segments WHERE seg_val <> 2 GROUP BY sample")
def _(s):
    return S.macn(s, None).select("sample", *r6("macn", "weighted_macn"))


_TD = """, x AS (SELECT sample, chromosome, count(*) FILTER (seg_val > 2 AND end_pos - start_pos + 1 BETWEEN 1000 AND 2000000) AS x FROM segments GROUP BY 1, 2),
t AS (SELECT sample, sum(x) AS t, count(*) AS k FROM x GROUP BY 1), d AS (SELECT sample, t, sum(abs(x - t / 22)) + (22 - k) * t / 22 AS d FROM x JOIN t USING (sample) GROUP BY sample, t, k)"""


@query("score_td", "segments", sql=_TD + " SELECT sample, round(t / (d + 1), 6) AS tdp, round(CASE WHEN t > 0 THEN -d / t END, 6) AS tdp_pnas FROM d")
def _(s):
    return S.tandem_duplication(s).select("sample", *r6("tdp", "tdp_pnas"))


_CHROMO = f", n AS (SELECT sample, chromosome, lag(seg_val, 1, 2) OVER w AS l, seg_val AS v, lead(seg_val, 1, 2) OVER w AS r FROM segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY {ORD})), h AS (SELECT sample, chromosome, count(*) FILTER (l = 2 AND v = 1 AND r = 2) AS c FROM n GROUP BY 1, 2)"


@query("score_chromoth", "segments", sql=_CHROMO + " SELECT sample, CAST(sum(c * c) AS BIGINT) AS chromoth_state FROM h GROUP BY sample")
def _(s):
    return S.chromothripsis(s)


@query("scoring_all", "segments", sql=_TD + _CHROMO + """, c AS (SELECT sample, CAST(sum(c * c) AS BIGINT) AS chromoth_state FROM h GROUP BY sample), m AS (SELECT sample, round(log2(count(*) FILTER (seg_val <> 2) + 1), 6) AS cna_load, round(avg(seg_val) FILTER (seg_val <> 2), 6) AS macn FROM segments GROUP BY sample)
SELECT sample, cna_load, macn, round(t / (d + 1), 6) AS tdp, chromoth_state FROM m JOIN d USING (sample) JOIN c USING (sample)""")
def _(s):
    return S.scoring(s, digits=None).select("sample", *r6("cna_load", "macn", "tdp"), "chromoth_state")


# Interval joins

@query("interval_overlap_left", "segments", "bands", sql="SELECT sample, chromosome, s.start_pos, s.end_pos, s.t1, band FROM segments s LEFT JOIN bands b ON chrom = chromosome AND s.start_pos <= b.end_pos AND s.end_pos >= b.start_pos")
def _(s, b):
    right = b.select("chrom", F.col("start_pos").alias("bs"), F.col("end_pos").alias("be"), "band")
    left = s.select("sample", "chromosome", "start_pos", "end_pos", "t1")
    return I.overlap_join(left, right, ("chromosome", "start_pos", "end_pos"), ("chrom", "bs", "be"), "left").select("sample", "chromosome", "start_pos", "end_pos", "t1", "band")


@query("interval_overlap_binned", "segments", "bands", sql="SELECT chrom, band, count(*) AS n, CAST(sum(least(s.end_pos, b.end_pos) - greatest(s.start_pos, b.start_pos) + 1) AS BIGINT) AS shared FROM segments s JOIN bands b ON chrom = chromosome AND s.start_pos <= b.end_pos AND s.end_pos >= b.start_pos GROUP BY 1, 2")
def _(s, b):
    right = b.select("chrom", F.col("start_pos").alias("bs"), F.col("end_pos").alias("be"), "band")
    hit = I.overlap_join(s, right, ("chromosome", "start_pos", "end_pos"), ("chrom", "bs", "be"), small=False)
    return hit.groupBy("chrom", "band").agg(F.count("*").alias("n"), F.sum(I.intersect_size(F.col("start_pos"), F.col("end_pos"), F.col("bs"), F.col("be"))).alias("shared"))


@query("interval_first_match", "variants", "transcripts", sql="""SELECT v.t1, v.t2, v.t3, v.t4, arg_min(gene, (t.start_pos, t.end_pos, gene)) AS gene FROM variants v JOIN transcripts t ON t.chrom = v.chrom AND pos BETWEEN t.start_pos AND t.end_pos GROUP BY 1, 2, 3, 4""")
def _(v, t):
    right = t.select(F.col("chrom").alias("tc"), F.col("start_pos").alias("ts"), F.col("end_pos").alias("te"), "gene")
    return I.first_match(v, right, ("chrom", "pos", "pos"), ("tc", "ts", "te"), ["t1", "t2", "t3", "t4"], "gene")


_DBL = ", o AS (SELECT sample, chrom, pos, arg_min(ref, (t1, t2, t3, t4)) AS r, arg_min(alt, (t1, t2, t3, t4)) AS a FROM variants GROUP BY 1, 2, 3), d AS (SELECT sample, chrom, pos, lead(pos) OVER w AS np, concat(r, lead(r) OVER w) AS ref, concat(a, lead(a) OVER w) AS alt FROM o WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos))"


@query("interval_within_pairs", "variants", sql=_DBL + " SELECT sample, chrom, pos, ref, alt FROM d WHERE np = pos + 1")
def _(v):
    return V.find_doublets(v)


@query("interval_self_flank", "segments", sql="SELECT a.sample, a.chromosome, a.start_pos, a.t1, a.t2, a.t3, count(*) - 1 AS n_near FROM segments a JOIN segments b ON a.sample = b.sample AND a.chromosome = b.chromosome AND b.start_pos <= a.start_pos + 5000000 AND b.end_pos >= greatest(a.start_pos - 5000000, 1) GROUP BY a.sample, a.chromosome, a.start_pos, a.t1, a.t2, a.t3, a.t4")
def _(s):
    return I.self_flank(s).select("sample", "chromosome", "start_pos", "t1", "t2", "t3", "n_near")


@query("interval_point_semi", "variants", "transcripts", sql="SELECT sample, count(*) AS n FROM variants v WHERE EXISTS (SELECT 1 FROM transcripts t WHERE t.chrom = v.chrom AND pos BETWEEN start_pos AND end_pos) GROUP BY sample")
def _(v, t):
    right = t.select(F.col("chrom").alias("tc"), F.col("start_pos").alias("ts"), F.col("end_pos").alias("te"))
    return I.point_in(v, right, ("chrom", "pos"), ("tc", "ts", "te")).groupBy("sample").agg(F.count("*").alias("n"))


@query("interval_intersect_size", "segments", sql="SELECT sample, CAST(sum(greatest(0, least(end_pos, 50000000) - greatest(start_pos, 20000000) + 1)) AS BIGINT) AS shared FROM segments GROUP BY sample")
def _(s):
    return s.groupBy("sample").agg(F.sum(I.intersect_size(F.col("start_pos"), F.col("end_pos"), F.lit(20_000_000), F.lit(50_000_000))).alias("shared"))


@query("interval_chunks", "chrom_sizes", sql="SELECT chrom, k::INTEGER AS chunk, CAST(round_even(1 + size * k / 7, 0) AS BIGINT) AS chunk_start, CAST(round_even(1 + size * (k + 1) / 7, 0) AS BIGINT) - 1 AS chunk_end FROM chrom_sizes, range(7) AS t(k)")
def _(c):
    return I.chunks(c.withColumn("s", F.lit(1).cast("long")), "s", "size", 7).select("chrom", "chunk", "chunk_start", "chunk_end")


# Copy-number classes

_STATE = f"CASE WHEN seg_val = 0 THEN 'homdel' WHEN {_LOH} THEN 'LOH' ELSE 'het' END"
_LEN = "(end_pos - start_pos + 1)"
_C40 = f"concat_ws(':', CASE WHEN seg_val <= 1 THEN '0-1' WHEN seg_val <= 2 THEN '2' WHEN seg_val <= 4 THEN '3-4' ELSE '5+' END, {_STATE}, CASE WHEN {_LEN} <= 10000 THEN '0-10Kb' WHEN {_LEN} <= 100000 THEN '10Kb-100Kb' WHEN {_LEN} <= 1000000 THEN '100Kb-1Mb' WHEN {_LEN} <= 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END)"
_C48 = f"concat_ws(':', CASE WHEN seg_val <= 0 THEN '0' WHEN seg_val <= 1 THEN '1' WHEN seg_val <= 2 THEN '2' WHEN seg_val <= 4 THEN '3-4' WHEN seg_val <= 8 THEN '5-8' ELSE '9+' END, {_STATE}, CASE WHEN {_LEN} <= 100000 THEN '0-100Kb' WHEN {_LEN} <= 1000000 THEN '100Kb-1Mb' WHEN seg_val = 0 THEN '>1Mb' WHEN {_LEN} <= 10000000 THEN '1Mb-10Mb' WHEN {_LEN} <= 40000000 THEN '10Mb-40Mb' ELSE '>40Mb' END)"


@query("cn40_catalog", "segments", sql=f"SELECT sample, c AS component, count(*) AS n FROM (SELECT sample, {_C40} AS c FROM segments) WHERE c NOT LIKE '0-1:het:%' GROUP BY 1, 2")
def _(s):
    return K.count_components(K.label_40_48(S.label_loh(s)), "cn40")


@query("cn48_catalog", "segments", sql=f"SELECT sample, c AS component, count(*) AS n FROM (SELECT sample, {_C48} AS c FROM segments) WHERE c NOT LIKE '1:het:%' GROUP BY 1, 2")
def _(s):
    return K.count_components(K.label_40_48(S.label_loh(s)), "cn48")


_CTX = f""", q AS (SELECT *, seg_val - lag(seg_val, 1, 2) OVER w AS l, seg_val - lead(seg_val, 1, 2) OVER w AS r FROM segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY {ORD})),
k AS (SELECT *, concat(CASE WHEN l <= 0 THEN 'H' ELSE 'L' END, CASE WHEN r <= 0 THEN 'H' ELSE 'L' END) AS cs, concat(CASE WHEN abs(l) <= 2 THEN 'A' ELSE 'B' END, CASE WHEN abs(r) <= 2 THEN 'A' ELSE 'B' END) AS ab,
  CASE WHEN {_LEN} <= 50000 THEN 'S' WHEN {_LEN} <= 500000 THEN 'M' WHEN {_LEN} <= 5000000 THEN 'L' ELSE 'E' END AS ss, CASE WHEN seg_val <= 4 THEN CAST(seg_val AS STRING) ELSE '5+' END AS cn, CASE WHEN seg_val <= 4 THEN CAST(seg_val AS STRING) WHEN seg_val <= 8 THEN '5-8' ELSE '9+' END AS xn FROM q)"""


@query("cn_tx_features", "segments", sql=_CTX + " SELECT sample, cs, ab, ss, count(*) AS n FROM k GROUP BY 1, 2, 3, 4")
def _(s):
    return K.context(s).withColumn("ss", K.size_class()).groupBy("sample", "cs", "ab", "ss").agg(F.count("*").alias("n"))


_TCLASS = _CTX + """, m AS (SELECT sample, ss, cs, cn, CASE
  WHEN ab <> 'AA' AND cs IN ('HL', 'LH') AND cn IN ('1', '2', '3', '4') THEN '3C' WHEN ab <> 'AA' AND cs = 'LL' AND cn IN ('3', '4') THEN '3C' WHEN ab <> 'AA' AND concat(ss, cs) IN ('LHH', 'EHH') THEN '3C'
  WHEN ab <> 'AA' AND concat(ss, cs, cn) IN ('SHH0', 'MHH0', 'MHH1') THEN '3C'
  WHEN ab IN ('AB', 'BA') AND concat(ss, ':', cs, ':', cn) IN ('S:HH:1', 'S:HH:3', 'S:HH:4', 'S:HH:5+', 'S:LL:5+', 'M:HH:2', 'M:HH:3', 'M:HH:4', 'M:HH:5+', 'M:LL:5+') THEN '2C' ELSE ab END AS st
  FROM k WHERE NOT (cs <> 'HH' AND cn = '0') AND NOT (cs = 'LL' AND cn IN ('1', '2') AND ab <> 'AA'))"""


@query("cn_t_standard_catalog", "segments", sql=_TCLASS + " SELECT sample, concat_ws(':', ss, cs, cn, st) AS component, count(*) AS n FROM m GROUP BY 1, 2")
def _(s):
    return K.count_components(K.label_t(s), "t_standard")


@query("cn_t_simplified_catalog", "segments", sql=_TCLASS + " SELECT sample, concat_ws(':', ss, CASE WHEN cs IN ('HL', 'LH') THEN 'LD' ELSE cs END, cn, st) AS component, count(*) AS n FROM m GROUP BY 1, 2")
def _(s):
    return K.count_components(K.label_t(s), "t_simple")


@query("cn_x_catalog", "segments", sql=_CTX + ", m AS (SELECT sample, ss, cs, xn, CASE WHEN ab = 'AA' THEN 'AA' ELSE 'BB' END AS st FROM k) SELECT sample, concat_ws(':', ss, CASE WHEN cs IN ('HL', 'LH') THEN 'LD' ELSE cs END, xn, st) AS component, count(*) AS n FROM m WHERE NOT (cs <> 'HH' AND (xn = '0' OR (xn IN ('1', '2') AND st = 'BB'))) GROUP BY 1, 2")
def _(s):
    return K.count_components(K.label_x(s), "x_simple")


# Feature distributions (method W)

def _values(df: DataFrame) -> DataFrame:
    return df.groupBy("sample", "value").agg(F.count("*").alias("n"))


@query("cnw_segsize", "segments", sql=f"SELECT sample, {_LEN} AS value, count(*) AS n FROM segments GROUP BY 1, 2")
def _(s):
    return _values(K.feature_segsize(s))


@query("cnw_cn", "segments", sql="SELECT sample, seg_val AS value, count(*) AS n FROM segments GROUP BY 1, 2")
def _(s):
    return _values(K.feature_cn(s))


@query("cnw_changepoint", "segments", sql=f", c AS (SELECT sample, abs(seg_val - lag(seg_val) OVER (PARTITION BY sample, chromosome ORDER BY {ORD})) AS d, count(*) OVER (PARTITION BY sample, chromosome) AS k FROM segments) SELECT sample, CASE WHEN k = 1 THEN 0 ELSE d END AS value, count(*) AS n FROM c WHERE k = 1 OR d IS NOT NULL GROUP BY 1, 2")
def _(s):
    return _values(K.feature_changepoint(s))


@query("cnw_nchrv", "segments", sql="SELECT sample, count(DISTINCT chromosome) FILTER (seg_val <> 2) AS value FROM segments GROUP BY 1")
def _(s):
    return K.feature_nchrv(s)


@query("cnw_bochr", "segments", sql="SELECT sample, CAST(substr(chromosome, 4) AS BIGINT) AS value, count(*) AS n FROM segments WHERE seg_val <> 2 GROUP BY 1, 2")
def _(s):
    return _values(K.feature_bochr(s))


@query("cnw_nc50", "segments", sql=", c AS (SELECT sample, chromosome, count(*) FILTER (seg_val <> 2) AS c FROM segments GROUP BY 1, 2), r AS (SELECT sample, row_number() OVER w AS r, sum(c) OVER w AS run, sum(c) OVER (PARTITION BY sample) AS al FROM c WINDOW w AS (PARTITION BY sample ORDER BY c DESC, chromosome)) SELECT sample, coalesce(min(r) FILTER (al > 0 AND 2 * run >= al), 0) AS value FROM r GROUP BY 1")
def _(s):
    return K.feature_nc50(s)


@query("cnw_oscillation", "segments", sql=f"""
, v AS (SELECT sample, chromosome, row_number() OVER w AS i, count(*) OVER (PARTITION BY sample, chromosome) AS k, CASE WHEN seg_val = lag(seg_val, 2) OVER w AND seg_val <> lag(seg_val) OVER w THEN 1 ELSE 0 END AS h FROM segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY {ORD})),
g AS (SELECT *, sum(1 - h) OVER (PARTITION BY sample, chromosome ORDER BY i) AS g FROM v), o AS (SELECT sample, chromosome, i, k, sum(h) OVER (PARTITION BY sample, chromosome, g ORDER BY i) AS o FROM g),
p AS (SELECT *, lead(o) OVER (PARTITION BY sample, chromosome ORDER BY i) AS x FROM o WHERE i >= 3)
SELECT sample, value, count(*) AS n FROM (SELECT sample, CAST(o AS BIGINT) AS value FROM p WHERE x = 0 OR (x IS NULL AND o > 0) UNION ALL SELECT DISTINCT ON (sample, chromosome) sample, 0 FROM v WHERE k < 3) GROUP BY 1, 2""")
def _(s):
    return _values(K.feature_oscillation(s))


@query("cnw_oscillation_index", "segments", sql=f"""
, v AS (SELECT sample, chromosome, row_number() OVER w AS i, CASE WHEN seg_val = lag(seg_val, 2) OVER w AND seg_val <> lag(seg_val) OVER w THEN 1 ELSE 0 END AS h FROM segments WINDOW w AS (PARTITION BY sample, chromosome ORDER BY {ORD})),
g AS (SELECT *, sum(h) OVER (PARTITION BY sample, chromosome ORDER BY i) AS run FROM v), q AS (SELECT *, max(CASE WHEN h = 0 THEN i END) OVER (PARTITION BY sample, chromosome ORDER BY i) AS head FROM g),
e AS (SELECT sample, chromosome, head - 1 AS a, max(i) AS b, CAST(sum(h) AS BIGINT) AS value FROM q GROUP BY sample, chromosome, head)
SELECT sample, value, count(*) AS n FROM (SELECT v.sample, max(coalesce(e.value, 0)) AS value FROM v JOIN e ON e.sample = v.sample AND e.chromosome = v.chromosome AND v.i BETWEEN e.a AND e.b GROUP BY v.sample, v.chromosome, v.i) GROUP BY 1, 2""")
def _(s):
    return _values(K.oscillation_index(s).select("sample", F.col("n_oscillation").cast("long").alias("value")))


@query("cnw_bp10mb", "segments", "chrom_sizes", sql=f"""
, e AS (SELECT sample, chromosome, end_pos, lead(start_pos) OVER (PARTITION BY sample, chromosome ORDER BY {ORD}) AS nx FROM segments), c AS (SELECT sample, chromosome, greatest((end_pos + 9999998) // 10000000 - 1, 0) AS bin, count(*) AS c FROM e WHERE nx IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT sample, chromosome FROM segments), d AS (SELECT chrom, unnest(range((size + 9999999) // 10000000)) AS bin FROM chrom_sizes)
SELECT sample, value, count(*) AS n FROM (SELECT p.sample, coalesce(c, 0) AS value FROM p JOIN d ON chrom = p.chromosome LEFT JOIN c ON c.sample = p.sample AND c.chromosome = p.chromosome AND c.bin = d.bin) GROUP BY 1, 2""")
def _(s, c):
    return _values(K.feature_breakpoints(s, c))


@query("cnw_bparm", "segments", "chrom_sizes", sql="""
, a AS (SELECT sample, chromosome, count(*) AS k, count(*) FILTER (end_pos < cen_right) AS q1, count(*) FILTER (end_pos > cen_right) AS q2 FROM segments JOIN chrom_sizes ON chrom = chromosome WHERE NOT (start_pos > cen_left AND end_pos < cen_right) GROUP BY 1, 2)
SELECT sample, value, count(*) AS n FROM (SELECT sample, unnest(CASE WHEN k < 2 THEN [0] WHEN q2 = 0 THEN [q1 - 1] WHEN q1 = 0 THEN [q2 - 1] ELSE [q1, q2 - 1] END) AS value FROM a) GROUP BY 1, 2""")
def _(s, c):
    return _values(K.feature_bparm(s, c))


@query("cnw_component_catalog", "segments", sql="""SELECT sample, concat('CN[', CASE WHEN seg_val <= 4 THEN CAST(seg_val AS STRING) WHEN seg_val <= 8 THEN '>4 & <=8' ELSE '>8' END, ']') AS component, count(*) AS n FROM segments GROUP BY 1, 2""")
def _(s):
    values = K.feature_cn(s).select("sample", F.lit("CN").alias("feature"), F.col("value").cast("double").alias("value"))
    return K.count_bins(values, s.sparkSession.createDataFrame(K.component_bins(), "feature string, component string, label string, low double, high double"))


_FEATURES = {"BP10MB": "cnw_bp10mb", "BPArm": "cnw_bparm", "CN": "cnw_cn", "CNCP": "cnw_changepoint", "OsCN": "cnw_oscillation", "NC50": "cnw_nc50", "BoChr": "cnw_bochr", "SS": "cnw_segsize"}
_EDGE = {float("inf"): "'Infinity'::DOUBLE", float("-inf"): "'-Infinity'::DOUBLE"}
_BINS = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{c}', '{k}', {_EDGE.get(a, a)}, {_EDGE.get(z, z)})" for f, c, k, a, z in K.component_bins()) + ") AS b(feature, component, label, low, high)"
_W_ALL = f", bins AS ({_BINS}), f AS (" + " UNION ALL ".join(
    f"SELECT sample, '{f}' AS feature, {'log10(value)' if f == 'SS' else 'CAST(value AS DOUBLE)'} AS value, {'1' if q == 'cnw_nc50' else 'n'} AS n FROM ({ORACLES[q]})" for f, q in _FEATURES.items()
) + ") SELECT sample, component, CAST(sum(n) AS BIGINT) AS n FROM f JOIN bins ON bins.feature = f.feature AND ((label = 'point' AND value = low) OR (label = 'range' AND value > low AND value <= high)) GROUP BY 1, 2"


@query("cnw_all_components", "segments", "chrom_sizes", sql=_W_ALL)
def _(s, c):
    return Y.tally(s, "segments", method="W", sizes=c)["cn_w"]


_NEAR = ", n AS (SELECT a.sample, a.chromosome, a.start_pos, a.t1, a.t2, a.t3, a.t4, count(*) - 1 AS n_near FROM segments a JOIN segments b ON a.sample = b.sample AND a.chromosome = b.chromosome AND b.start_pos <= a.start_pos + 5000000 AND b.end_pos >= greatest(a.start_pos - 5000000, 1) GROUP BY ALL)"


@query("cn_t_complex_catalog", "segments", sql=_CTX + _NEAR + f""" SELECT sample, concat_ws(':', CASE WHEN floor(log10({_LEN})) <= 2 THEN '2-' WHEN floor(log10({_LEN})) > 7 THEN '8+' ELSE CAST(CAST(floor(log10({_LEN})) AS INTEGER) AS STRING) END, cs, CASE WHEN seg_val <= 8 THEN CAST(seg_val AS STRING) ELSE '9+' END,
  concat('P', CASE WHEN n_near <= 2 THEN '2-' WHEN n_near <= 4 THEN '4-' WHEN n_near <= 6 THEN '6-' WHEN n_near <= 8 THEN '8-' WHEN n_near <= 10 THEN '10-' ELSE '11+' END)) AS component, count(*) AS n FROM k JOIN n USING (sample, chromosome, start_pos, t1, t2, t3, t4) GROUP BY 1, 2""")
def _(s):
    return Y.tally(I.self_flank(s), "segments", method="T")["cn_t_complex"]


_T_LOH = _TCLASS.replace("IN ('LHH', 'EHH')", "IN ('LHH', 'EHH') AND cn <> '2+LOH'").replace("FROM k WHERE", f"FROM (SELECT * REPLACE (CASE WHEN {_LOH} AND seg_val <> 1 THEN '2+LOH' ELSE cn END AS cn) FROM k) WHERE")


@query("cn_t_loh_catalog", "segments", sql=_T_LOH + " SELECT sample, concat_ws(':', ss, cs, cn, st) AS component, count(*) AS n FROM m GROUP BY 1, 2")
def _(s):
    return Y.tally(S.label_loh(s), "segments", method="T", with_loh=True)["cn_t_standard"]


@query("cn_x_loh_catalog", "segments", sql=_CTX + f", m AS (SELECT sample, ss, cs, CASE WHEN {_LOH} AND seg_val = 2 THEN '2LOH' WHEN {_LOH} AND seg_val > 2 THEN '3+LOH' ELSE xn END AS xn, CASE WHEN ab = 'AA' THEN 'AA' ELSE 'BB' END AS st FROM k) SELECT sample, concat_ws(':', ss, cs, xn, st) AS component, count(*) AS n FROM m WHERE NOT (cs <> 'HH' AND (xn = '0' OR (xn IN ('1', '2', '2LOH') AND st = 'BB'))) GROUP BY 1, 2")
def _(s):
    return Y.tally(S.label_loh(s), "segments", method="X", with_loh=True)["cn_x_standard"]


@query("tally_without_chromosomes", "segments", sql=f"SELECT sample, c AS component, count(*) AS n FROM (SELECT sample, {_C48} AS c FROM segments WHERE chromosome NOT IN ('chr1', 'chr2')) WHERE c NOT LIKE '1:het:%' GROUP BY 1, 2")
def _(s):
    return Y.tally(S.label_loh(s), "segments", method="S", ignore_chrs=("chr1", "chr2"))["cn48"]


# Small variants

_FOLD = "CASE WHEN ref IN ('A', 'G') THEN translate(concat(ref, '>', alt), 'ACGT', 'TGCA') ELSE concat(ref, '>', alt) END"
_CTX5 = "CASE WHEN ref IN ('A', 'G') THEN translate(reverse(context), 'ACGT', 'TGCA') ELSE context END"
_SBS = f", f AS (SELECT *, {_FOLD} AS sub, {_CTX5} AS ctx FROM variants WHERE ref <> alt)"


@query("variant_type", "indels", sql="SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) < length(alt) THEN 'INS' WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'Unknown' END AS variant_type, count(*) AS n FROM indels GROUP BY 1")
def _(v):
    return v.groupBy(V.variant_type(F.col("ref"), F.col("alt")).alias("variant_type")).agg(F.count("*").alias("n"))


@query("sbs6_catalog", "variants", sql=_SBS + " SELECT sample, sub AS component, count(*) AS n FROM f GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_sbs(v), "sbs6")


@query("sbs96_catalog", "variants", sql=_SBS + " SELECT sample, concat(substr(ctx, 2, 1), '[', sub, ']', substr(ctx, 4, 1)) AS component, count(*) AS n FROM f GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_sbs(v), "sbs96")


@query("sbs1536_catalog", "variants", sql=_SBS + " SELECT sample, concat(substr(ctx, 1, 2), '[', sub, ']', substr(ctx, 4, 2)) AS component, count(*) AS n FROM f GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_sbs(v), "sbs1536")


@query("sbs6_catalog_wide", "variants", sql=_SBS + " SELECT sample, " + ", ".join(f"count(*) FILTER (sub = '{c}') AS \"{c}\"" for c in V.SUBSTITUTIONS) + " FROM f GROUP BY 1")
def _(v):
    return K.wide(K.count_components(V.label_sbs(v), "sbs6"), V.SUBSTITUTIONS)


_D78 = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in V.doublet_pairs().items()) + ") AS x(pair, cls)"


@query("dbs78_catalog", "variants", sql=_DBL + f", p AS ({_D78}) SELECT sample, cls AS component, count(*) AS n FROM d JOIN p ON pair = concat(ref, '>', alt) WHERE np = pos + 1 GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_dbs(V.find_doublets(v)), "dbs78")


@query("dbs1248_catalog", "variants", sql=_DBL + f", p AS ({_D78}) SELECT sample, concat(substr('ACGT', CAST(1 + pos % 4 AS INTEGER), 1), '[', cls, ']', substr('ACGT', CAST(1 + (pos * 3) % 4 AS INTEGER), 1)) AS component, count(*) AS n FROM d JOIN p ON pair = concat(ref, '>', alt) WHERE np = pos + 1 GROUP BY 1, 2")
def _(v):
    d = V.find_doublets(v).withColumns({"upstream": F.expr("substr('ACGT', cast(1 + pos % 4 as int), 1)"), "downstream": F.expr("substr('ACGT', cast(1 + (pos * 3) % 4 as int), 1)")})
    return K.count_components(V.label_dbs(d), "dbs1248")


_TRIM = """, c AS (SELECT *, CASE WHEN substr(ref, 1, 1) <> substr(alt, 1, 1) THEN 0 WHEN least(length(ref), length(alt)) >= 2 AND substr(ref, 1, 2) = substr(alt, 1, 2) THEN 2 ELSE 1 END AS c FROM indels),
t AS (SELECT sample, t1, t2, t3, t4, upstream, downstream, pos + c AS pos, CASE WHEN substr(ref, c + 1) = '' THEN '-' ELSE substr(ref, c + 1) END AS ref, CASE WHEN substr(alt, c + 1) = '' THEN '-' ELSE substr(alt, c + 1) END AS alt FROM c)"""


@query("indel_left_trim", "indels", sql=_TRIM + " SELECT t1, t2, t3, t4, pos, ref, alt, pos + length(ref) - 1 AS end_pos FROM t")
def _(v):
    return V.trim_indels(v).select("t1", "t2", "t3", "t4", "pos", "ref", "alt", "end_pos")


_ID = _TRIM + """, u AS (SELECT *, CASE WHEN ref = '-' THEN alt ELSE ref END AS u, CASE WHEN ref = '-' THEN 'Ins' ELSE 'Del' END AS kind FROM t),
s AS (SELECT *, CAST(len(regexp_extract(downstream, concat('^((?:', u, ')+)'), 1)) // len(u) + len(regexp_extract(reverse(upstream), concat('^((?:', reverse(u), ')+)'), 1)) // len(u) AS INTEGER) AS reps,
  CASE WHEN len(u) < 2 THEN 0 ELSE greatest(coalesce(list_max(list_filter(range(1, len(u)), lambda k: starts_with(downstream, substr(u, 1, k)))), 0), coalesce(list_max(list_filter(range(1, len(u)), lambda k: ends_with(upstream, substr(u, len(u) - k + 1)))), 0)) END AS homo FROM u)"""


@query("indel_repeat_count", "indels", sql=_ID + " SELECT least(reps, 5) AS n_repeat, count(*) AS n FROM s GROUP BY 1")
def _(v):
    return V.label_indels(v).groupBy("n_repeat").agg(F.count("*").alias("n"))


@query("indel_homology", "indels", sql=_ID + " SELECT CAST(least(homo, 5) AS INTEGER) AS n_homology, count(*) AS n FROM s GROUP BY 1")
def _(v):
    return V.label_indels(v).groupBy(F.col("n_homology").cast("int").alias("n_homology")).agg(F.count("*").alias("n"))


_ID83 = _ID + """, b AS (SELECT *, least(len(u), 5) AS l, CASE WHEN len(u) = 1 THEN translate(u, 'AG', 'TC') WHEN kind = 'Del' AND reps = 0 AND homo > 0 THEN 'M' ELSE 'R' END AS base FROM s),
m AS (SELECT *, concat_ws(':', l, kind, base, CASE WHEN base = 'M' THEN least(homo, 5) ELSE least(reps, 5) END) AS id FROM b)"""


@query("id83_catalog", "indels", sql=_ID83 + " SELECT sample, id AS component, count(*) AS n FROM m WHERE ref = '-' OR alt = '-' GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_indels(v), "id83")


@query("id28_catalog", "indels", sql=_ID83 + " SELECT sample, CASE WHEN ref <> '-' AND alt <> '-' THEN 'complex' WHEN l = 1 THEN id WHEN base = 'M' THEN 'MH' WHEN kind = 'Del' THEN 'long_Del' ELSE 'long_Ins' END AS component, count(*) AS n FROM m GROUP BY 1, 2")
def _(v):
    return K.count_components(V.label_indels(v), "id28")


_STRAND = ", h AS (SELECT v.t1, v.t2, v.t3, v.t4, min(strand) AS a, max(strand) AS b FROM variants v JOIN transcripts t ON t.chrom = v.chrom AND pos BETWEEN t.start_pos AND t.end_pos GROUP BY 1, 2, 3, 4), l AS (SELECT sample, concat(CASE WHEN a IS NULL THEN 'N' WHEN a <> b THEN 'B' WHEN (ref IN ('A', 'G')) <> (a = '-') THEN 'T' ELSE 'U' END, ':', " + _FOLD + ") AS c FROM variants LEFT JOIN h USING (t1, t2, t3, t4))"


@query("strand_labels", "variants", "transcripts", sql=_STRAND + " SELECT sample, c AS component, count(*) AS n FROM l GROUP BY 1, 2")
def _(v, t):
    d = V.strand_label(V.label_sbs(v), t)
    return K.count_components(d.withColumn("c", F.concat_ws(":", "strand_label", "sbs6")), "c")


def _times(m: str) -> str:
    return f"(len(string_split(context, '{m}')) - 1)"


@query("apobec_enrichment", "variants", sql=_SBS + f""", c AS (SELECT sample, count(*) AS n_mutations, count(*) FILTER (sub IN ('C>T', 'C>G')) AS n_c_to_gt, count(*) FILTER (sub IN ('C>T', 'C>G') AND substr(ctx, 2, 1) = 'T' AND substr(ctx, 4, 1) IN ('A', 'T')) AS n_tcw,
CAST(sum(CASE WHEN sub IN ('C>T', 'C>G') THEN {_times("TCA")} + {_times("TCT")} ELSE 0 END) AS BIGINT) AS bg_tcw, CAST(sum(CASE WHEN sub IN ('C>T', 'C>G') THEN {_times("TGA")} + {_times("AGA")} ELSE 0 END) AS BIGINT) AS bg_wga,
CAST(sum(CASE WHEN sub IN ('C>T', 'C>G') THEN {_times("C")} + {_times("G")} ELSE 0 END) AS BIGINT) AS cg FROM f GROUP BY 1)
SELECT sample, n_mutations, n_c_to_gt, n_tcw, bg_tcw, bg_wga, round((n_tcw / n_c_to_gt) / ((bg_tcw + bg_wga) / cg), 6) AS enrichment FROM c""")
def _(v):
    return V.apobec_counts(v).select("sample", "n_mutations", "n_c_to_gt", "n_tcw", "bg_tcw", "bg_wga", *r6("enrichment"))


# Rearrangements

_SVC = "CASE WHEN chr1 <> chr2 THEN 'translocation' WHEN strand1 <> strand2 THEN 'inversion' WHEN strand1 = '-' THEN 'tandem-duplication' ELSE 'deletion' END"
_SVS = "CASE WHEN end2 - start1 < 1000 THEN '<1Kb' WHEN end2 - start1 < 10000 THEN '1-10Kb' WHEN end2 - start1 < 100000 THEN '10-100Kb' WHEN end2 - start1 < 1000000 THEN '100Kb-1Mb' WHEN end2 - start1 <= 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END"


@query("sv_class", "sv", sql=f"SELECT sample, {_SVC} AS svclass, count(*) AS n FROM sv GROUP BY 1, 2")
def _(d):
    return R.clean(d).groupBy("sample", "svclass").agg(F.count("*").alias("n"))


@query("sv_size_bins", "sv", sql=f"SELECT sample, CASE WHEN chr1 = chr2 THEN {_SVS} END AS sv_size, count(*) AS n FROM sv GROUP BY 1, 2")
def _(d):
    return R.label_size(R.clean(d)).groupBy("sample", "sv_size").agg(F.count("*").alias("n"))


_SVD = ", b AS (SELECT sample, substr(chr1, 4) AS chrom, start1 AS pos FROM sv UNION ALL SELECT sample, substr(chr2, 4), start2 FROM sv), e AS (SELECT *, pos - lag(pos) OVER (PARTITION BY sample, chrom ORDER BY pos) AS dist FROM b)"


@query("sv_distances", "sv", sql=_SVD + " SELECT sample, chrom, count(dist) AS n, CAST(sum(dist) AS BIGINT) AS total, max(dist) AS most FROM e GROUP BY 1, 2")
def _(d):
    return R.distances(R.clean(d)).groupBy("sample", "chrom").agg(F.count("dist").alias("n"), F.sum("dist").alias("total"), F.max("dist").alias("most"))


def _rs(d: DataFrame) -> DataFrame:
    # regions of low distance by the plain rule, so that SQL can follow: single distances under a tenth of the sample's mean
    return R.rs_catalogue(R.label_size(R.clean(d)), R.by_steps)


_RS = _SVD + f""", m AS (SELECT sample, avg(dist) AS m FROM e GROUP BY 1), g AS (SELECT e.sample, chrom, pos - dist AS a, pos AS z FROM e JOIN m USING (sample) WHERE 10 * dist < m),
l AS (SELECT sample, {_SVC} AS k, {_SVS} AS s, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.sample = sv.sample AND ((g.chrom = substr(chr1, 4) AND start1 BETWEEN a AND z) OR (g.chrom = substr(chr2, 4) AND start2 BETWEEN a AND z))) THEN 'clustered' ELSE 'non-clustered' END AS c FROM sv),
n AS (SELECT sample, CASE WHEN k = 'translocation' THEN concat(c, ':trans') ELSE concat_ws(':', c, CASE k WHEN 'deletion' THEN 'del' WHEN 'inversion' THEN 'inv' ELSE 'tds' END, s) END AS component FROM l)"""


@query("rs38_plain_rule", "sv", sql=_RS + " SELECT sample, component, count(*) AS n FROM n GROUP BY 1, 2")
def _(d):
    return _rs(d)


@query("rs32_plain_rule", "sv", sql=_RS + " SELECT sample, component, count(*) AS n FROM n WHERE component NOT LIKE '%<1Kb%' GROUP BY 1, 2")
def _(d):
    return R.without_smallest(_rs(d))


@query("rs38_catalog", "sv")  # no SQL: the piecewise constant segmentation
def _(d):
    return R.rs_catalogue(R.label_size(R.clean(d)))


@query("rs32_catalog", "sv")
def _(d):
    return R.without_smallest(R.rs_catalogue(R.label_size(R.clean(d))))


# Catalogue algebra

_COMPONENTS = [f"{p}:{s}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for s in "FOP"]


@query("catalog_long", "catalog", sql="SELECT sample, component, n FROM catalog")
def _(c):
    return K.long(K.wide(c, _COMPONENTS))


@query("catalog_wide", "catalog", sql="SELECT sample, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (component = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _COMPONENTS) + " FROM catalog GROUP BY 1")
def _(c):
    return K.wide(c, _COMPONENTS)


@query("catalog_filled", "catalog", sql=", v AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in [*_COMPONENTS, "none"]) + "]) AS component), s AS (SELECT DISTINCT sample FROM catalog) SELECT s.sample, v.component, coalesce(c.n, 0) AS n FROM s CROSS JOIN v LEFT JOIN catalog c ON c.sample = s.sample AND c.component = v.component")
def _(c):
    return K.filled(c, [*_COMPONENTS, "none"])


@query("normalize_by_sample", "catalog", sql="SELECT sample, component, round(n / sum(n) OVER (PARTITION BY sample), 6) AS weight FROM catalog")
def _(c):
    return C.normalize(c, "n", ["sample"]).select("sample", "component", *r6("weight"))


@query("normalize_by_component", "catalog", sql="SELECT sample, component, round(n / sum(n) OVER (PARTITION BY component), 6) AS weight FROM catalog")
def _(c):
    return C.normalize(c, "n", ["component"]).select("sample", "component", *r6("weight"))


@query("normalize_by_feature", "catalog", sql="SELECT sample, component, round(n / sum(n) OVER (PARTITION BY sample, split_part(component, ':', 1)), 6) AS weight FROM catalog")
def _(c):
    return C.normalize(c.withColumn("feature", F.split_part("component", F.lit(":"), F.lit(1))), "n", ["sample", "feature"]).select("sample", "component", *r6("weight"))


_SKEWED = ", k AS (SELECT CASE WHEN CAST(sample AS BIGINT) % 9 = 0 THEN n * 40 ELSE n END AS n, sample, component FROM catalog)"


#: Rounds of halving in the SQL; a round that halves nothing changes nothing.
_ROUNDS = 12
_HYPER = _SKEWED + ", t0 AS (SELECT sample, CAST(sum(n) AS DOUBLE) AS total, 0 AS k FROM k GROUP BY 1)" + "".join(
    f", x{i} AS (SELECT quantile_cont(x, 0.5) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS l FROM (SELECT total / 2.0 ** k AS x, unnest(range(CAST(2 ** k AS BIGINT))) FROM t{i})), t{i + 1} AS (SELECT sample, total, k + CASE WHEN total / 2.0 ** k > l THEN 1 ELSE 0 END AS k FROM t{i}, x{i})"
    for i in range(_ROUNDS)
)


@query("hyper_split", "catalog", sql=_HYPER + f", p AS (SELECT sample, k, unnest(range(1, CAST(2 ** k AS BIGINT) + 1)) AS part FROM t{_ROUNDS}) SELECT CASE WHEN p.k > 0 THEN concat(p.sample, '_[hyper]_', part) ELSE p.sample END AS sample, component, round(n / 2.0 ** p.k, 6) AS n FROM k JOIN p ON p.sample = k.sample")
def _(c):
    return C.hyper_split(c.withColumn("n", F.when(F.col("sample").cast("long") % 9 == 0, F.col("n") * 40).otherwise(F.col("n")))).select("sample", "component", *r6("n"))


@query("hyper_collapse", "catalog", sql=_SKEWED + " SELECT sample, component, round(CAST(n AS DOUBLE), 6) AS n FROM k")
def _(c):
    skewed = c.withColumn("n", F.when(F.col("sample").cast("long") % 9 == 0, F.col("n") * 40).otherwise(F.col("n")))
    return C.hyper_collapse(C.hyper_split(skewed)).select("sample", "component", *r6("n"))


_REL = ", r AS (SELECT sample, sig, CASE WHEN amount / sum(amount) OVER (PARTITION BY sample) <= 0.1 THEN 0 ELSE amount / sum(amount) OVER (PARTITION BY sample) END AS rel FROM exposure)"


@query("relative_exposure", "exposure", sql=_REL + " SELECT sample, sig, round(rel, 6) AS rel FROM r")
def _(e):
    return C.relative_exposure(e, 0.1).select("sample", "sig", *r6("rel"))


@query("shannon_diversity", "exposure", sql=_REL + " SELECT sample, round(sum(CASE WHEN rel > 0.001 THEN -rel * ln(rel) ELSE 0 END), 6) AS diversity FROM r GROUP BY 1")
def _(e):
    return C.shannon_diversity(C.relative_exposure(e, 0.1)).select("sample", *r6("diversity"))


@query("opportunity_convert", "signature", sql=", o AS (SELECT component, sum(n) AS a, sum(n * n) AS b FROM signature GROUP BY 1), w AS (SELECT sig, component, n * b / a AS w FROM signature JOIN o USING (component)) SELECT sig, component, round(w / sum(w) OVER (PARTITION BY sig), 6) AS weight FROM w")
def _(s):
    opp = s.groupBy("component").agg(F.sum("n").alias("a"), F.sum(F.col("n") * F.col("n")).alias("b"))
    return C.convert_opportunities(s.withColumn("weight", F.col("n").cast("double")), opp.select("component", F.col("a").alias("n")), opp.select("component", F.col("b").alias("n"))).select("sig", "component", *r6("weight"))


@query("signature_order", "exposure", sql=", t AS (SELECT sig, CAST(sum(amount) AS BIGINT) AS total FROM exposure GROUP BY 1) SELECT sig, total, CAST(row_number() OVER (ORDER BY total DESC, sig) AS INTEGER) AS place FROM t")
def _(e):
    return C.signature_order(e)


@query("simulate_signature", "catalog", sql=", p AS (SELECT sample, component, n / sum(n) OVER (PARTITION BY sample) AS p FROM catalog) SELECT component, round(sum(p) / (SELECT count(DISTINCT sample) FROM catalog), 6) AS weight FROM p GROUP BY 1")
def _(c):
    return C.simulate_signature(c).select("component", *r6("weight"))


# Similarity

_SIG = ", w AS (SELECT sig, component, n / sum(n) OVER (PARTITION BY sig) AS w FROM signature)"
_COS = _SIG + ", m AS (SELECT sig, sqrt(sum(w * w)) AS m FROM w GROUP BY 1), c AS (SELECT x.sig AS a, y.sig AS b, coalesce((SELECT sum(p.w * q.w) FROM w p JOIN w q USING (component) WHERE p.sig = x.sig AND q.sig = y.sig), 0) / (x.m * y.m) AS cosine FROM m x, m y WHERE x.sig < 'Brand#2' AND y.sig >= 'Brand#2')"


def _sets(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = C.normalize(s, "n", ["sig"])
    return w.where("sig < 'Brand#2'"), w.where("sig >= 'Brand#2'")


@query("cosine_pairs", "signature", sql=_COS + " SELECT a, b, round(cosine, 6) AS cosine FROM c")
def _(s):
    return C.cosine_pairs(*_sets(s), "sig", "sig").select("a", "b", *r6("cosine"))


@query("signature_similarity", "catalog", "signature", sql=_SIG + ", m AS (SELECT sig, sqrt(sum(w * w)) AS m FROM w GROUP BY 1), d AS (SELECT p.sig AS a, q.sig AS b, sum(p.w * q.w) AS d FROM w p JOIN w q USING (component) GROUP BY 1, 2) SELECT x.sig AS a, y.sig AS b, round(coalesce(d, 0) / (x.m * y.m), 6) AS cosine FROM m x CROSS JOIN m y LEFT JOIN d ON d.a = x.sig AND d.b = y.sig")
def _(c, s):
    w = C.normalize(s, "n", ["sig"])
    return C.cosine_pairs(w, w, "sig", "sig").select("a", "b", *r6("cosine"))


@query("best_match", "signature", sql=_COS + ", r AS (SELECT a, b, round(cosine, 3) AS cosine, rank() OVER (PARTITION BY a ORDER BY round(cosine, 3) DESC) AS k FROM c) SELECT a, b, cosine FROM r WHERE k = 1")
def _(s):
    return C.best_match(C.cosine_pairs(*_sets(s), "sig", "sig"))


@query("rss_matrix", "signature", sql=_SIG + ", k AS (SELECT DISTINCT component FROM w), g AS (SELECT DISTINCT sig FROM w), d AS (SELECT sig, component, coalesce(w, 0) AS w FROM g CROSS JOIN k LEFT JOIN w USING (sig, component)) SELECT x.sig AS a, y.sig AS b, round(sum((x.w - y.w) * (x.w - y.w)), 6) AS rss FROM d x JOIN d y USING (component) WHERE x.sig < 'Brand#2' AND y.sig >= 'Brand#2' GROUP BY 1, 2")
def _(s):
    return C.rss_pairs(*_sets(s), "sig", "sig").select("a", "b", F.abs(F.round("rss", 6)).alias("rss"))


@query("reconstruction_similarity", "catalog", sql=""", w AS (SELECT component, split_part(component, ':', 2) AS sig, CAST(sum(n) AS DOUBLE) AS w FROM catalog GROUP BY 1, 2), s AS (SELECT sig, component, w / sum(w) OVER (PARTITION BY sig) AS w FROM w),
e AS (SELECT sample, split_part(component, ':', 2) AS sig, sum(n) AS amount FROM catalog GROUP BY 1, 2), y AS (SELECT sample, component, sum(amount * w) AS y FROM e JOIN s USING (sig) GROUP BY 1, 2), d AS (SELECT coalesce(n, 0) AS x, coalesce(y, 0) AS y, sample FROM catalog FULL JOIN y USING (sample, component))
SELECT sample, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(sum((x - y) * (x - y)) / sum(x * x), 6) AS unexplained FROM d GROUP BY 1""")
def _(c):
    half = F.split_part("component", F.lit(":"), F.lit(2))
    sig = C.normalize(c.groupBy(half.alias("sig"), "component").agg(F.sum("n").alias("n")), "n", ["sig"])
    expo = c.groupBy("sample", half.alias("sig")).agg(F.sum("n").alias("amount"))
    return C.reconstruction_similarity(c, sig, expo).select("sample", *r6("cosine"), F.abs(F.round("unexplained", 6)).alias("unexplained"))


# Statistics

@query("bh_adjust", "traits", sql=", p AS (SELECT id, grp, (1 + extra * 7 % 97) / 100 AS p FROM traits), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + count(*) OVER (PARTITION BY grp, p) - 1 AS k, count(*) OVER (PARTITION BY grp) AS m FROM p) SELECT id, round(least(1, min(p * m / k) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM r")
def _(t):
    d = t.select("id", "grp", ((1 + F.col("extra") * 7 % 97) / 100).alias("p"))
    return T.bh_adjust(d, "p", ["grp"]).select("id", *r6("fdr"))


_W = ", g AS (SELECT region, count(*) FILTER (flag) AS n1, avg(score) FILTER (flag) AS m1, var_samp(score) FILTER (flag) AS v1, count(*) FILTER (NOT flag) AS n2, avg(score) FILTER (NOT flag) AS m2, var_samp(score) FILTER (NOT flag) AS v2 FROM traits GROUP BY 1)"


@query("welch_t_stat", "traits", sql=_W + " SELECT region, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM g")
def _(t):
    return T.welch_columns(T.two_groups(t, F.col("flag"), "score", ["region"])).select("region", "n1", "n2", *r6("t"), F.round("df", 4).alias("df"))


@query("ranksum_stat", "traits", sql=", r AS (SELECT region, flag, rank() OVER (PARTITION BY region ORDER BY extra) + (count(*) OVER (PARTITION BY region, extra) - 1) / 2 AS r FROM traits) SELECT region, count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2, sum(r) FILTER (flag) - count(*) FILTER (flag) * (count(*) FILTER (flag) + 1) / 2 AS w FROM r GROUP BY 1")
def _(t):
    return T.rank_sum(t, F.col("flag"), "extra", ["region"]).select("region", "n1", "n2", "w")


@query("anova_f", "traits", sql=", g AS (SELECT grp, count(*) AS c, avg(score) AS m, sum(score * score) - count(*) * avg(score) ** 2 AS w FROM traits GROUP BY 1), a AS (SELECT count(*) AS k, CAST(sum(c) AS BIGINT) AS n, sum(w) AS ssw, sum(c * m * m) - sum(c * m) ** 2 / sum(c) AS ssb FROM g) SELECT k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f FROM a")
def _(t):
    return T.anova(t, "grp", "score").select("k", "n", F.round("f", 5).alias("f"))


@query("pearson_pairs", "traits", sql="SELECT 'score' AS a, 'extra' AS b, count(*) AS n, round(corr(score, extra), 6) AS r FROM traits UNION ALL SELECT 'score', 'id', count(*), round(corr(score, id), 6) FROM traits")
def _(t):
    return T.correlations(t, ["score"], ["extra", "id"]).select("a", "b", "n", *r6("r"))


@query("spearman_pairs", "traits", sql=", r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY extra) + (count(*) OVER (PARTITION BY extra) - 1) / 2 AS y FROM traits) SELECT 'score' AS a, 'extra' AS b, count(*) AS n, round(corr(x, y), 6) AS r FROM r")
def _(t):
    return T.correlations(t, ["score"], ["extra"], rank=True).select("a", "b", "n", *r6("r"))


@query("kendall_tau", "traits")  # no SQL: a join of all pairs of rows would be quadratic
def _(t):
    return T.kendall(t, "score", "extra").select(*r6("tau"))


_GE = """, l AS (SELECT grp, 'score' AS v, CAST(score AS DOUBLE) AS x FROM traits UNION ALL SELECT grp, 'flag', CASE WHEN flag THEN 1 ELSE 0 END FROM traits),
p AS (SELECT a.grp, a.v, count(*) FILTER (b.grp = a.grp) AS n1, count(*) FILTER (b.grp <> a.grp) AS n2, avg(b.x) FILTER (b.grp = a.grp) AS m1, avg(b.x) FILTER (b.grp <> a.grp) AS m2, sum(b.x) FILTER (b.grp = a.grp) AS s1, sum(b.x) FILTER (b.grp <> a.grp) AS s2, var_samp(b.x) FILTER (b.grp = a.grp) AS v1, var_samp(b.x) FILTER (b.grp <> a.grp) AS v2 FROM (SELECT DISTINCT grp, v FROM l) a JOIN l b USING (v) GROUP BY 1, 2)"""


@query("group_enrichment", "traits", sql=_GE + " SELECT v AS enrich_var, grp, n1, n2, round(m1, 6) AS measure1, round(m2, 6) AS measure2, round(CASE v WHEN 'score' THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) ELSE s1 * (n2 - s2) / ((n1 - s1) * s2) END, 5) AS statistic FROM p")
def _(t):
    return T.group_enrichment(t, ["grp"], ["score"], ["flag"]).select("enrich_var", "grp", "n1", "n2", *r6("measure1", "measure2"), F.round("statistic", 5).alias("statistic"))


@query("group_enrichment_subset", "traits", sql=", p AS (SELECT a.region, a.grp, count(*) FILTER (b.grp = a.grp) AS n1, count(*) FILTER (b.grp <> a.grp) AS n2, avg(b.score) FILTER (b.grp = a.grp) AS m1, avg(b.score) FILTER (b.grp <> a.grp) AS m2 FROM (SELECT DISTINCT region, grp FROM traits) a JOIN traits b USING (region) GROUP BY 1, 2) SELECT region, grp, n1, n2, round(m1, 6) AS measure1, round(m2, 6) AS measure2 FROM p WHERE n2 > 0")
def _(t):
    return T.group_enrichment(t, ["grp"], ["score"], by=["region"]).select("region", "grp", "n1", "n2", *r6("measure1", "measure2"))


@query("group_comparison", "traits", sql=", c AS (SELECT grp AS a, region AS b, count(*) AS n FROM traits GROUP BY 1, 2) SELECT a, b, n, CAST(sum(n) OVER (PARTITION BY a) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY b) AS BIGINT) AS col_total FROM c")
def _(t):
    return T.contingency(t, "grp", "region")


@query("tukey_pairs", "traits", sql=", g AS (SELECT grp, avg(score) AS m FROM traits GROUP BY 1) SELECT x.grp AS g1, y.grp AS g2, round(y.m - x.m, 6) AS diff FROM g x JOIN g y ON x.grp < y.grp")
def _(t):
    return T.tukey(t, "grp", "score").select("g1", "g2", *r6("diff"))


@query("signature_feature_association", "traits", sql="SELECT 'score' AS signature, 'extra' AS feature, 'co' AS type, count(*) AS count, round(corr(score, extra), 6) AS measure FROM traits UNION ALL SELECT 'score', 'flag', 'ca', count(*), round(avg(score) FILTER (flag) - avg(score) FILTER (NOT flag), 6) FROM traits")
def _(t):
    return T.feature_association(t, ["score"], ["extra"], ["flag"]).select("signature", "feature", "type", "count", *r6("measure"))


@query("pairwise_fisher", "traits", sql=", g AS (SELECT grp, count(*) FILTER (flag) AS t, count(*) FILTER (NOT flag) AS f FROM traits GROUP BY 1) SELECT x.grp AS g1, y.grp AS g2, x.t AS t1, x.f AS f1, y.t AS t2, y.f AS f2 FROM g x JOIN g y ON x.grp < y.grp")
def _(t):
    return T.pairwise_fisher(t, "flag", "grp").select("g1", "g2", "t1", "f1", "t2", "f2")


_LF = "lgamma({0} + 1.0)"


@query("fisher_2x2", "traits", sql=f""", g AS (SELECT region, count(*) FILTER (flag AND extra % 2 = 0) AS a, count(*) FILTER (flag AND extra % 2 = 1) AS b, count(*) FILTER (NOT flag AND extra % 2 = 0) AS c, count(*) FILTER (NOT flag AND extra % 2 = 1) AS d FROM traits GROUP BY 1),
x AS (SELECT region, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM g), p AS (SELECT *, exp({_LF.format("(a + b)")} + {_LF.format("(c + d)")} + {_LF.format("(a + c)")} + {_LF.format("(b + d)")} - {_LF.format("(a + b + c + d)")} - {_LF.format("k")} - {_LF.format("(a + b - k)")} - {_LF.format("(a + c - k)")} - {_LF.format("(d - a + k)")}) AS p FROM x),
o AS (SELECT region, p AS p0 FROM p WHERE k = a) SELECT region, round(least(1, sum(p) FILTER (p <= p0 * (1 + 1e-7))), 6) AS p_value FROM p JOIN o USING (region) GROUP BY 1""")
def _(t):
    n = lambda f, e: F.sum(F.when((F.col("flag") == f) & (F.col("extra") % 2 == e), 1).otherwise(0)).cast("double")
    g = t.groupBy("region").agg(n(True, 0).alias("a"), n(True, 1).alias("b"), n(False, 0).alias("c"), n(False, 1).alias("d"))
    return g.withColumn("p_value", T.fisher_p("a", "b", "c", "d")).select("region", *r6("p_value"))


@query("strand_bias_enrichment", "variants", "transcripts", sql=_STRAND + ", k AS (SELECT sample, substr(c, 3) AS component, count(*) FILTER (c LIKE 'T%') AS t, count(*) FILTER (c LIKE 'U%') AS u FROM l WHERE c LIKE 'T%' OR c LIKE 'U%' GROUP BY 1, 2) SELECT sample, component, t, u, CAST(sum(t) OVER (PARTITION BY sample) AS BIGINT) AS t_total, CAST(sum(u) OVER (PARTITION BY sample) AS BIGINT) AS u_total, round(CASE WHEN u <> 0 THEN t / u END, 6) AS enrichment FROM k")
def _(v, t):
    d = V.strand_label(V.label_sbs(v), t).where("strand_label IN ('T', 'U')")
    counts = d.groupBy("sample", F.col("sbs6").alias("component"), F.col("strand_label").alias("strand")).agg(F.count("*").alias("n"))
    return T.strand_bias(counts).select("sample", "component", "t", "u", "t_total", "u_total", *r6("enrichment"))


# Grouping

@query("dominant_signature", "exposure", sql="SELECT sample, sig FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY amount DESC) AS r FROM exposure) WHERE r = 1")
def _(e):
    return C.dominant_signature(e)


@query("group_signature_map", "exposure", sql=", d AS (SELECT sample, sig FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY amount DESC) AS r FROM exposure) WHERE r = 1), g AS (SELECT CAST(CAST(sample AS BIGINT) % 4 AS STRING) AS grp, sig, count(*) AS n FROM d GROUP BY 1, 2) SELECT grp, sig, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, sig) AS r FROM g) WHERE r = 1")
def _(e):
    groups = e.select("sample", (F.col("sample").cast("long") % 4).cast("string").alias("grp")).distinct()
    return C.group_signature(groups, e)


@query("kmeans_groups", "exposure")
def _(e):
    return X.kmeans_groups(C.relative_exposure(e), 3)


@query("equal_size_clusters", "exposure")
def _(e):
    return P.equal_size_clusters(e, 5)


# Bootstrap tables

@query("bootstrap_summary", "bootstrap", sql="SELECT sample, sig, round(avg(exposure), 6) AS mean, round(median(exposure), 6) AS median, min(exposure) AS least, max(exposure) AS most FROM bootstrap GROUP BY 1, 2")
def _(b):
    return C.bootstrap_summary(b).select("sample", "sig", *r6("mean", "median"), "least", "most")


_STAB = ", o AS (SELECT sample, sig, CAST(max(exposure) AS DOUBLE) AS o FROM bootstrap GROUP BY 1, 2), s AS (SELECT sample, sig, sqrt(avg((exposure - o) ** 2)) AS rmse, avg(exposure) AS m, avg(abs(exposure - o)) AS mae, any_value(o) AS o FROM bootstrap JOIN o USING (sample, sig) GROUP BY 1, 2)"


def _stability(b: DataFrame, column: str) -> DataFrame:
    best = b.groupBy("sample", "sig").agg(F.max("exposure").cast("double").alias("exposure"))
    return C.bootstrap_stability(b, best).select("sample", "sig", *r6(column))


for _name, _column, _expr in (("rmse", "rmse", "rmse"), ("cv", "cv", "rmse / m"), ("mae", "mae", "mae")):
    query(f"bootstrap_stability_{_name}", "bootstrap", sql=_STAB + f" SELECT sample, sig, round({_expr}, 6) AS {_column} FROM s")(lambda b, c=_column: _stability(b, c))
query("bootstrap_absdiff", "bootstrap", sql=_STAB + " SELECT sample, sig, round(abs(o - m), 6) AS abs_diff FROM s")(lambda b: _stability(b, "abs_diff"))


@query("run_statistics", "bootstrap", sql="SELECT sig, round(avg(exposure), 6) AS mean, round(stddev_samp(exposure), 6) AS sd, min(exposure) AS least, max(exposure) AS most FROM bootstrap GROUP BY 1")
def _(b):
    return C.run_statistics(b, ["sig"], "exposure").select("sig", *r6("mean", "sd"), "least", "most")


@query("rank_solutions", "catalog", sql=""", s AS (SELECT CAST(sample AS BIGINT) + 2 AS signature_number, count(*) / 15 + max(n) / 1000 AS silhouette, CAST(min(n) AS DOUBLE) AS l2_error FROM catalog GROUP BY 1), d AS (SELECT *, coalesce(lead(silhouette) OVER (ORDER BY signature_number) - silhouette, 0) AS d FROM s),
r AS (SELECT *, 100 - (rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 - 1) * 5 AS a, 100 - (rank() OVER (ORDER BY l2_error) + (count(*) OVER (PARTITION BY l2_error) - 1) / 2 - 1) * 5 AS b FROM d) SELECT signature_number, round(0.4 * a + 0.6 * b, 6) AS aggregate FROM r""")
def _(c):
    s = c.groupBy((F.col("sample").cast("long") + 2).alias("signature_number")).agg((F.count("*") / 15 + F.max("n") / 1000).alias("silhouette"), F.min("n").cast("double").alias("l2_error"))
    return C.rank_solutions(s).select("signature_number", *r6("aggregate"))


# Numeric kernels: no SQL; their invariants are tested.

def _signatures(catalog: DataFrame) -> DataFrame:
    half = F.split_part("component", F.lit(":"), F.lit(1))
    return catalog.groupBy(half.alias("sig"), "component").agg(F.sum("n").alias("weight"))


for _method in ("QP", "NNLS", "SA"):
    query(f"fit_{_method.lower()}", "catalog")(lambda c, m=_method: X.fit(c, _signatures(c), m))


@query("fit_bootstrap", "catalog")
def _(c):
    return X.fit_bootstrap(c, _signatures(c))


@query("bootstrap_p_values", "catalog")
def _(c):
    return X.bootstrap_p_values(X.fit_bootstrap(c, _signatures(c)))


@query("attribute_activity", "catalog")
def _(c):
    return X.attribute_activity(c, _signatures(c))


@query("simulate_catalogs", "catalog")
def _(c):
    return X.simulate_catalogs(c, 3)


@query("nmf_kl", "catalog")
def _(c):
    return X.extract(c, 3)[0]


@query("nmf_survey", "catalog")
def _(c):
    return X.estimate(c, [2, 3, 4])


@query("nmf_bayes", "catalog")
def _(c):
    return X.auto_extract(c)[1]


@query("nmf_best_practice", "catalog")
def _(c):
    return X.best_practice(c, [2, 3])


# Tables behind plots

@query("cn_profile_table", "segments", "chrom_sizes", sql=", o AS (SELECT chrom, coalesce(sum(size) OVER (ORDER BY CAST(substr(chrom, 4) AS INTEGER) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM chrom_sizes) SELECT sample, chromosome, CAST(start_pos + off AS BIGINT) AS x_start, CAST(end_pos + off AS BIGINT) AS x_end, CASE WHEN seg_val > 2 THEN 'Amp' WHEN seg_val < 2 THEN 'Del' ELSE 'Normal' END AS type FROM segments JOIN o ON chrom = chromosome")
def _(s, c):
    return S.profile_table(s, c).select("sample", "chromosome", "x_start", "x_end", "type")


@query("cn_group_profile_table", "segments", "bands", sql="SELECT g.grp, b.chrom, band, count(DISTINCT sample) FILTER (seg_val > 2) AS n_amp, count(DISTINCT sample) FILTER (seg_val < 2) AS n_del FROM (SELECT *, sample LIKE '%1' AS grp FROM segments) g JOIN bands b ON b.chrom = chromosome AND g.start_pos <= b.end_pos AND g.end_pos >= b.start_pos GROUP BY 1, 2, 3")
def _(s, b):
    return B.group_profile(s.withColumn("grp", F.col("sample").endswith("1")), b, "grp")


@query("cn_distribution", "segments", "chrom_sizes", sql=_ARM + " SELECT chromosome, arm, count(*) AS n, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS total_length FROM b GROUP BY 1, 2")
def _(s, c):
    return K.burden_by_arm(S.arm_annotation(s, c))


@query("exposure_long", "exposure", sql="SELECT sample, sig, amount, round(amount / sum(amount) OVER (PARTITION BY sample), 6) AS fraction, CAST(sum(amount) OVER (PARTITION BY sample) AS BIGINT) AS total FROM exposure")
def _(e):
    return B.exposure_table(e).select("sample", "sig", "amount", *r6("fraction"), "total")


@query("group_distribution_table", "traits", sql="SELECT grp, id, score, CAST(row_number() OVER (PARTITION BY grp ORDER BY score, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY grp) AS n FROM traits")
def _(t):
    return B.group_distribution(t, "grp", "score", "id")


@query("apobec_test", "variants")
def _(v):
    return V.apobec_test(V.apobec_counts(v)).select("sample", *r6("p_value", "fdr"))


@query("sbs_strand_catalog", "variants", "transcripts", sql=_STRAND + " SELECT sample, c AS component, count(*) AS n FROM l WHERE c LIKE 'T:%' OR c LIKE 'U:%' GROUP BY 1, 2")
def _(v, t):
    d = V.with_strand(V.strand_label(V.label_sbs(v), t), "sbs6", ("T", "U"))
    return K.count_components(d, "sbs6_strand")


@query("rescale", "traits", sql="SELECT id, round(1 + 9 * (score - (SELECT min(score) FROM traits)) / (SELECT max(score) - min(score) FROM traits), 6) AS scaled FROM traits")
def _(t):
    return C.rescale(t, "score", 1.0, 10.0).select("id", *r6("scaled"))


@query("nmf_iterative", "catalog")
def _(c):
    return X.extract_iterative(c, 2)[-1][0]


@query("nmf_consensus_groups", "catalog")
def _(c):
    return X.consensus_groups(c, 3)


# The entry to all catalogues, and strand catalogues

_LABEL = "CASE WHEN NOT pure THEN 'Q' WHEN a IS NULL THEN 'N' WHEN a <> b THEN 'B' WHEN rev <> (a = '-') THEN 'T' ELSE 'U' END"


@query("dbs78_strand_catalog", "variants", "transcripts", sql=_DBL + f""", p AS ({_D78}), e AS (SELECT row_number() OVER () AS id, sample, chrom, pos, cls, substr(cls, 1, 2) <> ref AS rev, substr(cls, 1, 2) IN ('TT', 'TC', 'CT', 'CC') AS pure FROM d JOIN p ON pair = concat(ref, '>', alt) WHERE np = pos + 1),
h AS (SELECT id, min(strand) AS a, max(strand) AS b FROM e JOIN transcripts t ON t.chrom = e.chrom AND t.start_pos <= pos + 1 AND t.end_pos >= pos GROUP BY 1) SELECT sample, concat({_LABEL}, ':', cls) AS component, count(*) AS n FROM e LEFT JOIN h USING (id) GROUP BY 1, 2""")
def _(v, t):
    return Y.tally(v, "variants", mode="DBS", add_trans_bias=True, transcripts=t, order=("t1", "t2", "t3", "t4"))["dbs78_strand"]


@query("id83_strand_catalog", "indels", "transcripts", sql=_ID83 + f""", e AS (SELECT row_number() OVER () AS id2, sample, concat('chr', CAST(1 + t2 % 22 AS STRING)) AS chrom, pos, pos + length(ref) - 1 AS stop, id, regexp_full_match(u, '[AG]+') AS rev, regexp_full_match(u, '[AG]+|[CT]+') AS pure FROM m WHERE ref = '-' OR alt = '-'),
h AS (SELECT id2, min(strand) AS a, max(strand) AS b FROM e JOIN transcripts t ON t.chrom = e.chrom AND t.start_pos <= stop AND t.end_pos >= pos GROUP BY 1) SELECT sample, concat({_LABEL}, ':', id) AS component, count(*) AS n FROM e LEFT JOIN h USING (id2) GROUP BY 1, 2""")
def _(v, t):
    d = v.withColumn("chrom", F.concat(F.lit("chr"), (1 + F.col("t2") % 22).cast("string")))
    return Y.tally(d, "variants", mode="ID", add_trans_bias=True, transcripts=t)["id83_strand"]


@query("sbs96_strand_catalog", "variants", "transcripts", sql=_SBS + """, h AS (SELECT v.t1, v.t2, v.t3, v.t4, min(strand) AS a, max(strand) AS b FROM variants v JOIN transcripts t ON t.chrom = v.chrom AND pos BETWEEN t.start_pos AND t.end_pos GROUP BY 1, 2, 3, 4)
SELECT sample, concat(CASE WHEN a IS NULL THEN 'N' WHEN a <> b THEN 'B' WHEN (ref IN ('A', 'G')) <> (a = '-') THEN 'T' ELSE 'U' END, ':', substr(ctx, 2, 1), '[', sub, ']', substr(ctx, 4, 1)) AS component, count(*) AS n FROM f LEFT JOIN h USING (t1, t2, t3, t4) GROUP BY 1, 2""")
def _(v, t):
    return Y.tally(v, "variants", mode="SBS", add_trans_bias=True, transcripts=t)["sbs96_strand"]


@query("genome_annotation", "chrom_sizes", sql=", g AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n}, {a}, {i + 1})" for i, (c, n, a) in enumerate(zip(G.chromosomes("hg19"), G.SIZES["hg19"], G.CENTROMERES_HG19, strict=True))) + ") AS g(chrom, size, cen_left, place)) SELECT chrom, size, cen_left, cen_left + 3000000 AS cen_right, place FROM g WHERE chrom IN (SELECT chrom FROM chrom_sizes)")
def _(c):
    return G.genome_annotation(c.sparkSession, "centro_loc", "hg19").join(c.select("chrom"), "chrom", "left_semi")


# Selections, histograms and mappings

@query("cn_profile_range", "segments", sql="SELECT sample, start_pos, end_pos, seg_val FROM segments WHERE chromosome = 'chr3' AND start_pos <= 60000000 AND end_pos >= 20000000")
def _(s):
    return B.selected_segments(s, region=("chr3", 20_000_000, 60_000_000)).select("sample", "start_pos", "end_pos", "seg_val")


@query("cn_sample_segments", "segments", sql="SELECT sample, chromosome, start_pos, end_pos, seg_val FROM segments WHERE sample IN ('s1', 's2') AND chromosome IN ('chr1', 'chr2')")
def _(s):
    return base(B.selected_segments(s, ["s1", "s2"], ["chr1", "chr2"]))


@query("gene_highlight", "bands", "transcripts", sql="SELECT b.chrom, b.start_pos, band, count(*) AS n, count(CASE WHEN t.end_pos <= b.end_pos AND t.start_pos >= b.start_pos THEN gene END) AS held FROM bands b LEFT JOIN transcripts t ON t.chrom = b.chrom GROUP BY 1, 2, 3")
def _(b, t):
    genes = t.select("chrom", F.col("start_pos").alias("gene_start"), F.col("end_pos").alias("gene_end"), "gene")
    return B.highlight(b, genes).groupBy("chrom", "start_pos", "band").agg(F.count("*").alias("n"), F.count("highlight").alias("held"))


@query("cn_burden_per_mb", "segments", "chrom_sizes", sql=_ARM + " SELECT chromosome, arm, count(*) AS n, round(count(*) * 1e6 / any_value(size), 6) AS per_mb FROM b GROUP BY 1, 2")
def _(s, c):
    return B.burden_per_mb(S.arm_annotation(s, c), c).select("chromosome", "arm", "n", *r6("per_mb"))


@query("cn_fraction_histogram", "segments", "chrom_sizes", sql=_ARM + " SELECT CAST(least(floor(fraction / 0.1), 9) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1")
def _(s, c):
    return B.fraction_histogram(S.arm_annotation(s, c))


_VAL = ", v AS (SELECT 'CN' AS feature, CAST(seg_val AS DOUBLE) AS value FROM segments UNION ALL SELECT 'MINOR', CAST(minor_cn AS DOUBLE) FROM segments)"


def _two_features(s: DataFrame) -> DataFrame:
    one = lambda f, c: s.select(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value"))
    return one("CN", "seg_val").unionByName(one("MINOR", "minor_cn"))


@query("cn_feature_histogram", "segments", sql=_VAL + ", m AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1) SELECT feature, CAST(least(floor((value - lo) * 5 / (hi - lo)), 4) AS INTEGER) AS bin, count(*) AS n FROM v JOIN m USING (feature) GROUP BY 1, 2")
def _(s):
    return B.feature_histogram(_two_features(s), 5)


@query("cn_feature_outliers", "segments", sql=_VAL + ", w AS (SELECT feature, CASE WHEN feature = 'CN' AND value = 7 THEN 700 ELSE value END AS value FROM v), q AS (SELECT feature, quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS b FROM w GROUP BY 1) SELECT feature, value, count(*) AS n FROM w JOIN q USING (feature) WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a) GROUP BY 1, 2")
def _(s):
    d = _two_features(s).withColumn("value", F.when((F.col("feature") == "CN") & (F.col("value") == 7), 700.0).otherwise(F.col("value")))
    return B.without_outliers(d).groupBy("feature", "value").agg(F.count("*").alias("n"))


@query("catalogue_profile", "catalog", sql="SELECT component, CAST(sum(n) AS BIGINT) AS n FROM catalog GROUP BY 1")
def _(c):
    return B.catalogue_profile(c)


@query("profile_split_sbs", "variants", sql=_SBS + " SELECT sub AS base, concat(substr(ctx, 2, 1), substr(sub, 1, 1), substr(ctx, 4, 1)) AS context, count(*) AS n FROM f GROUP BY 1, 2")
def _(v):
    d = B.profile_split(K.count_components(V.label_sbs(v), "sbs96"), "SBS")
    return d.groupBy("base", "context").agg(F.sum("n").alias("n"))


@query("profile_split_rs", "sv", sql=_RS + " SELECT concat_ws(':', split_part(component, ':', 1), split_part(component, ':', 2)) AS base, split_part(component, ':', 3) AS context, count(*) AS n FROM n GROUP BY 1, 2")
def _(d):
    return B.profile_split(_rs(d), "RS").groupBy("base", "context").agg(F.sum("n").alias("n"))


_PV = ", p AS (SELECT id, CAST(extra AS DOUBLE) / 97 AS fdr, CASE WHEN flag THEN 2.0 ELSE 0.5 END AS measure_observed FROM traits)"


@query("signed_log_p", "traits", sql=_PV + " SELECT id, round(CASE WHEN measure_observed >= 1 THEN 1 ELSE -1 END * abs(log10(CASE WHEN fdr = 0 THEN 2.2250738585072014e-308 ELSE fdr END)), 6) AS p_value_up, CASE WHEN fdr < 0.001 THEN '< 0.001' WHEN fdr < 0.01 THEN '< 0.01' WHEN fdr < 0.05 THEN '< 0.05' ELSE '>= 0.05' END AS p_bin FROM p")
def _(t):
    d = t.select("id", (F.col("extra").cast("double") / 97).alias("fdr"), F.when(F.col("flag"), 2.0).otherwise(0.5).alias("measure_observed"))
    return B.signed_log_p(d).select("id", *r6("p_value_up"), "p_bin")


@query("mapping_table", "traits", sql=", d AS (SELECT grp, region, flag, count(*) AS n FROM traits GROUP BY 1, 2, 3), a AS (SELECT concat_ws('|', grp, region, CAST(flag AS STRING)) AS alluvium, * FROM d) SELECT alluvium, n, 'grp' AS axis, grp AS stratum FROM a UNION ALL SELECT alluvium, n, 'region', region FROM a UNION ALL SELECT alluvium, n, 'flag', CAST(flag AS STRING) FROM a")
def _(t):
    return B.mapping_table(t, ["grp", "region", "flag"])


@query("adjusted_pairs", "traits", sql=", g AS (SELECT DISTINCT grp FROM traits), p AS (SELECT a.grp AS g1, b.grp AS g2 FROM g a JOIN g b ON a.grp < b.grp), r AS (SELECT g1, g2, grp, rank() OVER (PARTITION BY g1, g2 ORDER BY extra) + (count(*) OVER (PARTITION BY g1, g2, extra) - 1) / 2 AS r FROM p JOIN traits ON grp IN (g1, g2)), w AS (SELECT g1, g2, count(*) FILTER (grp = g1) AS n1, count(*) FILTER (grp = g2) AS n2, sum(r) FILTER (grp = g1) - count(*) FILTER (grp = g1) * (count(*) FILTER (grp = g1) + 1) / 2 AS statistic FROM r GROUP BY 1, 2) SELECT g1, g2, n1, n2, statistic, round((SELECT max(extra) FROM traits) * (1 + row_number() OVER (ORDER BY g1, g2) / 10), 6) AS y_position FROM w")
def _(t):
    return B.adjusted_pairs(t, "extra", "grp").select("g1", "g2", "n1", "n2", "statistic", *r6("y_position"))


@query("reordered_catalog", "catalog", sql=", v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate([*reversed(_COMPONENTS), "none"])) + ") AS v(place, component)), s AS (SELECT DISTINCT sample FROM catalog) SELECT s.sample, place, v.component, coalesce(n, 0) AS n FROM s CROSS JOIN v LEFT JOIN catalog c ON c.sample = s.sample AND c.component = v.component")
def _(c):
    return reordered(c, [*reversed(_COMPONENTS), "none"])


# Clusters of signatures, and which signatures may be in which sample

_CL = _SIG + ", c AS (SELECT sig, CAST(length(sig) % 2 AS INTEGER) AS cluster FROM (SELECT DISTINCT sig FROM signature)), n AS (SELECT cluster, count(*) AS k FROM c GROUP BY 1), mean AS (SELECT cluster, component, sum(w) / any_value(k) AS weight FROM w JOIN c USING (sig) JOIN n USING (cluster) GROUP BY 1, 2)"


def _clusters(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return C.normalize(s, "n", ["sig"]), s.select("sig").distinct().withColumn("cluster", F.length("sig") % 2)


@query("cluster_means", "signature", sql=_CL + " SELECT cluster, component, round(weight, 6) AS weight FROM mean")
def _(s):
    return B.cluster_means(*_clusters(s)).select("cluster", "component", *r6("weight"))


@query("cluster_similarity_to_mean", "signature", sql=_CL + ", m AS (SELECT cluster, sqrt(sum(weight * weight)) AS m FROM mean GROUP BY 1) SELECT sig, cluster, round(sum(w * coalesce(weight, 0)) / (sqrt(sum(w * w)) * any_value(m)), 6) AS cosine FROM w JOIN c USING (sig) LEFT JOIN mean USING (cluster, component) JOIN m USING (cluster) GROUP BY 1, 2")
def _(s):
    return B.similarity_to_mean(*_clusters(s)).select("sig", "cluster", *r6("cosine"))


@query("allowed_signatures", "exposure", sql=", r AS (SELECT sample, sig, CAST(sample AS BIGINT) % 3 AS cls, amount / sum(amount) OVER (PARTITION BY sample) > 0.2 AS own FROM exposure) SELECT sample, sig, CASE WHEN own OR count(*) FILTER (own) OVER (PARTITION BY cls, sig) > 5 THEN 1 ELSE 2 END AS flag FROM r")
def _(e):
    classes = e.select("sample").distinct().withColumn("cls", F.col("sample").cast("long") % 3)
    return B.allowed_signatures(C.relative_exposure(e), classes, 0.2)


@query("segment_size_order", "signature", sql=", c AS (SELECT sig, CAST(length(component) % 9 AS INTEGER) AS k, sum(n) AS w FROM signature GROUP BY 1, 2), b AS (SELECT sig, arg_max(k, (w, -k)) AS k FROM c GROUP BY 1) SELECT sig, CAST(row_number() OVER (ORDER BY k, sig) AS INTEGER) AS place FROM b")
def _(s):
    d = s.groupBy("sig", (F.length("component") % 9).alias("k")).agg(F.sum("n").alias("weight"))
    return B.segment_size_order(d.select("sig", F.concat(F.lit("SS[>"), F.col("k").cast("string"), F.lit("]")).alias("component"), "weight"))


@query("attribute_bootstrap", "catalog")
def _(c):
    sig = _signatures(c)
    return X.attribute(c, sig, X.fit(c, sig).select("sample", "sig", F.col("exposure").alias("amount")))


@query("attribute_stepwise", "catalog")
def _(c):
    sig = _signatures(c)
    classes = c.select("sample").distinct().withColumn("cls", F.col("sample").cast("long") % 2)
    return X.attribute(c, sig, X.fit(c, sig).select("sample", "sig", F.col("exposure").alias("amount")), classes, "stepwise")


@query("fit_suboptimal", "catalog")
def _(c):
    return X.fit_suboptimal(c, _signatures(c))


@query("fit_bootstrap_batch", "catalog")
def _(c):
    return X.fit_bootstrap_batch(c, _signatures(c), ("QP", "NNLS"))["p_val"]


@query("cluster_iterations", "signature")
def _(s):
    return X.cluster_iterations(s.select("sig", "component", F.col("n").alias("weight")), range(2, 7))


@query("nmf_survey_random", "catalog")
def _(c):
    return X.estimate(c, [2, 3], use_random=True)


@query("contingency_p", "traits")
def _(t):
    return t.sparkSession.createDataFrame([("grp", "region", B.contingency_p(t, "grp", "region"))], "a string, b string, p_value double")


@query("group_enrichment_ranks", "traits", sql=", l AS (SELECT grp, CAST(extra AS DOUBLE) AS x FROM traits), r AS (SELECT grp, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM l) SELECT grp, count(*) AS n1, round((avg(x) - (SELECT min(x) FROM l)) / ((SELECT sum(x) FROM l) - sum(x)) * ((SELECT count(*) FROM l) - count(*)), 6) AS measure_observed, sum(r) - count(*) * (count(*) + 1) / 2 AS statistic FROM r GROUP BY 1")
def _(t):
    return T.group_enrichment(t, ["grp"], ["extra"], method="wilcox").select("grp", "n1", *r6("measure_observed"), "statistic")


@query("signature_similarity_table", "signature", sql=_SIG.replace("FROM signature", "FROM signature WHERE component NOT LIKE '%TIN%'") + ", m AS (SELECT sig, sqrt(sum(w * w)) AS m FROM w GROUP BY 1), d AS (SELECT p.sig AS a, q.sig AS b, sum(p.w * q.w) AS d FROM w p JOIN w q USING (component) GROUP BY 1, 2), c AS (SELECT x.sig AS a, y.sig AS b, round(coalesce(d, 0) / (x.m * y.m), 3) AS cosine, abs(round(x.m * x.m + y.m * y.m - 2 * coalesce(d, 0), 6)) AS rss FROM m x CROSS JOIN m y LEFT JOIN d ON d.a = x.sig AND d.b = y.sig) SELECT a, b, cosine, rss, rank() OVER (PARTITION BY a ORDER BY cosine DESC) = 1 AS best FROM c")
def _(s):
    w = s.select("sig", "component", F.col("n").alias("weight"))
    return C.similarity(w, w, remove="TIN")


@query("band_matrix", "segments", "bands", sql=", v AS (SELECT chrom, band, sample, CAST(max(seg_val) AS BIGINT) AS value FROM bands b JOIN segments s ON chrom = chromosome AND s.start_pos <= b.end_pos AND s.end_pos >= b.start_pos WHERE sample IN ('s1', 's2', 's3') GROUP BY 1, 2, 3) SELECT chrom, band, " + ", ".join(f"coalesce(max(value) FILTER (sample = '{x}'), 2) AS {x}" for x in ("s1", "s2", "s3")) + " FROM v GROUP BY 1, 2")
def _(s, b):
    return S.band_matrix(s, b, ["s1", "s2", "s3"], F.max("seg_val"), 2)


@query("pam_groups", "exposure")
def _(e):
    return P.pam_groups(C.relative_exposure(e), 3)


@query("consensus_matrix", "catalog")
def _(c):
    return X.consensus_matrix(c, 3)


# Consensus extraction, intervals through the index, opportunities, moments of large values


@query("nmf_consensus_stats", "catalog")
def _(c):
    return N.consensus_extract(c, [2, 3]).rank


@query("cn_freq_by_fine_band", "segments", "bands", sql="""SELECT chrom, band, part, round(count(DISTINCT sample) FILTER (seg_val > 2) / (SELECT count(DISTINCT sample) FROM segments), 6) AS amp, round(count(DISTINCT sample) FILTER (seg_val < 2) / (SELECT count(DISTINCT sample) FROM segments), 6) AS del
FROM (SELECT chrom, band, part, start_pos + part * 1000000 AS a, start_pos + part * 1000000 + 999999 AS z FROM bands, (SELECT unnest(range(10)) AS part)) b LEFT JOIN segments s ON chrom = chromosome AND s.start_pos <= z AND s.end_pos >= a GROUP BY 1, 2, 3""")
def _(s, b):
    fine = I.chunks(b, "start_pos", "end_pos", 10).select("chrom", F.col("chunk_start").alias("start_pos"), F.col("chunk_end").alias("end_pos"), F.concat_ws("|", "band", "chunk").alias("band"))
    at = F.split("band", r"\|")
    return S.freq_by_band(s, fine).select("chrom", at[0].alias("band"), at[1].cast("long").alias("part"), *r6("amp", "del"))


_WORDS = """, w AS (SELECT substr(context, CAST(i AS BIGINT), 3) AS w FROM variants, (SELECT unnest([1, 2, 3]) AS i)),
f AS (SELECT CASE WHEN substr(w, 2, 1) IN ('C', 'T') THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END AS component, count(*) AS n FROM w GROUP BY 1)"""


def _contexts(v: DataFrame) -> DataFrame:
    """Each variant's context as a sequence of its own."""
    return v.select(F.concat_ws("|", "sample", "t1", "t2", "t3").alias("chrom"), F.lit(0).cast("long").alias("chunk_id"), F.col("context").alias("seq"))


@query("kmer_opportunities", "variants", sql=_WORDS + " SELECT component, n FROM f")
def _(v):
    return opportunities(_contexts(v), 3)


@query("component_opportunities", "variants", sql=_WORDS + """, c AS (SELECT DISTINCT CASE WHEN ref IN ('C', 'T') THEN substr(context, 2, 1) || '[' || ref || '>' || alt || ']' || substr(context, 4, 1) END AS component FROM variants WHERE ref IN ('C', 'T'))
SELECT c.component, n FROM c JOIN f ON f.component = substr(c.component, 1, 1) || substr(c.component, 3, 1) || substr(c.component, 7, 1)""")
def _(v):
    made = v.where(F.col("ref").isin("C", "T")).select(F.concat(F.substring("context", 2, 1), F.lit("["), "ref", F.lit(">"), "alt", F.lit("]"), F.substring("context", 4, 1)).alias("component"))
    return component_opportunities(opportunities(_contexts(v), 3), made)


@query("group_enrichment_shifted", "traits", sql=_GE + " SELECT grp, n1, n2, round(m1, 4) + 1000000000 AS measure1, round(m2, 4) + 1000000000 AS measure2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS statistic FROM p WHERE v = 'score'")
def _(t):
    moved = t.withColumn("score", F.col("score") + 1_000_000_000)  # a test of means does not see where the values lie
    return T.group_enrichment(moved, ["grp"], ["score"]).select("grp", "n1", "n2", *[F.round(c, 4).alias(c) for c in ("measure1", "measure2", "statistic")])


@query("randomised_totals", "catalog", sql=", k AS (SELECT count(DISTINCT component) AS k FROM catalog) SELECT sample, CAST(sum(n) AS BIGINT) AS total, CAST(any_value(k) - count(*) FILTER (n <> 0) AS BIGINT) AS zeros, CAST(max(n) AS BIGINT) AS most FROM catalog, k GROUP BY 1")
def _(c):
    return X.randomised(c).groupBy("sample").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") == 0, 1)).alias("zeros"), F.max("n").alias("most"))


@query("fit_totals", "catalog", sql=" SELECT sample, CAST(sum(n) AS BIGINT) AS total FROM catalog GROUP BY 1")
def _(c):
    return X.fit(c, _signatures(c)).groupBy("sample").agg(F.round(F.sum("exposure"), 2).cast("long").alias("total"))  # shares of a fit add to 1


@query("simulated_totals", "catalog", sql=" SELECT sample, CAST(rep AS INTEGER) AS rep, CAST(sum(n) AS BIGINT) AS total FROM catalog, (SELECT unnest([1, 2, 3]) AS rep) GROUP BY 1, 2")
def _(c):
    return X.simulate_catalogs(c, 3).groupBy("sample", "rep").agg(F.sum("n").alias("total"))


@query("correlations_adjusted", "traits", sql=", r AS (SELECT corr(score, extra) AS a, corr(score, id) AS b FROM traits) SELECT 'score' AS a, unnest(['extra', 'id']) AS b, round(unnest([r.a, r.b]), 6) AS r FROM r")
def _(t):
    return T.correlations(t.withColumn("one", F.lit(1)), ["score"], ["extra", "id", "one"], adjust="BH", drop_constant=True).select("a", "b", *r6("r"))
