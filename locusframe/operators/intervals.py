"""Joins of closed intervals.

An interval join needs an equality to be distributed. `overlap_join` takes the
chromosome and, when the right side is not known to be small, cuts the line
into bins: both sides are dealt by (chromosome, bin), so that one chromosome is
spread over many tasks and no pair of intervals meets twice.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.interval_index import indexed_join

#: Rows up to which a dimension may be broadcast; it is counted first.
SMALL = 200_000
#: Intervals a chromosome from which a broadcast side is probed through an index instead of one by one.
DENSE = 64


def _few(df: DataFrame, most: int) -> pa.Table | None:
    rows = df.limit(most + 1).toArrow()
    return rows if rows.num_rows <= most else None


def fetched(df: DataFrame, most: int = SMALL) -> DataFrame | None:
    """df to be broadcast, if it has at most `most` rows; these are fetched once, so that the check costs no second run. None if it has more."""
    rows = _few(df, most)
    return None if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def dimension(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it is small."""
    found = fetched(df, most)
    return df if found is None else found


def intersect_size(xs: Column, xe: Column, ys: Column, ye: Column) -> Column:
    """Number of points that two closed intervals share."""
    return F.greatest(F.lit(0), F.least(xe, ye) - F.greatest(xs, ys) + 1)


def overlap_join(left: DataFrame, right: DataFrame, lk: tuple[str, str, str], rk: tuple[str, str, str], how: str = "inner", bin_size: int | None = None, small: bool | None = None) -> DataFrame:
    """Rows of left with each row of right that overlaps them; lk and rk name chromosome, start and end.

    how is inner, left or left_semi. Points, whose start and end are one column,
    lie in one bin each and are joined by (chromosome, bin) in every case.
    Otherwise a right side of up to SMALL rows is broadcast, unless small is
    False, and probed through an IntervalIndex if it has over DENSE intervals a
    chromosome; beyond that both sides are cut into bins of bin_size (10 Mb unless
    given); a long interval is copied to each bin that it meets, and a pair
    counts in the bin of the later start.
    """
    lc, ls, le = (F.col(x) for x in lk)
    rc, rs, re_ = (F.col(x) for x in rk)
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"rename columns on both sides: {', '.join(sorted(clash))}")
    meets = (ls <= re_) & (le >= rs)
    if lk[1] == lk[2]:
        right = right if small is False else dimension(right)
        size = bin_size or _width(right, rk)
        b = right.withColumn("_rbin", F.explode(F.sequence(F.floor(rs / size), F.floor(F.greatest(rs, re_) / size))))
        return left.join(b, (lc == rc) & (F.floor(ls / size) == F.col("_rbin")) & meets, how).drop("_rbin")
    if small is not False and (few := _few(right, SMALL)) is not None:
        if few.num_rows > DENSE * len(pc.unique(few.column(rk[0]))):
            return indexed_join(left, few, right.schema, lk, rk, how)
        return left.join(F.broadcast(right.sparkSession.createDataFrame(few, right.schema)), (lc == rc) & meets, how)
    size = bin_size or 10_000_000
    row = "_row"
    d = left.withColumn(row, F.struct(*left.columns))
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / size), F.floor(F.greatest(s, e) / size)))
    a = d.withColumn("_bin", cells(ls, le))
    b = right.withColumn("_rbin", cells(rs, re_))
    pairs = a.join(b, (lc == rc) & (F.col("_bin") == F.col("_rbin")) & meets & (F.col("_bin") == F.floor(F.greatest(ls, rs) / size)))
    pairs = pairs.drop("_bin", "_rbin")
    if how == "inner":
        return pairs.drop(row)
    keys = [left[c].eqNullSafe(F.col(f"_r.{c}")) for c in left.columns]
    hits = pairs.select(F.col(row).alias("_r")).distinct()
    if how == "left_semi":
        return left.join(hits, keys, "left_semi")
    rest = left.join(hits, keys, "left_anti")
    return pairs.drop(row).unionByName(rest, allowMissingColumns=True)


def _width(right: DataFrame, rk: tuple[str, str, str]) -> int:
    """Bin size for points: four times the mean length of the intervals, so that one lies in a bin or two."""
    mean = right.agg(F.avg(F.col(rk[2]) - F.col(rk[1]) + 1)).first()[0]
    return max(1, int(4 * (mean or 1)))


def covered(regions: DataFrame, chrom: str, start: str, end: str, flags: dict[str, Column]) -> DataFrame:
    """Disjoint stretches chrom, start, end of what the regions cover, and for each flag whether a region with it covers the stretch."""
    delta = [F.sum(F.when(c, F.col("_d")).otherwise(0)).alias(k) for k, c in flags.items()]
    ends = regions.select("*", F.explode(F.array(F.struct(F.col(start).alias("_p"), F.lit(1).alias("_d")), F.struct((F.col(end) + 1).alias("_p"), F.lit(-1).alias("_d")))).alias("_x"))
    at = ends.select("*", "_x._p", "_x._d").groupBy(chrom, "_p").agg(*delta)
    w = Window.partitionBy(chrom).orderBy("_p")
    run = {k: F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0 for k in flags}
    d = at.select(chrom, F.col("_p").alias(start), (F.lead("_p").over(w) - 1).alias(end), *[c.alias(k) for k, c in run.items()])
    any_ = F.lit(False)
    for k in flags:
        any_ = any_ | F.col(k)
    return d.where(any_)


def first_match(left: DataFrame, right: DataFrame, lk: tuple[str, str, str], rk: tuple[str, str, str], row_id: list[str], value: str, small: bool | None = None) -> DataFrame:
    """row_id and the value of the overlapping right interval that comes first by start and end; rows without one are absent.

    Of the intervals that end at a row's start or later, the first by start is
    the answer if it begins by the row's end; if it does not, none overlaps. So
    the line is cut at the ends of the intervals that are first somewhere, and a
    row is looked up once, however many intervals overlap it.
    """
    (lc, ls, le), (rc, rs, re_) = lk, rk
    own = F.struct(F.col(rs).alias("s"), F.col(re_).alias("e"), F.col(value).alias("v"))
    later = Window.partitionBy("_fc").orderBy(F.desc("_high"))
    ends = right.dropna(subset=[rc, rs, re_]).groupBy(F.col(rc).alias("_fc"), F.col(re_).alias("_high")).agg(F.min(own).alias("_first"))
    behind = F.min("_first").over(later.rowsBetween(Window.unboundedPreceding, -1))
    cut = ends.withColumn("_behind", behind).where(F.col("_behind").isNull() | (F.col("_first") < F.col("_behind")))
    cut = cut.select("_fc", "_high", "_first", F.lead("_high").over(later).alias("_low"))
    cut = cut if small is False else dimension(cut)
    least = F.lit(None)  # where the first cut of a chromosome begins, for rows that may begin before all intervals
    if ls == le:
        cut = cut.withColumn("_low", F.greatest("_low", F.col("_first.s") - 1))
    else:
        least = F.lit(cut.agg(F.min(F.least("_first.s", "_high"))).first()[0])
        cut = cut.withColumn("_low", F.coalesce("_low", least - 1))
    size = _width(cut, ("_fc", "_low", "_high"))
    cells = F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.greatest("_low", "_high") / size)))
    at = F.when(F.col(ls).isNotNull(), F.greatest(F.col(ls), least))
    on = (F.col(lc) == F.col("_fc")) & (F.floor(at / size) == F.col("_cell")) & (at > F.col("_low")) & (at <= F.col("_high")) & (F.col(le) >= F.col("_first.s"))
    hit = left.join(cut.withColumn("_cell", cells), on)
    return hit.groupBy(*row_id).agg(F.min("_first").alias("_first")).select(*row_id, F.col("_first.v").alias(value))


def self_flank(segments: DataFrame, flank: int = 5_000_000) -> DataFrame:
    """Segments with n_near: others of the sample and chromosome that overlap [start - flank, start + flank].

    Both bounds are counted by running sums over the sorted line (starts up to
    the right bound less ends before the left one), so no pairs are formed.
    """
    keys = ["sample", "chromosome"]
    lo, hi = F.greatest(F.col("start_pos") - flank, F.lit(1)), F.col("start_pos") + flank
    # kind 0 sorts before 1: a start at the right bound counts, an end at the left bound does not count as before it
    nothing = F.lit(None).cast("long")
    event = lambda x, kind, q: F.struct(x.cast("long").alias("x"), F.lit(kind).alias("kind"), q.cast("long").alias("q"))
    four = F.array(event(F.col("start_pos"), 0, nothing), event(F.col("end_pos"), 2, nothing), event(hi, 1, F.col("start_pos")), event(lo, -1, F.col("start_pos")))
    w = Window.partitionBy(*keys).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = (F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).over(w) for k in (0, 2))
    run = segments.select(*keys, F.inline(four)).withColumns({"_s": begun, "_e": ended}).where("q IS NOT NULL")
    # segments with the same start ask alike
    per = run.groupBy(*keys, F.col("q").alias("start_pos")).agg((F.max(F.when(F.col("kind") == 1, F.col("_s"))) - F.max(F.when(F.col("kind") == -1, F.col("_e"))) - 1).alias("n_near"))
    return segments.join(per, [*keys, "start_pos"])


def point_in(points: DataFrame, regions: DataFrame, pk: tuple[str, str], rk: tuple[str, str, str], small: bool | None = None) -> DataFrame:
    """Points that some region contains."""
    return overlap_join(points, regions, (pk[0], pk[1], pk[1]), rk, "left_semi", small=small)


def chunks(df: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """Each interval cut into n nearly equal closed chunks: chunk, chunk_start, chunk_end."""
    s, e, k = F.col(start), F.col(end), F.col("chunk")
    at = lambda i: F.bround(s + (e + 1 - s) * i / n).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"chunk_start": at(k), "chunk_end": at(k + 1) - 1})
