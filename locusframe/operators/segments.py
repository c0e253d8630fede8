"""Operators on copy-number segments: cleaning, merging, summaries and scores.

A segment table has sample, chromosome, start_pos, end_pos (closed interval)
and seg_val (integer copy number); minor_cn and other columns may follow.
`order` columns break ties of start_pos, so that every window is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import dimension, overlap_join

AUTOSOMES = tuple(f"chr{i}" for i in range(1, 23))
CHROMOSOMES = (*AUTOSOMES, "chrX", "chrY")
ORDER = ("t1", "t2", "t3", "t4")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def per_chromosome(order: Sequence[str] = ORDER):
    return Window.partitionBy("sample", "chromosome").orderBy("start_pos", *order)


def length() -> Column:
    return F.col("end_pos") - F.col("start_pos") + 1


def normalize_chromosome(c: Column) -> Column:
    """chr prefix in lower case, x, y, 23 and 24 written as X, Y, X and Y."""
    bare = F.regexp_replace(c.cast("string"), "^(?i)chr", "")
    return F.concat(F.lit("chr"), F.when(F.upper(bare).isin("X", "23"), "X").when(F.upper(bare).isin("Y", "24"), "Y").otherwise(bare))


def clean_segments(raw: DataFrame, max_copynumber: int | None = 20, min_segnum: int = 0, chromosomes: Sequence[str] = CHROMOSOMES) -> tuple[DataFrame, DataFrame]:
    """Segments on the given chromosomes, and those on others. Rows without copy number go; values are capped and rounded half to even; samples with fewer than min_segnum segments go."""
    require_columns(raw, "sample", "chromosome", "start_pos", "end_pos", "seg_val")
    d = raw.where(F.col("seg_val").isNotNull() & ~F.isnan(F.col("seg_val").cast("double"))).withColumn("chromosome", normalize_chromosome(F.col("chromosome")))
    if min_segnum > 0:
        d = at_least(d, min_segnum)
    value = F.col("seg_val").cast("double")
    if max_copynumber is not None:
        value = F.least(value, F.lit(float(max_copynumber)))
    d = d.withColumns({"seg_val": F.bround(value).cast("int"), "start_pos": F.col("start_pos").cast("long"), "end_pos": F.col("end_pos").cast("long")})
    known = F.coalesce(F.col("chromosome").isin(*chromosomes), F.lit(False))
    return d.where(known), d.where(~known)


def at_least(segments: DataFrame, n: int) -> DataFrame:
    """Segments of the samples that have n or more."""
    kept = segments.groupBy("sample").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("sample")
    return segments.join(kept, "sample", "left_semi")


def subset(segments: DataFrame, predicate: Column | str) -> tuple[DataFrame, DataFrame]:
    """Segments that satisfy the predicate, and all others, those for which it is null among them."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    p = F.coalesce(p, F.lit(False))
    return segments.where(p), segments.where(~p)


def complement_chromosomes(segments: DataFrame, sizes: DataFrame, exclude: Sequence[str] = ("chrY",), normal: int = 2) -> DataFrame:
    """Adds a normal segment for each chromosome that a sample has none of. sizes (chrom, size) is a small dimension."""
    wanted = segments.select("sample").distinct().crossJoin(sizes.where(~F.col("chrom").isin(*exclude)).select(F.col("chrom").alias("chromosome"), F.col("size").cast("long").alias("end_pos")))
    absent = wanted.join(segments.select("sample", "chromosome").distinct(), ["sample", "chromosome"], "left_anti")
    absent = absent.select("sample", "chromosome", F.lit(1).cast("long").alias("start_pos"), "end_pos", F.lit(normal).cast(segments.schema["seg_val"].dataType).alias("seg_val"))
    return segments.unionByName(absent, allowMissingColumns=True)


def label_loh(segments: DataFrame, min_length: int = 10_000) -> DataFrame:
    """minor_cn as the lesser allele, and loh: copies of one allele only, long enough, not on sex chromosomes."""
    minor = F.least(F.col("seg_val") - F.col("minor_cn"), F.col("minor_cn"))
    d = segments.withColumn("minor_cn", minor)
    loh = (F.col("seg_val") >= 1) & (F.col("minor_cn") == 0) & (F.col("end_pos") - F.col("start_pos") > min_length - 1) & ~F.col("chromosome").isin("chrX", "chrY")
    return d.withColumn("loh", F.coalesce(loh, F.lit(False)))


def sex_adjust(segments: DataFrame, sex: DataFrame | str = "female", max_cn: int | None = None) -> DataFrame:
    """Doubles the copy numbers of X and Y in males; sex is one word for all or a table (sample, sex)."""
    d = segments.withColumn("_sex", F.lit(sex)) if isinstance(sex, str) else segments.join(sex.select("sample", F.col("sex").alias("_sex")), "sample", "left")
    male = (F.lower("_sex") == "male") & F.col("chromosome").isin("chrX", "chrY")
    value = F.when(male, F.col("seg_val") * 2).otherwise(F.col("seg_val"))
    return d.withColumn("seg_val", F.least(value, F.lit(max_cn)) if max_cn is not None else value).drop("_sex")


def merge_adjacent(segments: DataFrame, order: Sequence[str] = ORDER, max_gap: int | None = None, loh_min_frac: float | None = None) -> DataFrame:
    """One segment for each run of equal neighbours within a chromosome: first start, last end, and n_merged.

    Gaps are ignored unless max_gap is given. With loh_min_frac and a column
    loh, a merged segment keeps the label if the labelled length exceeds that
    share of it (loh_frac).
    """
    w = per_chromosome(order)
    same = F.col("seg_val") == F.lag("seg_val").over(w)
    if max_gap is not None:
        same = same & (F.col("start_pos") - F.lag("end_pos").over(w) <= max_gap + 1)
    d = segments.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct("start_pos", *order)
    aggs = [F.min("start_pos").alias("start_pos"), F.max_by("end_pos", key).alias("end_pos"), F.first("seg_val").alias("seg_val"), F.count("*").alias("n_merged")]
    if loh_min_frac is not None:
        aggs += [F.sum(F.when(F.col("loh"), length()).otherwise(0)).alias("_loh"), F.sum(length()).alias("_all")]
    out = d.groupBy("sample", "chromosome", "_island").agg(*aggs).drop("_island")
    if loh_min_frac is not None:
        out = out.withColumn("loh_frac", F.col("_loh") / F.col("_all")).withColumn("loh", F.col("loh_frac") > loh_min_frac).drop("_loh", "_all")
    return out


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.bround(c, digits)


def cn_summary(segments: DataFrame, genome_size: int | None = None, digits: int | None = 3) -> DataFrame:
    """Per sample n_of_seg, n_of_cnv, n_of_amp, n_of_del, n_of_vchr and cna_burden; the burden is over the called autosome length, or over genome_size."""
    v, auto = F.col("seg_val"), F.col("chromosome").isin(*AUTOSOMES)
    changed = F.sum(F.when(auto & (v != 2), length()).otherwise(0))
    whole = F.lit(genome_size) if genome_size else F.sum(F.when(auto, length()))
    count = lambda p: F.sum(F.when(p, 1).otherwise(0)).cast("long")
    aggs = {"n_of_seg": F.count("*"), "n_of_cnv": count(v != 2), "n_of_amp": count(v > 2), "n_of_del": count(v < 2), "n_of_vchr": F.countDistinct(F.when(auto & (v != 2), F.col("chromosome")))}
    if "loh" in segments.columns:
        aggs["n_loh"] = count(auto & F.col("loh"))
    return segments.groupBy("sample").agg(*[c.alias(n) for n, c in aggs.items()], _rounded(changed / whole, digits).alias("cna_burden"))


def ploidy(segments: DataFrame, grouped: bool = True, digits: int | None = 2) -> DataFrame:
    """Length-weighted mean copy number, two decimals."""
    value = _rounded(F.sum(length() * F.col("seg_val")) / F.sum(length()), digits).alias("ploidy")
    return segments.groupBy("sample").agg(value) if grouped else segments.agg(value)


def ploh_score(segments: DataFrame, sizes: DataFrame, exclude: Sequence[str] = ("chrX", "chrY")) -> DataFrame:
    """Share of the genome with copies of one allele only."""
    total = sizes.where(~F.col("chrom").isin(*exclude)).agg(F.sum("size").alias("_size"))
    part = F.sum(F.when((F.col("seg_val") >= 1) & (F.col("minor_cn") == 0), length()).otherwise(0)).alias("_loh")
    per = segments.where(~F.col("chromosome").isin(*exclude)).groupBy("sample").agg(part)
    return per.crossJoin(F.broadcast(total)).select("sample", (F.col("_loh") / F.col("_size")).alias("ploh"))


def arm_annotation(segments: DataFrame, centromeres: DataFrame) -> DataFrame:
    """location (chromosome arm), annotation and fraction of each segment. centromeres: chrom, size, cen_left, cen_right."""
    c = dimension(centromeres.select(F.col("chrom").alias("chromosome"), "size", F.col("cen_left").alias("p_end"), F.col("cen_right").alias("q_start")))
    d = segments.join(c, "chromosome", "left")
    s, e, p_end, q_start, q_end = F.col("start_pos"), F.col("end_pos"), F.col("p_end"), F.col("q_start"), F.col("size")
    flag = (
        F.when((e <= p_end) & (s >= 1), 1)
        .when((e <= q_end) & (s >= q_start), 2)
        .when((s >= 1) & (s <= p_end) & (e >= q_start) & (e <= q_end), 3)
        .when((s < p_end) & (e < q_start), 4)
        .when((s > p_end) & (s < q_start) & (e > q_start), 5)
        .otherwise(6)
    )
    bare, span = F.regexp_replace("chromosome", "^chr", ""), length()
    arm = F.when(F.col("arm_flag").isin(1, 4), "p").when(F.col("arm_flag").isin(2, 5), "q").otherwise("pq")
    fraction = (
        F.when(F.col("arm_flag") == 1, span / p_end)
        .when(F.col("arm_flag") == 2, span / (q_end - q_start + 1))
        .when(F.col("arm_flag") == 4, (p_end - s + 1) / p_end)
        .when(F.col("arm_flag") == 5, (e - q_start + 1) / (q_end - q_start + 1))
        .otherwise(2 * span / q_end)
    )
    return d.withColumn("arm_flag", flag).withColumns({"arm": arm, "location": F.concat(bare, arm), "fraction": fraction}).drop("p_end", "q_start", "size")


ACROCENTRIC = ("13p", "14p", "15p", "21p", "22p")


def aneuploidy_score(annotated: DataFrame, ploidies: DataFrame | None = None, drop_black_arms: bool = False) -> DataFrame:
    """Per sample the number of arms that are gained or lost as a whole, ploidy taken as 2 or rounded from (sample, ploidy)."""
    d = annotated.where(F.col("chromosome").isin(*AUTOSOMES) & ~((F.col("arm") == "pq") & (F.bround("fraction") < 1)))
    both = F.col("arm") == "pq"
    d = d.withColumn("arm1", F.explode(F.when(both, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array("arm"))))
    d = d.withColumn("part", F.when(both, F.col("fraction") / 2).otherwise(F.col("fraction"))).withColumn("name", F.concat(F.regexp_replace("chromosome", "^chr", ""), "arm1"))
    if drop_black_arms:
        d = d.where(~F.col("name").isin(*ACROCENTRIC))
    arms = d.groupBy("sample", "name").agg(F.sum(F.col("seg_val") * F.col("part")).alias("cn"))
    arms = arms.join(ploidies.select("sample", F.col("ploidy").alias("base")), "sample", "left") if ploidies is not None else arms.withColumn("base", F.lit(2.0))
    state = F.greatest(F.least(F.bround(F.col("cn") - F.coalesce("base", F.lit(2.0))).cast("int"), F.lit(1)), F.lit(-1))
    return arms.groupBy("sample").agg(F.sum(F.abs(state)).alias("ascore"))


def _merged(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start_pos and end_pos of the disjoint stretches that segments of the same keys cover; one shuffle and one sort."""
    w = Window.partitionBy(*keys).orderBy("start_pos")
    far = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = segments.where("start_pos <= end_pos").select(*keys, "start_pos", "end_pos", F.when(F.col("start_pos") <= far, 0).otherwise(1).alias("_begins"))
    d = d.withColumn("_stretch", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_stretch").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_stretch")


def freq_by_band(segments: DataFrame, bands: DataFrame, low: int = 2, high: int = 2) -> DataFrame:
    """Per band the shares of samples with a gain (above high) and a loss (below low); bands that nothing covers have 0.

    A sample's gains, and its losses, are merged to disjoint stretches first, so
    it meets a band about once, however many of its segments lie there.
    """
    n = segments.agg(F.countDistinct("sample").alias("_n"))
    s = segments.select("sample", "chromosome", "start_pos", "end_pos", "seg_val").where((F.col("seg_val") > high) | (F.col("seg_val") < low))
    s = s.select("sample", "chromosome", "start_pos", "end_pos", (F.col("seg_val") > high).alias("gain"))
    s = _merged(s, ["sample", "chromosome", "gain"])
    b = dimension(bands.select("chrom", F.col("start_pos").alias("bs"), F.col("end_pos").alias("be"), "band"))
    hit = overlap_join(s, b, ("chromosome", "start_pos", "end_pos"), ("chrom", "bs", "be"))
    each = hit.groupBy("chrom", "bs", "be", "band", "sample").agg(F.max(F.col("gain").cast("int")).alias("a"), F.max((~F.col("gain")).cast("int")).alias("d"))
    per = each.groupBy("chrom", "bs", "be", "band").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    out = b.join(per, ["chrom", "bs", "be", "band"], "left").crossJoin(F.broadcast(n))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("_n")
    return out.select("chrom", F.col("bs").alias("start_pos"), F.col("be").alias("end_pos"), "band", share("a").alias("amp"), share("d").alias("del"))


def band_values(segments: DataFrame, bands: DataFrame, value: Column | None = None) -> DataFrame:
    """band and sample with one value for the overlapping segments: their rounded mean, or the given aggregate of seg_val. Long form; pivot it for few samples."""
    s = segments.select("sample", "chromosome", "start_pos", "end_pos", "seg_val")
    b = bands.select("chrom", F.col("start_pos").alias("bs"), F.col("end_pos").alias("be"), "band")
    hit = overlap_join(s, b, ("chromosome", "start_pos", "end_pos"), ("chrom", "bs", "be"))
    return hit.groupBy("chrom", "band", "sample").agg((F.bround(F.avg("seg_val")).cast("int") if value is None else value).alias("value"))


def band_matrix(segments: DataFrame, bands: DataFrame, samples: Sequence[str], value: Column | None = None, fill: float | None = None, resolution: int = 1) -> DataFrame:
    """One row per band (each cut into `resolution` equal parts), a column per sample named: the value of its overlapping segments, or fill. Without fill, bands that a sample lacks go."""
    b = bands.select("chrom", "start_pos", "end_pos", "band")
    if resolution > 1:
        from locusframe.operators.intervals import chunks

        b = chunks(b, "start_pos", "end_pos", resolution).select("chrom", F.col("chunk_start").alias("start_pos"), F.col("chunk_end").alias("end_pos"), F.concat_ws("_", "band", (F.col("chunk") + 1).cast("string")).alias("band"))
    long = band_values(segments.where(F.col("sample").isin(*samples)), b, value)
    wide = long.groupBy("chrom", "band").pivot("sample", list(samples)).agg(F.first("value"))
    return wide.na.fill(fill) if fill is not None else wide.na.drop()


def cna_load(segments: DataFrame, digits: int | None = 2) -> DataFrame:
    """log2 of one more than the number of altered autosome segments, two decimals."""
    n = F.sum(F.when(F.col("seg_val") != 2, 1).otherwise(0))
    return segments.where(F.col("chromosome").isin(*AUTOSOMES)).groupBy("sample").agg(_rounded(F.log2(n + 1), digits).alias("cna_load"))


def macn(segments: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean and length-weighted mean copy number of altered autosome segments."""
    d = segments.where(F.col("chromosome").isin(*AUTOSOMES) & (F.col("seg_val") != 2))
    return d.groupBy("sample").agg(_rounded(F.avg("seg_val"), digits).alias("macn"), _rounded(F.sum(F.col("seg_val") * length()) / F.sum(length()), digits).alias("weighted_macn"))


def tandem_duplication(segments: DataFrame, sizes: Sequence[float] = (1e3, 1e5, 2e6), min_cn: int = 2) -> DataFrame:
    """tdp, tdp_pnas, stdp and ltdp: how evenly gains of the given lengths (short up to the middle size) spread over 22 chromosomes."""
    n_chr = 22
    per = segments.where(F.col("chromosome").isin(*AUTOSOMES)).groupBy("sample", "chromosome").agg(
        *[F.sum(F.when((F.col("seg_val") > min_cn) & length().between(*x), 1).otherwise(0)).cast("long").alias(n) for n, x in (("x", (sizes[0], sizes[2])), ("s", sizes[:2]), ("l", (sizes[1] + 1, sizes[2])))]
    )
    w = Window.partitionBy("sample")
    d = per.withColumns({f"{c}_t": F.sum(c).over(w) for c in "xsl"} | {"k": F.count("*").over(w)})
    # chromosomes without segments count 0: each adds |0 - mean|
    dev = {c: (F.sum(F.abs(F.col(c) - F.col(f"{c}_t") / n_chr)) + (n_chr - F.first("k")) * F.first(f"{c}_t") / n_chr).alias(f"{c}_d") for c in "xsl"}
    a = d.groupBy("sample").agg(*dev.values(), *[F.first(f"{c}_t").alias(f"{c}_t") for c in "xsl"])
    tdp = lambda c: F.col(f"{c}_t") / (F.col(f"{c}_d") + 1)
    pnas = F.when(F.col("x_t") > 0, -F.col("x_d") / F.col("x_t"))
    return a.select("sample", tdp("x").alias("tdp"), pnas.alias("tdp_pnas"), tdp("s").alias("stdp"), tdp("l").alias("ltdp"))


def chromothripsis(segments: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Sum over chromosomes of the squared number of 2-1-2 patterns, the neighbours of the ends taken as 2."""
    w = per_chromosome(order)
    left, right = F.lag("seg_val", 1, 2).over(w), F.lead("seg_val", 1, 2).over(w)
    hit = F.when((left == 2) & (F.col("seg_val") == 1) & (right == 2), 1).otherwise(0)
    per = segments.where(F.col("chromosome").isin(*AUTOSOMES)).withColumn("_hit", hit).groupBy("sample", "chromosome").agg(F.sum("_hit").alias("_n"))
    return per.groupBy("sample").agg(F.sum(F.col("_n") * F.col("_n")).cast("long").alias("chromoth_state"))


def scoring(segments: DataFrame, order: Sequence[str] = ORDER, digits: int | None = 2) -> DataFrame:
    """All scores of a sample side by side."""
    out = cna_load(segments, digits)
    for part in (macn(segments, digits), tandem_duplication(segments), chromothripsis(segments, order)):
        out = out.join(part, "sample", "full_outer")
    return out


def profile_table(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Genome-wide coordinates and a type (Amp, Normal, Del) of each segment. sizes (chrom, size) is a small dimension."""
    bare = F.regexp_replace("chrom", "^chr", "")
    rank = F.when(bare == "X", 23).when(bare == "Y", 24).otherwise(bare.try_cast("int"))
    sizes = dimension(sizes)
    w = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("_k", rank).select(F.col("chrom").alias("chromosome"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("_off"))
    d = segments.join(F.broadcast(offset), "chromosome")
    kind = F.when(F.col("seg_val") > 2, "Amp").when(F.col("seg_val") < 2, "Del").otherwise("Normal")
    return d.withColumns({"x_start": F.col("start_pos") + F.col("_off"), "x_end": F.col("end_pos") + F.col("_off"), "type": kind}).drop("_off")
