"""Mutually exclusive classes of copy-number segments, and the per-sample feature distributions.

Every class is a column computed on the segment row; a catalogue is one
aggregate over (sample, component).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import dimension
from locusframe.operators.segments import AUTOSOMES, ORDER, length, per_chromosome

# Length classes and components of the two catalogues of 40 and 48 classes.
LENGTHS_40 = ("0-10Kb", "10Kb-100Kb", "100Kb-1Mb", "1Mb-10Mb", ">10Mb")
LENGTHS_48 = ("0-100Kb", "100Kb-1Mb", "1Mb-10Mb", "10Mb-40Mb", ">40Mb")
CN_40 = tuple(f"{cn}:{state}:{size}" for cn, states in (("0-1", ("homdel", "LOH")), ("2", ("het", "LOH")), ("3-4", ("het", "LOH")), ("5+", ("het", "LOH"))) for state in states for size in LENGTHS_40)
CN_48 = (
    *(f"0:homdel:{size}" for size in ("0-100Kb", "100Kb-1Mb", ">1Mb")),
    *(f"1:LOH:{size}" for size in LENGTHS_48),
    *(f"{cn}:{state}:{size}" for cn, state in product(("2", "3-4", "5-8", "9+"), ("het", "LOH")) for size in LENGTHS_48),
)


def cut(x: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (a, b] that x lies in; the last label holds what exceeds all breaks."""
    out = F.when(x <= breaks[0], labels[0])
    for b, name in zip(breaks[1:], labels[1:], strict=False):
        out = out.when(x <= b, name)
    return out.when(x > breaks[-1], labels[-1])


def loh_state(zero: Column | None = None) -> Column:
    zero = F.col("seg_val") == 0 if zero is None else zero
    return F.when(zero, "homdel").when(F.coalesce(F.col("loh"), F.lit(False)), "LOH").otherwise("het")


def label_40_48(segments: DataFrame) -> DataFrame:
    """cn40 and cn48: copy number, allelic state and length class; null for combinations outside the vocabularies."""
    size, state, v = length(), loh_state(), F.col("seg_val")
    c40 = F.concat_ws(":", cut(v, (1, 2, 4), ("0-1", "2", "3-4", "5+")), state, cut(size, (10_000, 100_000, 1_000_000, 10_000_000), LENGTHS_40))
    short = cut(size, (100_000, 1_000_000), ("0-100Kb", "100Kb-1Mb", ">1Mb"))
    long = cut(size, (100_000, 1_000_000, 10_000_000, 40_000_000), LENGTHS_48)
    c48 = F.concat_ws(":", cut(v, (0, 1, 2, 4, 8), ("0", "1", "2", "3-4", "5-8", "9+")), state, F.when(state == "homdel", short).otherwise(long))
    # One struct, made before it is tested, so that no label is worked out twice.
    at = "__labels"
    d = segments.withColumn(at, F.struct(c40.alias("a"), c48.alias("b")))
    known = lambda c, names: F.when(c.isin(*names), c)
    return d.withColumns({"cn40": known(F.col(at)["a"], CN_40), "cn48": known(F.col(at)["b"], CN_48)}).drop(at)


def context(segments: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """cs (heights of the neighbours: H not lower, L lower) and ab (steps to them: A up to 2, B more); ends have neighbours of 2."""
    w = per_chromosome(order)
    left, right = F.col("seg_val") - F.lag("seg_val", 1, 2).over(w), F.col("seg_val") - F.lead("seg_val", 1, 2).over(w)
    d = segments.withColumns({"_l": left, "_r": right})
    side = lambda c: F.when(F.col(c) <= 0, "H").otherwise("L")
    step = lambda c: F.when(F.abs(c) <= 2, "A").otherwise("B")
    return d.withColumns({"cs": F.concat(side("_l"), side("_r")), "ab": F.concat(step("_l"), step("_r"))}).drop("_l", "_r")


def size_class() -> Column:
    return cut(length(), (50_000, 500_000, 5_000_000), ("S", "M", "L", "E"))


# Size, shape and copy number of the classes in which AB, BA and BB count as one class, 3C.
MERGED_3C = (
    "S:HH:0", "S:HL:1", "S:HL:2", "S:HL:3", "S:HL:4", "S:LH:1", "S:LH:2", "S:LH:3", "S:LH:4", "S:LL:3", "S:LL:4",
    "M:HH:0", "M:HH:1", "M:HL:1", "M:HL:2", "M:HL:3", "M:HL:4", "M:LH:1", "M:LH:2", "M:LH:3", "M:LH:4", "M:LL:3", "M:LL:4",
    "L:HH:0", "L:HH:1", "L:HH:2", "L:HH:3", "L:HH:4", "L:HH:5+", "L:HL:1", "L:HL:2", "L:HL:3", "L:HL:4", "L:LH:1", "L:LH:2", "L:LH:3", "L:LH:4", "L:LL:3", "L:LL:4",
    "E:HH:0", "E:HH:1", "E:HH:2", "E:HH:3", "E:HH:4", "E:HH:5+", "E:HL:1", "E:HL:2", "E:HL:3", "E:HL:4", "E:LH:1", "E:LH:2", "E:LH:3", "E:LH:4", "E:LL:3", "E:LL:4",
)
# Those in which AB and BA count as one class, 2C.
MERGED_2C = ("S:HH:1", "S:HH:3", "S:HH:4", "S:HH:5+", "S:LL:5+", "M:HH:2", "M:HH:3", "M:HH:4", "M:HH:5+", "M:LL:5+")
# Shape, copy number and steps that are no class, of any size.
NEVER_T = (
    "HL:0:AA", "HL:0:AB", "HL:0:BA", "HL:0:BB", "LH:0:AA", "LH:0:AB", "LH:0:BA", "LH:0:BB", "LL:0:AA", "LL:0:AB", "LL:0:BA", "LL:0:BB",
    "LL:1:AB", "LL:1:BA", "LL:1:BB", "LL:2:AB", "LL:2:BA", "LL:2:BB",
)
NEVER_X = (
    "HL:0:AA", "HL:0:BB", "LH:0:AA", "LH:0:BB", "LL:0:AA", "LL:0:BB", "HL:1:BB", "LH:1:BB", "LL:1:BB", "HL:2:BB", "LH:2:BB", "LL:2:BB", "HL:2LOH:BB", "LH:2LOH:BB", "LL:2LOH:BB",
)
SIZES, SHAPES = ("S", "M", "L", "E"), ("HH", "HL", "LH", "LL")


def label_t(segments: DataFrame, order: Sequence[str] = ORDER, with_loh: bool = False) -> DataFrame:
    """t_standard, t_simple and t_complex of each segment; null for classes that cannot occur. t_complex needs n_near (self_flank)."""
    d = context(segments, order)
    v, ss, cs, ab = F.col("seg_val"), size_class(), F.col("cs"), F.col("ab")
    loh = F.coalesce(F.col("loh"), F.lit(False)) if with_loh else F.lit(False)
    cn = F.when(loh & (v != 1), "2+LOH").otherwise(cut(v, (0, 1, 2, 3, 4), ("0", "1", "2", "3", "4", "5+")))
    c_cn = F.when(loh & (v != 1), "2+LOH").otherwise(cut(v, (0, 1, 2, 3, 4, 5, 6, 7, 8), ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9+")))
    d = d.withColumns({"_ss": ss, "_cn": cn, "_ccn": c_cn})
    kind = F.concat_ws(":", "_ss", cs, "_cn")
    steps = F.when((ab != "AA") & kind.isin(*MERGED_3C), "3C").when(ab.isin("AB", "BA") & kind.isin(*MERGED_2C), "2C").otherwise(ab)
    never = F.concat_ws(":", cs, F.col("_cn"), ab).isin(*NEVER_T)
    flat = F.when(cs.isin("HL", "LH"), "LD").otherwise(cs)
    simple = F.when(F.col("_cn") == "2+LOH", F.concat_ws(":", "_ss", flat, F.lit("2+:LOH"))).otherwise(F.concat_ws(":", F.col("_ss"), flat, F.col("_cn"), steps))
    out = {"t_standard": F.when(~never, F.concat_ws(":", F.col("_ss"), cs, F.col("_cn"), steps)), "t_simple": F.when(~never, simple)}
    if "n_near" in segments.columns:
        near = cut(F.col("n_near"), (2, 4, 6, 8, 10), ("2-", "4-", "6-", "8-", "10-", "11+"))
        digits = cut(F.floor(F.log10(length())), (2, 3, 4, 5, 6, 7), ("2-", "3", "4", "5", "6", "7", "8+"))
        out["t_complex"] = F.concat_ws(":", digits, cs, F.col("_ccn"), F.concat(F.lit("P"), near))
    return d.withColumns(out).drop("_ss", "_cn", "_ccn")


def label_x(segments: DataFrame, order: Sequence[str] = ORDER, with_loh: bool = False) -> DataFrame:
    """x_standard and x_simple of each segment; null for classes that cannot occur."""
    d = context(segments, order)
    v, cs = F.col("seg_val"), F.col("cs")
    loh = F.coalesce(F.col("loh"), F.lit(False)) if with_loh else F.lit(False)
    cn = F.when(loh & (v == 2), "2LOH").when(loh & (v > 2), "3+LOH").otherwise(cut(v, (0, 1, 2, 3, 4, 8), ("0", "1", "2", "3", "4", "5-8", "9+")))
    ab = F.when(F.col("ab") == "AA", "AA").otherwise("BB")
    d = d.withColumns({"_ss": size_class(), "_cn": cn, "_ab": ab})
    never = F.concat_ws(":", cs, F.col("_cn"), F.col("_ab")).isin(*NEVER_X)
    name = lambda shape: F.when(~never, F.concat_ws(":", F.col("_ss"), shape, F.col("_cn"), F.col("_ab")))
    return d.withColumns({"x_standard": name(cs), "x_simple": name(F.when(cs.isin("HL", "LH"), "LD").otherwise(cs))}).drop("_ss", "_cn", "_ab")


def vocabulary_t(with_loh: bool = False) -> list[str]:
    """Components of t_standard."""
    out = set()
    for ss, cs, cn, ab in product(SIZES, SHAPES, ("0", "1", "2", "3", "4", "5+") + ("2+LOH",) * with_loh, ("AA", "AB", "BA", "BB")):
        kind = f"{ss}:{cs}:{cn}"
        steps = "3C" if ab != "AA" and kind in MERGED_3C else "2C" if ab in ("AB", "BA") and kind in MERGED_2C else ab
        if f"{cs}:{cn}:{ab}" not in NEVER_T:
            out.add(f"{kind}:{steps}")
    return sorted(out)


def vocabulary_x(with_loh: bool = False) -> list[str]:
    """Components of x_standard."""
    copies = ("0", "1", "2", "3", "4", "5-8", "9+") + ("2LOH", "3+LOH") * with_loh
    return sorted(":".join(x) for x in product(SIZES, SHAPES, copies, ("AA", "BB")) if ":".join(x[1:]) not in NEVER_X)


def count_components(labelled: DataFrame, label: str, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Catalogue in long form: keys, component and n; rows whose label is null count nowhere."""
    return labelled.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("component")).agg(F.count("*").alias("n"))


def filled(catalog: DataFrame, vocabulary: Sequence[str], key: str = "sample", samples: DataFrame | None = None) -> DataFrame:
    """The catalogue with a row for every component of the vocabulary, 0 where nothing was counted. The vocabulary is small and fixed."""
    spark = catalog.sparkSession
    vocab = F.broadcast(spark.createDataFrame([(v,) for v in vocabulary], "component string"))
    spine = (catalog.select(key).distinct() if samples is None else samples.select(key).distinct()).crossJoin(vocab)
    return spine.join(catalog, [key, "component"], "left").select(key, "component", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def wide(catalog: DataFrame, vocabulary: Sequence[str], key: str = "sample") -> DataFrame:
    """One row per key, a column per component of the vocabulary."""
    return catalog.groupBy(key).pivot("component", list(vocabulary)).agg(F.sum("n")).na.fill(0)


def long(table: DataFrame, key: str = "sample", keep_zeros: bool = False) -> DataFrame:
    """The catalogue of a wide table: key, component and n of every column but the key; nulls count as 0, which is left out unless asked for."""
    names = [c for c in table.columns if c != key]
    d = table.select(key, *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(c) for c in names]).unpivot(key, [f"`{c}`" for c in names], "component", "n")
    return d if keep_zeros else d.where("n <> 0")


# Feature distributions: one row per value.


def feature_segsize(segments: DataFrame) -> DataFrame:
    return segments.select("sample", length().alias("value"))


def feature_cn(segments: DataFrame) -> DataFrame:
    return segments.select("sample", F.col("seg_val").cast("long").alias("value"))


def feature_changepoint(segments: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Absolute steps between neighbours; 0 for a chromosome with one segment."""
    w = per_chromosome(order)
    n = F.count("*").over(Window.partitionBy("sample", "chromosome"))
    step = F.abs(F.col("seg_val") - F.lag("seg_val").over(w))
    d = segments.select("sample", F.when(n == 1, 0).otherwise(step).cast("long").alias("value"))
    return d.where(F.col("value").isNotNull())


def feature_nchrv(segments: DataFrame) -> DataFrame:
    """Number of chromosomes with a copy number other than 2."""
    return segments.groupBy("sample").agg(F.countDistinct(F.when(F.col("seg_val") != 2, F.col("chromosome"))).alias("value"))


def chromosome_number(c: Column, x: int = 23) -> Column:
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "X", x).when(bare == "Y", x + 1).otherwise(F.try_to_number(bare, F.lit("99")).cast("int"))


def feature_bochr(segments: DataFrame) -> DataFrame:
    """Chromosome number of each altered segment; 0 for a sample without any."""
    altered = segments.where(F.col("seg_val") != 2).select("sample", chromosome_number(F.col("chromosome")).cast("long").alias("value"))
    none = segments.groupBy("sample").agg(F.max(F.when(F.col("seg_val") != 2, 1)).alias("a")).where("a IS NULL").select("sample", F.lit(0).cast("long").alias("value"))
    return altered.unionByName(none)


def feature_nc50(segments: DataFrame) -> DataFrame:
    """Least number of chromosomes, the most altered first, that hold half of the altered segments; 0 without any."""
    per = segments.groupBy("sample", "chromosome").agg(F.sum(F.when(F.col("seg_val") != 2, 1).otherwise(0)).alias("c"))
    w = Window.partitionBy("sample").orderBy(F.desc("c"), "chromosome")
    d = per.withColumns({"r": F.row_number().over(w), "run": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(Window.partitionBy("sample"))})
    hit = F.min(F.when((F.col("all") > 0) & (2 * F.col("run") >= F.col("all")), F.col("r")))
    return d.groupBy("sample").agg(F.coalesce(hit, F.lit(0)).cast("long").alias("value"))


def feature_oscillation(segments: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Lengths of runs in which the copy number returns to that of two segments before; 0 for a chromosome of fewer than three."""
    w = per_chromosome(order)
    v = F.col("seg_val")
    d = segments.select("sample", "chromosome", "start_pos", *order, "seg_val", F.count("*").over(Window.partitionBy("sample", "chromosome")).alias("k"))
    back = F.coalesce((v == F.lag(v, 2).over(w)) & (v != F.lag(v, 1).over(w)), F.lit(False))
    d = d.withColumn("hit", F.when(back, 1).otherwise(0))
    d = d.withColumn("grp", F.sum(1 - F.col("hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A run is told when the row after it breaks it: o is 0 there. Rows without a run are told where the next value is 0 too.
    d3 = d.where("k >= 3").withColumn("i", F.row_number().over(w)).withColumn("o", F.sum("hit").over(Window.partitionBy("sample", "chromosome", "grp").orderBy("start_pos", *order).rowsBetween(Window.unboundedPreceding, 0)))
    d3 = d3.where("i >= 3").withColumn("next", F.lead("o").over(w))
    told = d3.where((F.col("next") == 0) | (F.col("next").isNull() & (F.col("o") > 0))).select("sample", F.col("o").cast("long").alias("value"))
    few = d.where("k < 3").select("sample", "chromosome").distinct().select("sample", F.lit(0).cast("long").alias("value"))
    return told.unionByName(few)


def oscillation_index(segments: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """segments with n_oscillation: the length of the longest run of returns (as in feature_oscillation) that the segment takes part in, 0 outside.

    A run begins two segments before its first return, so 4 1 4 6 4 has 1 1 1 1 1
    and 2 2 3 2 has 0 1 1 1. In a stretch that begins with a segment that does
    not return all others do: it belongs to its own stretch and to the next.
    """
    w = per_chromosome(order)
    v = F.col("seg_val")
    back = F.coalesce((v == F.lag(v, 2).over(w)) & (v != F.lag(v, 1).over(w)), F.lit(False))
    d = segments.withColumn("_hit", F.when(back, 1).otherwise(0))
    d = d.withColumn("_grp", F.sum(1 - F.col("_hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_run", F.sum("_hit").over(Window.partitionBy("sample", "chromosome", "_grp")))
    return d.withColumn("n_oscillation", F.greatest("_run", F.coalesce(F.lead("_run").over(w), F.lit(0)))).drop("_hit", "_grp", "_run")


def feature_breakpoints(segments: DataFrame, sizes: DataFrame, order: Sequence[str] = ORDER, bin_size: int = 10_000_000) -> DataFrame:
    """Number of segment ends, the last of a chromosome left out, in each 10 Mb bin of the chromosomes that a sample has."""
    w = per_chromosome(order)
    ends = segments.withColumn("_last", F.lead("start_pos").over(w).isNull()).where("NOT _last")
    at = ends.groupBy("sample", "chromosome", F.greatest(F.ceil((F.col("end_pos") - 1) / bin_size) - 1, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"))
    dim = dimension(sizes.select(F.col("chrom").alias("chromosome"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") + bin_size - 1) / bin_size) - 1)).alias("bin")))
    spine = segments.select("sample", "chromosome").distinct().join(dim, "chromosome")
    return spine.join(at, ["sample", "chromosome", "bin"], "left").select("sample", F.coalesce("c", F.lit(0)).cast("long").alias("value"))


def feature_bparm(segments: DataFrame, centromeres: DataFrame) -> DataFrame:
    """Breakpoints on each side of the centromere of each chromosome that a sample has."""
    c = dimension(centromeres.select(F.col("chrom").alias("chromosome"), "cen_left", "cen_right"))
    d = segments.join(c, "chromosome").where(~((F.col("start_pos") > F.col("cen_left")) & (F.col("end_pos") < F.col("cen_right"))))
    per = d.groupBy("sample", "chromosome").agg(
        F.count("*").alias("k"), F.sum(F.when(F.col("end_pos") < F.col("cen_right"), 1).otherwise(0)).alias("q1"), F.sum(F.when(F.col("end_pos") > F.col("cen_right"), 1).otherwise(0)).alias("q2")
    )
    both = F.when(F.col("k") < 2, F.array(F.lit(0).cast("long"))).when(F.col("q2") == 0, F.array(F.col("q1") - 1)).when(F.col("q1") == 0, F.array(F.col("q2") - 1)).otherwise(F.array("q1", F.col("q2") - 1))
    return per.select("sample", F.explode(both).alias("value"))


# Bins of the feature distributions, as (feature, points, upper bounds of half-open ranges; the last range is open).
FEATURE_BINS = (
    ("BP10MB", (0, 1, 2, 3, 4, 5), (5,)),
    ("BPArm", tuple(range(11)), (10, 20, 30)),
    ("CN", (0, 1, 2, 3, 4), (4, 8)),
    ("CNCP", (0, 1, 2, 3, 4), (4, 8)),
    ("OsCN", (0, 1, 2, 3, 4), (4, 10)),
    ("SS", (), (float("-inf"), 2, 3, 4, 5, 6, 7, 8)),
    ("NC50", (3, 4, 5, 6, 7), (7,)),
    ("BoChr", tuple(range(1, 24)), ()),
)


def component_bins() -> list[tuple[str, str, str, float, float]]:
    """feature, component, label (point or range), low and high of every bin."""
    inf = float("inf")
    out = []
    for f, points, bounds in FEATURE_BINS:
        out += [(f, f"{f}[{p}]", "point", float(p), float(p)) for p in points]
        for a, b in zip(bounds, (*bounds[1:], inf)[: len(bounds)], strict=True):
            name = f"{f}[<={b}]" if a == -inf else f"{f}[>{a}]" if b == inf else f"{f}[>{a} & <={b}]"
            out.append((f, name, "range", float(a), float(b)))
        if f == "NC50":
            out.append((f, "NC50[<=2]", "range", -inf, 2.0))
    return out


def count_bins(values: DataFrame, bins: DataFrame) -> DataFrame:
    """sample, component, n of (sample, feature, value) rows over a small table of bins: points are equal, ranges (low, high]."""
    v, b = values.alias("v"), dimension(bins).alias("b")
    hit = (F.col("b.label") == "point") & (F.col("v.value") == F.col("b.low")) | (F.col("b.label") == "range") & (F.col("v.value") > F.col("b.low")) & (F.col("v.value") <= F.col("b.high"))
    return v.join(b, (F.col("v.feature") == F.col("b.feature")) & hit).groupBy("v.sample", "b.component").agg(F.count("*").alias("n"))


def _named(feature: str, value: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), value.cast("double").alias("value"))


def _by_segment(segments: DataFrame, sizes: DataFrame, order: Sequence[str]) -> DataFrame:
    """CN, CNCP, OsCN, SS, BoChr of altered segments and BPArm: windows over (sample, chromosome) only, which share one shuffle and one sort."""
    w, whole = per_chromosome(order), Window.partitionBy("sample", "chromosome")
    v, end = F.col("seg_val"), F.col("end_pos")
    cen = dimension(sizes.select(F.col("chrom").alias("chromosome"), F.col("cen_left").alias("_cl"), F.col("cen_right").alias("_cr")))
    arm = F.coalesce(~((F.col("start_pos") > F.col("_cl")) & (end < F.col("_cr"))), F.lit(False))
    total = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(whole)
    d = segments.select("sample", "chromosome", "start_pos", "end_pos", *order, "seg_val").join(cen, "chromosome", "left")
    d = d.withColumns({
        "_p": F.lag(v, 1).over(w), "_pp": F.lag(v, 2).over(w), "_i": F.row_number().over(w), "_k": F.count("*").over(whole),
        "_n": total(arm), "_q1": total(arm & (end < F.col("_cr"))), "_q2": total(arm & (end > F.col("_cr"))),
    })
    back = F.coalesce((v == F.col("_pp")) & (v != F.col("_p")), F.lit(False))
    d = d.withColumn("_o", F.col("_i") - F.max(F.when(~back, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))  # returns in a row up to here
    d = d.withColumn("_next", F.lead("_o").over(w))
    k, q1, q2 = F.col("_k"), F.col("_q1"), F.col("_q2")
    told = (k >= 3) & (F.col("_i") >= 3) & ((F.col("_next") == 0) | F.col("_next").isNull() & (F.col("_o") > 0))
    one = (F.col("_i") == 1) & (F.col("_n") > 0)
    arm1 = F.when(one, F.when(F.col("_n") < 2, 0).when(q2 == 0, q1 - 1).when(q1 == 0, q2 - 1).otherwise(q1))
    arm2 = F.when(one & (F.col("_n") >= 2) & (q2 != 0) & (q1 != 0), q2 - 1)
    values = F.array(
        _named("CN", v.cast("long")),
        _named("CNCP", F.when(k == 1, 0).otherwise(F.abs(v - F.col("_p"))).cast("long")),
        _named("OsCN", F.when(told, F.col("_o")).when((k < 3) & (F.col("_i") == 1), 0)),
        _named("SS", F.log10(length())),
        _named("BoChr", F.when(v != 2, chromosome_number(F.col("chromosome")))),
        _named("BPArm", arm1),
        _named("BPArm", arm2),
    )
    return d.select("sample", F.inline(values)).where("value IS NOT NULL")  # no lambdas, so that it is compiled


def _by_sample(segments: DataFrame, sizes: DataFrame, order: Sequence[str], bin_size: int = 10_000_000) -> DataFrame:
    """BP10MB, NC50 and the 0 of BoChr: counts by bin, folded to chromosomes and to samples, whose lists are as long as a genome has bins.

    The end of a chromosome's last segment is no breakpoint, so it is taken off its bin.
    """
    place = F.greatest(F.ceil((F.col("end_pos") - 1) / bin_size) - 1, F.lit(0))
    altered = F.sum(F.when(F.col("seg_val") != 2, 1).otherwise(0)).alias("a")
    last = F.max(F.struct("start_pos", *order, "bin"))
    per = segments.withColumn("bin", place).groupBy("sample", "chromosome", "bin").agg(F.count("*").alias("c"), altered, last.alias("last"))
    per = per.groupBy("sample", "chromosome").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("c"), F.sum("a").alias("a"), F.max("last")["bin"].alias("last"))
    dim = dimension(sizes.select(F.col("chrom").alias("chromosome"), (F.floor((F.col("size") + bin_size - 1) / bin_size) - 1).alias("_top")))
    per = per.join(dim, "chromosome", "left")
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_top")), lambda b: F.coalesce(F.try_element_at("c", b), F.lit(0)) - F.when(b == F.col("last"), 1).otherwise(0))
    per = per.select("sample", "a", F.when(F.col("_top").isNull(), F.array().cast("array<bigint>")).otherwise(ends).alias("ends"))
    d = per.groupBy("sample").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.sort_array(F.collect_list("a"), False).alias("a"), F.sum("a").alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("run"))
    more = lambda t, x: F.when(2 * t["run"] >= F.col("all"), t).otherwise(F.struct((t["r"] + 1).alias("r"), (t["run"] + x).alias("run")))
    half = F.aggregate("a", start, more)["r"]  # stays at 0 where nothing is altered
    values = F.concat(F.transform("ends", lambda x: _named("BP10MB", x)), F.array(_named("NC50", half)), F.when(F.col("all") == 0, F.array(_named("BoChr", F.lit(0)))).otherwise(F.array().cast("array<struct<feature:string,value:double>>")))
    return d.select("sample", F.inline(values))


def features_w(segments: DataFrame, sizes: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """sample, feature, value of all eight distributions; sizes (chrom, size, cen_left, cen_right) is a small dimension. SS is log10 of the length.

    The same values as of the functions of each feature, in two reads of the
    segments instead of one or two a feature; values that are null have no row.
    """
    return _by_segment(segments, sizes, order).unionByName(_by_sample(segments, sizes, order))


def burden_by_arm(annotated: DataFrame) -> DataFrame:
    """Segments per chromosome and arm, for distribution tables."""
    return annotated.where(F.col("chromosome").isin(*AUTOSOMES)).groupBy("chromosome", "arm").agg(F.count("*").alias("n"), F.sum(length()).alias("total_length"))
