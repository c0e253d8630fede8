"""Small variants: types, substitution, doublet and indel classes, strand labels and APOBEC counts.

A variant table has sample, chrom, pos, ref and alt; context is the reference
sequence of five bases around pos. All classes are expressions on the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
SBS_96 = tuple(f"{a}[{s}]{b}" for s, a, b in product(SUBSTITUTIONS, BASES, BASES))


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when(r < a, "INS").when(r > a, "DEL").when((r == 2) & (a == 2), "DNP").when((r == 3) & (a == 3), "TNP").otherwise("Unknown")


def reverse_complement(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def label_sbs(variants: DataFrame) -> DataFrame:
    """sbs6, sbs96 and sbs1536 of single-base substitutions, written from the pyrimidine of the pair; null for anything else."""
    sub = F.concat("ref", F.lit(">"), "alt")
    turned = F.col("ref").isin("A", "G")
    folded = F.when(turned, F.translate(sub, "ACGT", "TGCA")).otherwise(sub)
    ctx = F.when(turned, reverse_complement(F.col("context"))).otherwise(F.col("context"))
    d = variants.withColumns({"_sub": F.when(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt")), folded), "_ctx": ctx})
    part = lambda i, n: F.substring("_ctx", i, n)
    boxed = F.concat(F.lit("["), "_sub", F.lit("]"))
    return d.withColumns({"sbs6": F.col("_sub"), "sbs96": F.concat(part(2, 1), boxed, part(4, 1)), "sbs1536": F.concat(part(1, 2), boxed, part(4, 2)), "should_reverse": turned}).drop("_sub", "_ctx")


# The classes of doublets with both bases changed, by their reference pair.
DOUBLETS = {
    "AC": ("CA", "CG", "CT", "GA", "GG", "GT", "TA", "TG", "TT"),
    "AT": ("CA", "CC", "CG", "GA", "GC", "TA"),
    "CC": ("AA", "AG", "AT", "GA", "GG", "GT", "TA", "TG", "TT"),
    "CG": ("AT", "GC", "GT", "TA", "TC", "TT"),
    "CT": ("AA", "AC", "AG", "GA", "GC", "GG", "TA", "TC", "TG"),
    "GC": ("AA", "AG", "AT", "CA", "CG", "TA"),
    "TA": ("AT", "CG", "CT", "GC", "GG", "GT"),
    "TC": ("AA", "AG", "AT", "CA", "CG", "CT", "GA", "GG", "GT"),
    "TG": ("AA", "AC", "AT", "CA", "CC", "CT", "GA", "GC", "GT"),
    "TT": ("AA", "AC", "AG", "CA", "CC", "CG", "GA", "GC", "GG"),
}
DBS_78 = tuple(f"{r}>{a}" for r, changed in DOUBLETS.items() for a in changed)


def doublet_pairs() -> dict[str, str]:
    """Class of each doublet, in either strand's writing."""
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = {}
    for name in DBS_78:
        r, a = name.split(">")
        out[f"{turn(r)}>{turn(a)}"] = name
    return out | {name: name for name in DBS_78}


def find_doublets(variants: DataFrame, order: Sequence[str] = ("t1", "t2", "t3", "t4")) -> DataFrame:
    """Neighbouring substitutions of a sample as doublets: sample, chrom, pos (of the first), ref, alt of two bases.

    Every pair of adjacent positions gives one doublet, three in a row two. Of
    several substitutions at one position the first by `order` counts.
    """
    snv = variants.where((F.length("ref") == 1) & (F.length("alt") == 1))
    one = snv.groupBy("sample", "chrom", "pos").agg(F.min_by(F.struct("ref", "alt"), F.struct(*order)).alias("x"))
    w = Window.partitionBy("sample", "chrom").orderBy("pos")
    d = one.withColumns({"_next": F.lead("pos").over(w), "_y": F.lead("x").over(w)}).where(F.col("_next") == F.col("pos") + 1)
    return d.select("sample", "chrom", "pos", F.concat("x.ref", "_y.ref").alias("ref"), F.concat("x.alt", "_y.alt").alias("alt"))


def label_dbs(doublets: DataFrame) -> DataFrame:
    """dbs78 of each doublet, should_reverse and pure (a reference pair of pyrimidines); dbs1248 too if upstream and downstream hold the flanking bases. Null unless both bases change."""
    pairs = F.create_map(*[F.lit(x) for kv in doublet_pairs().items() for x in kv])
    d = doublets.withColumn("dbs78", F.try_element_at(pairs, F.concat("ref", F.lit(">"), "alt")))
    first = F.substring("dbs78", 1, 2)
    d = d.withColumns({"should_reverse": first != F.col("ref"), "pure": F.coalesce(first.isin("TT", "TC", "CT", "CC"), F.lit(False))})
    if "upstream" in doublets.columns:
        d = d.withColumn("dbs1248", F.concat("upstream", F.lit("["), "dbs78", F.lit("]"), "downstream"))
    return d


def trim_indels(indels: DataFrame) -> DataFrame:
    """The common beginning of ref and alt cut off, pos moved behind it; an empty allele is written as a dash."""
    shorter = F.least(F.length("ref"), F.length("alt"))
    common = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), shorter), lambda k: F.upper(F.substring("ref", F.lit(1), k)) == F.upper(F.substring("alt", F.lit(1), k)))), F.lit(0))
    d = indels.withColumn("_c", common)
    rest = lambda c: F.expr(f"substring({c}, _c + 1)")
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    d = d.withColumns({"pos": F.col("pos") + F.col("_c"), "ref": dash(rest("ref")), "alt": dash(rest("alt"))})
    return d.withColumn("end_pos", F.col("pos") + F.length("ref") - 1).drop("_c")


def repeats(unit: Column, sequence: Column, downstream: bool = True, cap: int | None = None) -> Column:
    """Number of copies of unit that follow one another at the start of sequence, or at its end; counted up to cap where only the lower numbers matter."""
    n = F.length(unit)
    if cap is not None:  # k copies begin with k - 1 copies, so the number of fitting k is the greatest
        fits = F.startswith if downstream else F.endswith
        return F.when(n > 0, _times([fits(sequence, F.repeat(unit, F.lit(k))) for k in range(1, cap + 1)])).otherwise(0)
    most = F.floor(F.length(sequence) / n).cast("int")
    piece = (lambda k: F.substr(sequence, F.lit(1), k * n)) if downstream else (lambda k: F.substr(sequence, F.length(sequence) - k * n + 1, k * n))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: piece(k) == F.repeat(unit, k))
    return F.when((n > 0) & (most > 0), F.array_max(fits)).otherwise(0)


def _times(conditions: Sequence[Column]) -> Column:
    """How many conditions hold; null counts as false."""
    ones = [F.when(c, 1).otherwise(0) for c in conditions]
    return sum(ones[1:], ones[0])


def homology(unit: Column, upstream: Column, downstream: Column, cap: int | None = None) -> Column:
    """Longest proper beginning of unit at the start of downstream, or proper end of it at the end of upstream; measured up to cap where only the lower numbers matter."""
    n = F.length(unit)
    if cap is not None:
        down = _times([(n > k) & F.startswith(downstream, F.substr(unit, F.lit(1), F.lit(k))) for k in range(1, cap + 1)])
        up = _times([(n > k) & F.endswith(upstream, F.substr(unit, n - k + 1, F.lit(k))) for k in range(1, cap + 1)])
        return F.greatest(down, up)
    sizes = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    down = F.array_max(F.filter(sizes, lambda k: F.startswith(downstream, F.substr(unit, F.lit(1), k))))
    up = F.array_max(F.filter(sizes, lambda k: F.endswith(upstream, F.substr(unit, n - k + 1, k))))
    return F.when(n >= 2, F.greatest(F.coalesce(down, F.lit(0)), F.coalesce(up, F.lit(0)))).otherwise(0)


def label_indels(indels: DataFrame) -> DataFrame:
    """id83 and id28 of indels with upstream and downstream sequence; id83 is null for complex ones. pure: the inserted or deleted bases are all purines or all pyrimidines, should_reverse: purines."""
    d = trim_indels(indels)
    complex_ = (F.col("ref") != "-") & (F.col("alt") != "-")
    d = d.withColumns({"_kind": F.when(F.col("ref") == "-", "Ins").otherwise("Del"), "_unit": F.when(F.col("ref") == "-", F.col("alt")).otherwise(F.col("ref")), "_complex": complex_})
    unit = F.col("_unit")
    d = d.withColumns({
        "id_len": F.least(F.length(unit), F.lit(5)), "n_repeat": F.least(repeats(unit, F.col("downstream"), cap=5) + repeats(unit, F.col("upstream"), False, 5), F.lit(5)),
        "n_homology": homology(unit, F.col("upstream"), F.col("downstream"), 5),
    })
    first = F.translate(F.substring("_unit", 1, 1), "AG", "TC")
    base = F.when(F.col("id_len") == 1, first).when((F.col("_kind") == "Del") & (F.col("n_repeat") == 0) & (F.col("n_homology") > 0), "M").otherwise("R")
    d = d.withColumn("_base", base)
    count = F.when(F.col("_base") == "M", F.col("n_homology")).otherwise(F.col("n_repeat"))
    name = F.concat_ws(":", F.col("id_len").cast("string"), "_kind", "_base", count.cast("string"))
    short = F.when(F.col("id_len") == 1, name).when(F.col("_base") == "M", "MH").when(F.col("_kind") == "Del", "long_Del").otherwise("long_Ins")
    turned = unit.rlike("^[AG]+$")
    d = d.withColumns({"should_reverse": turned, "pure": turned | unit.rlike("^[CT]+$")})
    return d.withColumns({"id83": F.when(~F.col("_complex"), name), "id28": F.when(F.col("_complex"), "complex").otherwise(short)}).drop("_kind", "_unit", "_base", "_complex")


ID_83 = (
    *(f"1:{k}:{b}:{n}" for k, b, n in product(("Del", "Ins"), "CT", range(6))),
    *(f"{m}:{k}:R:{n}" for k, m, n in product(("Del", "Ins"), (2, 3, 4, 5), range(6))),
    *(f"{m}:Del:M:{n}" for m in (2, 3, 4, 5) for n in range(1, 6 if m == 5 else m)),
)


def strand_label(variants: DataFrame, transcripts: DataFrame, end: str | None = None) -> DataFrame:
    """strand_label of each variant with should_reverse: B on both strands, T or U on one, N outside transcripts; Q if a column pure says that its bases have no strand.

    The transcripts (chrom, start_pos, end_pos, strand) are cut into disjoint
    stretches that know their strands. A position lies in one at most, so a
    variant is looked up once and no row is put together again; with `end`, the
    last position of a longer variant, all stretches that it meets count.
    """
    from locusframe.operators.intervals import covered, overlap_join

    t = transcripts.select(F.col("chrom").alias("_tc"), F.col("start_pos").alias("_ts"), F.col("end_pos").alias("_te"), F.col("strand").alias("_st"))
    runs = covered(t, "_tc", "_ts", "_te", {"_plus": F.col("_st") == "+", "_minus": F.col("_st") == "-"})
    if end is None:
        d = overlap_join(variants, runs, ("chrom", "pos", "pos"), ("_tc", "_ts", "_te"), "left")
    else:
        # equal rows are looked up once and told apart by their number only, so a repeated task cannot name rows otherwise
        own = [F.col(f"`{c}`") for c in variants.columns]
        hit = overlap_join(variants.groupBy(*own).agg(F.count("*").cast("int").alias("_times")), runs, ("chrom", "pos", end), ("_tc", "_ts", "_te"), "left")
        d = hit.groupBy(*own, "_times").agg(F.max("_tc").alias("_tc"), F.max("_plus").alias("_plus"), F.max("_minus").alias("_minus"))
        d = d.withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_times")
    one = F.when(F.col("should_reverse") != F.col("_minus"), "T").otherwise("U")
    label = F.when(F.col("_tc").isNull(), "N").when(F.col("_plus") & F.col("_minus"), "B").otherwise(one)
    if "pure" in variants.columns:
        label = F.when(F.col("pure"), label).otherwise("Q")
    return d.withColumn("strand_label", label).drop("_tc", "_ts", "_te", "_plus", "_minus")


def apobec_counts(variants: DataFrame) -> DataFrame:
    """Per sample the counts behind the APOBEC enrichment and the enrichment itself.

    window holds the sequence around the mutation; without it, context serves.
    Background bases and motifs are counted over C>T and C>G mutations only.
    """
    d = label_sbs(variants)
    around = F.col("window") if "window" in variants.columns else F.col("context")
    target = F.col("sbs6").isin("C>T", "C>G")
    times = lambda s: F.size(F.split(around, s, -1)) - 1
    tcw = F.col("sbs96").rlike(r"^T\[C>[GT]\][AT]$")
    n = lambda p: F.sum(F.when(p, 1).otherwise(0)).cast("long")
    bg = lambda *motifs: F.sum(F.when(target, sum((times(m) for m in motifs[1:]), times(motifs[0]))).otherwise(0)).cast("long")
    a = d.where("sbs6 IS NOT NULL").groupBy("sample").agg(
        F.count("*").alias("n_mutations"), n(target).alias("n_c_to_gt"), n(tcw).alias("n_tcw"), bg("TCA", "TCT").alias("bg_tcw"), bg("TGA", "AGA").alias("bg_wga"), bg("C").alias("bg_c"), bg("G").alias("bg_g")
    )
    ratio = lambda x, y: F.when(F.col(y) != 0, F.col(x) / F.col(y)) if isinstance(y, str) else F.when(y != 0, x / y)
    back = (F.col("bg_tcw") + F.col("bg_wga")) / (F.col("bg_c") + F.col("bg_g"))
    a = a.withColumn("enrichment", ratio(ratio("n_tcw", "n_c_to_gt"), F.when(F.col("bg_c") + F.col("bg_g") > 0, back)))
    return a.withColumns({"fraction": F.round(F.col("n_tcw") / F.col("n_mutations"), 3), "enriched": F.col("enrichment") > 2})


def apobec_test(counts: DataFrame) -> DataFrame:
    """p_value (one-sided Fisher: motif mutations among C>T and C>G against motifs among background bases) and fdr of the rows of apobec_counts."""
    from locusframe.operators.stats import bh_adjust, fisher_p

    motif, bases = F.col("bg_tcw") + F.col("bg_wga"), F.col("bg_c") + F.col("bg_g")
    cells = (F.col("n_tcw"), F.col("n_c_to_gt") - F.col("n_tcw"), motif, F.greatest(bases - motif, F.lit(0)))
    return bh_adjust(counts.withColumn("p_value", fisher_p(*[c.cast("double") for c in cells], alternative="greater")), "p_value")


def with_strand(labelled: DataFrame, label: str, kept: Sequence[str] = ("T", "U", "B", "N", "Q")) -> DataFrame:
    """Adds label_strand: the strand label before the class, for the labels kept (T and U alone give the smaller catalogues)."""
    name = F.concat_ws(":", F.col("strand_label"), F.col(label))
    return labelled.withColumn(f"{label}_strand", F.when(F.col(label).isNotNull() & F.col("strand_label").isin(*kept), name))
