"""One entry to all catalogues: segments, rearrangements or small variants in, named catalogues in long form out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import classify as K
from locusframe.operators import rearrangements as R
from locusframe.operators import variants as V
from locusframe.operators.intervals import dimension
from locusframe.operators.segments import ORDER, normalize_chromosome, require_columns

# Classifications of variants that change a protein.
NON_SYNONYMOUS = (
    "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "Translation_Start_Site", "Nonsense_Mutation", "Nonstop_Mutation", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation",
)
METHODS = ("W", "T", "X", "S")
MODES = ("SBS", "DBS", "ID", "ALL")


def tally_segments(segments: DataFrame, method: str = "W", ignore_chrs: Sequence[str] = (), indices: Sequence[int] | None = None, with_loh: bool = False, sizes: DataFrame | None = None, bins: DataFrame | None = None, order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Catalogues of copy-number segments.

    W: bins of eight feature distributions (sizes needed; bins as from
    classify.component_bins unless given); T: cn_t_standard, cn_t_simplified
    and, with n_near from self_flank, cn_t_complex; X: cn_x_standard and
    cn_x_simplified; S: cn40 and cn48. indices keeps the segments whose column
    `index` is among them, after neighbours have been looked at. ignore_chrs
    leaves chromosomes out from the start.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    d = segments.where(~F.col("chromosome").isin(*ignore_chrs)) if ignore_chrs else segments
    if indices is not None:
        require_columns(d, "index")
        if method == "W":
            raise ValueError("indices need classes of single segments: T, X or S")
    kept = (lambda x: x) if indices is None else (lambda x: x.where(F.col("index").isin(*indices)))
    if method == "W":
        if sizes is None:
            raise ValueError("sizes are needed for method W")
        if bins is None:
            bins = d.sparkSession.createDataFrame(K.component_bins(), "feature string, component string, label string, low double, high double")
        return {"cn_w": K.count_bins(K.features_w(d, sizes, order), bins)}
    if method == "S":
        d = kept(K.label_40_48(d))
        return {"cn48": K.count_components(d, "cn48"), "cn40": K.count_components(d, "cn40")}
    if method == "X":
        d = kept(K.label_x(d, order, with_loh))
        return {"cn_x_standard": K.count_components(d, "x_standard"), "cn_x_simplified": K.count_components(d, "x_simple")}
    d = kept(K.label_t(d, order, with_loh))
    out = {"cn_t_standard": K.count_components(d, "t_standard"), "cn_t_simplified": K.count_components(d, "t_simple")}
    return out | ({"cn_t_complex": K.count_components(d, "t_complex")} if "t_complex" in d.columns else {})


def tally_rearrangements(sv: DataFrame, row_id: Sequence[str], regions: DataFrame | None = None, factor: float = 0.1) -> dict[str, DataFrame]:
    """rs38 and rs32 of structural rearrangements; row_id is not needed any more."""
    d = R.label_size(R.clean(sv))
    if regions is None:
        c = R.rs_catalogue(d, partial(R.by_segments, factor=factor))
        return {"rs38": c, "rs32": R.without_smallest(c)}
    d = R.label_rs(R.label_clustered(d, list(row_id), factor, regions))
    return {"rs38": K.count_components(d, "rs38"), "rs32": K.count_components(d, "rs32")}


def tally_variants(variants: DataFrame, mode: str = "ALL", add_trans_bias: bool = False, transcripts: DataFrame | None = None, ignore_chrs: Sequence[str] = (), use_syn: bool = True, order: Sequence[str] = ("ref", "alt"), sizes: DataFrame | None = None, apobec: bool = False) -> dict[str, DataFrame]:
    """Catalogues of small variants (sample, chrom, pos, ref, alt).

    SBS needs context, ID needs upstream and downstream; with mode ALL the modes
    whose columns are there are made. add_trans_bias adds the catalogues with
    strand labels (T, U, B, N, and Q for classes without a strand). use_syn =
    False keeps NON_SYNONYMOUS classifications only. Alleles that are null go, and with sizes
    (chrom) chromosomes that the genome lacks. apobec adds a table apobec beside
    the SBS catalogues, as of variants.apobec_test; order tells equal positions
    apart where doublets are looked for.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if add_trans_bias and transcripts is None:
        raise ValueError("transcripts are needed for strand labels")
    d = variants.where("ref IS NOT NULL AND alt IS NOT NULL").withColumn("chrom", normalize_chromosome(F.col("chrom")))
    if ignore_chrs:
        d = d.where(~F.col("chrom").isin(*ignore_chrs))
    if sizes is not None:
        d = d.join(dimension(sizes.select("chrom").distinct()), "chrom", "left_semi")
    if not use_syn:
        require_columns(d, "classification")
        d = d.where(F.col("classification").isin(*NON_SYNONYMOUS))
    has = set(variants.columns)
    out: dict[str, DataFrame] = {}

    def add(labelled: DataFrame, names: Mapping[str, str], end: str | None = None) -> None:
        for label, name in names.items():
            out[name] = K.count_components(labelled, label)
        if add_trans_bias:
            # only what the catalogues need is looked up, so that equal rows are one and the rest is not shuffled
            need = {"sample", "chrom", "pos", end, "should_reverse", "pure", *names}
            told = V.strand_label(labelled.select(*[c for c in labelled.columns if c in need]), transcripts, end)
            for label, name in names.items():
                out[f"{name}_strand"] = K.count_components(V.with_strand(told, label), f"{label}_strand")

    single = (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != "-") & (F.col("alt") != "-")
    if mode == "SBS" or mode == "ALL" and "context" in has:
        require_columns(d, "context")
        add(V.label_sbs(d.where(single)), {"sbs96": "sbs96", "sbs6": "sbs6", "sbs1536": "sbs1536"})
        if apobec:
            out["apobec"] = V.apobec_test(V.apobec_counts(d.where(single)))
    elif apobec:
        raise ValueError("apobec needs SBS catalogues")
    if mode in ("DBS", "ALL"):
        pairs = V.find_doublets(d.where(single), order)
        own = d.where((F.length("ref") == 2) & (F.length("alt") == 2)).select("sample", "chrom", "pos", "ref", "alt")
        add(V.label_dbs(pairs.unionByName(own)).withColumn("end_pos", F.col("pos") + 1), {"dbs78": "dbs78"}, "end_pos")
    if mode == "ID" or mode == "ALL" and {"upstream", "downstream"} <= has:
        require_columns(d, "upstream", "downstream")
        longer = d.where((F.length("ref") != F.length("alt")) | (F.col("ref") == "-") | (F.col("alt") == "-"))
        add(V.label_indels(longer).withColumn("end_pos", F.greatest("end_pos", "pos")), {"id83": "id83", "id28": "id28"}, "end_pos")
    return out


def tally(data: DataFrame, kind: str, **options) -> dict[str, DataFrame]:
    """Catalogues of data of a kind: segments, rearrangements or variants; options as in the function of that kind."""
    kinds = {"segments": tally_segments, "rearrangements": tally_rearrangements, "variants": tally_variants}
    if kind not in kinds:
        raise ValueError(f"kind must be one of {', '.join(kinds)}")
    return kinds[kind](data, **options)
