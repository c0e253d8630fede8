"""Tables behind plots and reports: filters, splits, histograms, highlights, adjusted comparisons and mappings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import tests_of_significance as K
from locusframe.operators import stats as T
from locusframe.operators.intervals import dimension, overlap_join


def selected_segments(segments: DataFrame, samples: Sequence[str] = (), chrs: Sequence[str] = (), region: tuple[str, int, int] | None = None) -> DataFrame:
    """Segments of the samples, on the chromosomes, and within reach of a region (chromosome, start, end); what is not given does not restrict."""
    d = segments.where(F.col("sample").isin(*samples)) if samples else segments
    d = d.where(F.col("chromosome").isin(*chrs)) if chrs else d
    return d if region is None else d.where((F.col("chromosome") == region[0]) & (F.col("start_pos") <= region[2]) & (F.col("end_pos") >= region[1]))


def highlight(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """regions (chrom, start_pos, end_pos) with each gene (chrom, gene_start, gene_end, gene) of their chromosome: highlight names the gene where the region holds it whole. A region without genes on its chromosome has one row."""
    g = dimension(genes.select("chrom", "gene_start", "gene_end", "gene"))
    d = regions.join(g, "chrom", "left")
    whole = (F.col("gene_end") <= F.col("end_pos")) & (F.col("gene_start") >= F.col("start_pos"))
    return d.withColumn("highlight", F.when(whole, F.col("gene"))).drop("gene_start", "gene_end", "gene")


def burden_per_mb(annotated: DataFrame, sizes: DataFrame) -> DataFrame:
    """chromosome, arm, n (segments) and per_mb (segments per million bases of the chromosome)."""
    per = annotated.groupBy("chromosome", "arm").agg(F.count("*").alias("n"))
    return per.join(dimension(sizes.select(F.col("chrom").alias("chromosome"), "size")), "chromosome").select("chromosome", "arm", "n", (F.col("n") * 1e6 / F.col("size")).alias("per_mb"))


def fraction_histogram(annotated: DataFrame, width: float = 0.1) -> DataFrame:
    """bin (its number) and n of the segments' shares of their arms; shares of 1 and more count in the last bin."""
    last = int(round(1 / width)) - 1
    return annotated.groupBy(F.least(F.floor(F.col("fraction") / width), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def without_outliers(values: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Rows (feature, value) within one and a half quartile distances of their feature's quartiles (exact for up to `accuracy` distinct values)."""
    q = values.groupBy("feature").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q"))
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    d = values.join(dimension(q), "feature")
    return d.where((F.col("value") >= F.col("q")[0] - reach) & (F.col("value") <= F.col("q")[1] + reach)).drop("q")


def feature_histogram(values: DataFrame, bins: int = 30, drop_outliers: bool = False) -> DataFrame:
    """feature, bin (0 to bins - 1, over the feature's own range) and n."""
    d = without_outliers(values) if drop_outliers else values
    span = dimension(d.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))).otherwise(0)
    return d.join(span, "feature").groupBy("feature", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def catalogue_profile(catalog: DataFrame, samples: Sequence[str] = ()) -> DataFrame:
    """component and n over all samples, or sample too for the samples named."""
    if samples:
        return catalog.where(F.col("sample").isin(*samples)).groupBy("sample", "component").agg(F.sum("n").alias("n"))
    return catalog.groupBy("component").agg(F.sum("n").alias("n"))


def profile_split(table: DataFrame, mode: str) -> DataFrame:
    """Adds base and context, the panel of a component and its place in the panel. mode: SBS, DBS, ID, W (feature[bin]), CN (classes with colons), RS."""
    c = F.col("component")
    bare = F.regexp_replace(c, "^[TUBNQ]:", "")
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    split = {
        "SBS": (F.regexp_extract(bare, r"\[(.+)\]", 1), F.concat(F.regexp_extract(bare, r"^(\w*)\[", 1), F.substring(F.regexp_extract(bare, r"\[(.+)\]", 1), 1, 1), F.regexp_extract(bare, r"\](\w*)$", 1))),
        "DBS": (F.concat(F.substring(bare, 1, 2), F.lit(">NN")), F.substring(bare, 4, 2)),
        "ID": (F.concat_ws(":", part(bare, 1), part(bare, 2), part(bare, 3)), part(bare, 4)),
        "W": (F.regexp_extract(c, r"^([^\[]+)", 1), F.regexp_extract(c, r"\[(.*)\]$", 1)),
        "CN": (F.concat_ws(":", part(c, 1), part(c, 2)), F.regexp_extract(c, r"^[^:]*:[^:]*:(.*)$", 1)),
        "RS": (F.concat_ws(":", part(c, 1), part(c, 2)), part(c, 3)),
    }
    if mode not in split:
        raise ValueError(f"mode must be one of {', '.join(split)}")
    base, context = split[mode]
    return table.withColumns({"base": base, "context": context})


def signed_log_p(enriched: DataFrame, p: str = "fdr") -> DataFrame:
    """Rows of an enrichment (measure_observed or measure1 and measure2) with p_value_up, |log10 p| with the sign of the effect, and p_bin; the least positive double stands in for p = 0."""
    seen = F.col("measure_observed") if "measure_observed" in enriched.columns else F.when(F.col("measure2") != 0, F.col("measure1") / F.col("measure2"))
    size = F.abs(F.log10(F.when(F.col(p) == 0, 2.2250738585072014e-308).otherwise(F.col(p))))
    bin_ = F.when(F.col(p) < 0.001, "< 0.001").when(F.col(p) < 0.01, "< 0.01").when(F.col(p) < 0.05, "< 0.05").when(F.col(p).isNotNull(), ">= 0.05")
    return enriched.withColumns({"p_value_up": F.when(seen >= 1, size).otherwise(-size), "p_bin": bin_})


def mapping_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lodes form of how rows map over columns: alluvium (a combination of values), n (its rows), axis and stratum, one row per combination and column."""
    d = df.groupBy(*columns).agg(F.count("*").alias("n"))
    combined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    lodes = F.inline(F.array(*[F.struct(F.lit(c).alias("axis"), F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("stratum")) for c in columns]))
    return d.select(combined.alias("alluvium"), "n", lodes)


def adjusted_pairs(df: DataFrame, value: str, group: str, method: str = "wilcox", comparisons: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """g1, g2, n1, n2, statistic, p_value, p_adj (Benjamini-Hochberg over all pairs of groups) and y_position, the height of a pair's label; only the comparisons if any are named."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"))
    groups = sorted(r["g"] for r in d.select("g").distinct().limit(1001).collect())
    if len(groups) > 1000:
        raise ValueError("over 1000 groups have too many pairs")
    if method == "wilcox":
        cells = d.groupBy("g", "x").agg(F.count("*").alias("c"))
        others = F.explode(F.array(*map(F.lit, groups))).alias("h")  # a cell meets the pairs of its own group
        pair = cells.select("*", others).where("g <> h").select("g", "x", "c", F.least("g", "h").alias("g1"), F.greatest("g", "h").alias("g2"))
        per = pair.groupBy("g1", "g2", "x").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("g") == F.col("g1"), F.col("c")).otherwise(0)).alias("c1"))
        r = T.value_ranks(per, "x", ["g1", "g2"])
        n1, n2, c = F.sum("c1"), F.sum(F.col("c") - F.col("c1")), F.col("c")
        a = r.groupBy("g1", "g2").agg(n1.alias("n1"), n2.alias("n2"), (F.sum(F.col("c1") * F.col("rank")) - n1 * (n1 + 1) / 2).alias("statistic"), F.sum(c * (c * c - 1)).alias("ties"))
        p = T.kernel(lambda w, x, y, t: K.rank_sum(w, int(x), int(y), t), F.col("statistic"), F.col("n1"), F.col("n2"), F.col("ties").cast("double"))
        a = a.withColumn("p_value", p).drop("ties")
    elif method == "t":
        per = d.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
        x, y = per.toDF("g1", "n1", "m1", "v1"), per.toDF("g2", "n2", "m2", "v2")
        a = T.welch_columns(x.join(y, F.col("g1") < F.col("g2"))).select("g1", "g2", "n1", "n2", F.col("t").alias("statistic"), "p_value")
    else:
        raise ValueError("method must be wilcox or t")
    a = T.bh_adjust(a, "p_value", out="p_adj")
    if comparisons:
        a = a.where(F.concat_ws("|", "g1", "g2").isin(*["|".join(sorted(c)) for c in comparisons]))
    most = d.agg(F.max("x").alias("_top"))
    step = F.row_number().over(Window.orderBy("g1", "g2"))  # a row per pair of group names
    return a.withColumn("_k", step).crossJoin(F.broadcast(most)).withColumn("y_position", F.col("_top") * (1 + F.col("_k") / 10)).drop("_k", "_top")


def contingency_p(df: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 1) -> float | None:
    """p value of independence of two columns: Fisher's exact test for two by two values, otherwise the share of `draws` random tables with the same margins that are as unlikely. None with one value only. The table of counts, not the rows, reaches the driver; it may have 10,000 cells."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).count().limit(10_001).toPandas()
    if len(rows) > 10_000:
        raise ValueError("the table has over 10,000 cells")
    t = rows.pivot(index="a", columns="b", values="count").fillna(0).sort_index().sort_index(axis=1).to_numpy(np.int64)
    if min(t.shape, default=0) < 2:
        return None
    if t.shape == (2, 2):
        return float(K.fisher_many([t[0, 0]], [t[0, 1]], [t[1, 0]], [t[1, 1]])[0])
    rng, own = np.random.default_rng(seed), -K.log_factorial(t).sum()
    hits = 0
    for _ in range(draws):
        left, drawn = t.sum(axis=0), 0.0
        for n in t.sum(axis=1)[:-1]:
            row = rng.multivariate_hypergeometric(left, n, method="marginals")
            drawn -= K.log_factorial(row).sum()
            left = left - row
        hits += drawn - K.log_factorial(left).sum() <= own + 1e-7 * abs(own)
    return float((hits + 1) / (draws + 1))


def cluster_means(signatures: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, component and weight (mean over the signatures of a cluster), from (sig, component, weight) and (sig, cluster)."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    d = signatures.join(clusters, "sig").groupBy("cluster", "component").agg(F.sum("weight").alias("_s"))
    return d.join(dimension(n), "cluster").select("cluster", "component", (F.col("_s") / F.col("_n")).alias("weight"))


def similarity_to_mean(signatures: DataFrame, clusters: DataFrame) -> DataFrame:
    """sig, cluster and the cosine between a signature and its cluster's mean."""
    mean = cluster_means(signatures, clusters).withColumnRenamed("weight", "_y")
    x = signatures.join(clusters, "sig").join(mean, ["cluster", "component"], "left")
    norm = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("_y") * F.col("_y"))).alias("_m"))
    d = x.groupBy("sig", "cluster").agg(F.sum(F.col("weight") * F.col("_y")).alias("_d"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    return d.join(norm, "cluster").select("sig", "cluster", (F.col("_d") / (F.col("_n") * F.col("_m"))).alias("cosine"))


def allowed_signatures(relative: DataFrame, classes: DataFrame | None = None, cutoff: float = 0.05, least: int = 5) -> DataFrame:
    """sample, sig and flag: 1 if the signature may be in the sample, 2 if it is tried as a global one only.

    A signature is allowed in a sample whose share of it (rel) exceeds cutoff,
    and in all samples of a class (sample, cls) in which more than `least`
    samples have it so. Without classes, or with one, all are allowed.
    """
    if classes is None or classes.select("cls").distinct().count() <= 1:
        return relative.select("sample", "sig", F.lit(1).alias("flag"))
    d = relative.join(classes.select("sample", "cls"), "sample", "left")
    own = F.when(F.col("rel") > cutoff, 1).otherwise(0)
    many = F.sum(own).over(Window.partitionBy("cls", "sig")) > least
    return d.select("sample", "sig", F.when((own == 1) | (many & F.col("cls").isNotNull()), 1).otherwise(2).alias("flag"))


def segment_size_order(signatures: DataFrame) -> DataFrame:
    """sig and place: copy-number signatures ordered by the segment-size bin (SS[...]) in which they weigh most, smaller sizes first; those without come last, by name."""
    low = F.coalesce(F.regexp_extract("component", r"^SS\[>([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    size = signatures.where("component LIKE 'SS[%'").groupBy("sig").agg(F.max_by(low, F.struct("weight", -low)).alias("_low"))
    d = signatures.select("sig").distinct().join(size, "sig", "left")
    return d.select("sig", F.row_number().over(Window.orderBy(F.col("_low").asc_nulls_last(), "sig")).alias("place"))  # one row per signature


def group_profile(segments: DataFrame, bands: DataFrame, group: str, amp_over: float = 2, del_under: float = 2) -> DataFrame:
    """Group, chrom, band, n_amp and n_del: samples of each group with a segment over or under the bounds that reaches into the band; bands that no segment of a group reaches have no row.

    A sample is settled per band first, so the counts need no distinct. The
    group is a column of the segments; rows without one are a group of their own.
    """
    s = segments.select(group, "sample", "chromosome", "start_pos", "end_pos", "seg_val")
    b = bands.select("chrom", F.col("start_pos").alias("_bs"), F.col("end_pos").alias("_be"), "band")
    hit = overlap_join(s, b, ("chromosome", "start_pos", "end_pos"), ("chrom", "_bs", "_be"))
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    each = hit.groupBy(group, "chrom", "band", "sample").agg(flag(F.col("seg_val") > amp_over).alias("_a"), flag(F.col("seg_val") < del_under).alias("_d"))
    named = F.col("sample").isNotNull().cast("int")
    return each.groupBy(group, "chrom", "band").agg(F.sum(F.col("_a") * named).alias("n_amp"), F.sum(F.col("_d") * named).alias("n_del"))


def exposure_table(exposure: DataFrame, value: str = "amount", min_total: float | None = None) -> DataFrame:
    """sample, sig, value, fraction (of the sample's total; null where that is 0) and total; samples under min_total go."""
    total = F.sum(value).over(Window.partitionBy("sample"))
    d = exposure.select("sample", "sig", value, total.alias("total"))
    d = d if min_total is None else d.where(F.col("total") >= min_total)
    return d.select("sample", "sig", value, F.when(F.col("total") != 0, F.col(value) / F.col("total")).alias("fraction"), "total")


def group_distribution(df: DataFrame, group: str, value: str, key: str, block: int = 100_000) -> DataFrame:
    """group, key, value, place and n: each row's place by value (then key) among the rows of its group that have a value, and their number.

    A group is placed in parts of the value's range between quantiles of all
    rows, about `block` rows each (1000 parts at most), so a group that holds
    most rows is not sorted in one task; equal values share a part.
    """
    d = df.where(F.col(value).isNotNull()).select(group, key, value)
    n = d.count()
    parts = min(-(-n // block), 1000)
    cuts = sorted(set(d.approxQuantile(value, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    d = d.withColumn("_p", T._block(value, cuts) if cuts else F.lit(0).cast("long"))
    sizes = d.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    inner = F.row_number().over(Window.partitionBy(group, "_p").orderBy(value, key))
    placed = d.withColumn("_i", inner).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return placed.select(group, key, value, (F.col("_before") + F.col("_i")).cast("int").alias("place"), "n")
