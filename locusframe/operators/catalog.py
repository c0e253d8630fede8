"""Catalogues, signatures and exposures in long form: (sample, component, n), (sig, component, weight), (sample, sig, amount)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import settled
from locusframe.operators.intervals import dimension


def share(value: str, *by: str) -> Column:
    """value over its sum within the columns `by`; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total != 0, F.col(value) / total).otherwise(0.0)


def normalize(df: DataFrame, value: str, by: Sequence[str], out: str = "weight") -> DataFrame:
    """Shares within `by`: a key for signatures (by sig), for components (by component), or a feature and a signature."""
    return df.withColumn(out, share(value, *by))


def feature_of(component: Column) -> Column:
    """Feature of a component name such as CN[2] or CN[>8]."""
    return F.regexp_extract(component, r"^([^\[]+)", 1)


def hyper_split(catalog: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Samples whose total exceeds median + 1.5 IQR split in two halves, until none does.

    A part is total / 2**k. How often a sample has been halved follows from its
    total and the limits of the rounds before, so a round is one aggregate over
    the totals and nothing is joined; only the limits are kept. Raises if some
    total still exceeds the limit after max_rounds.
    """
    totals = settled(catalog.groupBy("sample").agg(F.sum("n").cast("double").alias("total")))
    limits: list[float] = []

    def halvings() -> Column:
        zero = F.lit(0)
        if not limits:
            return zero
        return F.aggregate(F.array(*[F.lit(x) for x in limits]), zero, lambda k, x: F.when(F.col("total") / F.pow(F.lit(2.0), k) > x, k + 1).otherwise(k))

    for _ in range(max_rounds):
        # each sample stands 2**k times in the distribution of totals
        weighted = totals.withColumn("k", halvings()).withColumns({"x": F.col("total") / F.pow(F.lit(2.0), F.col("k")), "times": F.pow(F.lit(2), F.col("k")).cast("long")})
        r = weighted.agg(F.expr("percentile(x, array(0.25, 0.5, 0.75), times)").alias("q"), F.max("x").alias("most")).first()
        if r["q"] is None:
            break
        q = r["q"]
        limit = q[1] + 1.5 * (q[2] - q[0])
        if r["most"] <= limit:
            break
        limits.append(limit)
    else:
        raise ValueError(f"totals still exceed the limit after {max_rounds} rounds")
    d = catalog.join(totals.select("sample", halvings().alias("k")), "sample")
    part = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("k")).cast("int"))).alias("part")
    d = d.select("sample", "component", "n", "k", part)
    name = F.when(F.col("k") > 0, F.concat("sample", F.lit("_[hyper]_"), F.col("part").cast("string"))).otherwise(F.col("sample"))
    return d.select(name.alias("sample"), "component", (F.col("n") / F.pow(F.lit(2.0), F.col("k"))).alias("n"))


def hyper_collapse(catalog: DataFrame, value: str = "n", keys: Sequence[str] = ("component",)) -> DataFrame:
    """Halves of split samples summed again."""
    return catalog.groupBy(F.element_at(F.split("sample", r"_\[hyper\]_"), 1).alias("sample"), *keys).agg(F.sum(value).alias(value))


def relative_exposure(exposure: DataFrame, threshold: float = 0.0) -> DataFrame:
    """sample, sig, rel: shares of a sample's exposure, those up to the threshold as 0; samples without exposure are absent."""
    d = exposure.withColumn("_t", F.sum("amount").over(Window.partitionBy("sample"))).where("_t != 0")
    rel = F.col("amount") / F.col("_t")
    return d.select("sample", "sig", F.when(rel <= threshold, 0.0).otherwise(rel).alias("rel"))


def shannon_diversity(relative: DataFrame, cutoff: float = 0.001) -> DataFrame:
    x = F.col("rel")
    return relative.groupBy("sample").agg(F.sum(F.when(x > cutoff, -x * F.ln(x)).otherwise(0.0)).alias("diversity"))


def signature_order(exposure: DataFrame) -> DataFrame:
    """sig, total and place: signatures by total exposure, the largest first."""
    t = exposure.groupBy("sig").agg(F.sum("amount").alias("total"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "sig")))  # one row per signature


def convert_opportunities(signature: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Weights times the ratio of opportunities (component, n) of two sequences, as shares again."""
    f, t = dimension(source.select("component", F.col("n").alias("_f"))), dimension(target.select("component", F.col("n").alias("_t")))
    d = signature.join(f, "component").join(t, "component").withColumn("_w", F.col("weight") * F.col("_t") / F.col("_f"))
    return d.select("sig", "component", share("_w", "sig").alias("weight"))


def simulate_signature(catalog: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the samples' shares: component, weight. weights is (sample, w); samples without count 1 each."""
    d = catalog.withColumn("_p", share("n", "sample"))
    d = d.join(weights.select("sample", F.col("w").alias("_w")), "sample") if weights is not None else d.withColumn("_w", F.lit(1.0))
    # components that a sample lacks count 0 for it, so the divisor is the weight of all samples
    whole = d.select("sample", "_w").distinct().agg(F.sum("_w").alias("_all"))
    return d.groupBy("component").agg(F.sum(F.col("_w") * F.col("_p")).alias("_s")).crossJoin(F.broadcast(whole)).select("component", (F.col("_s") / F.col("_all")).alias("weight"))


#: Keys of the second side of an all-pairs comparison at most: signatures, not samples without number.
MOST_KEYS = 10_000


def _few(keys: DataFrame) -> DataFrame:
    """keys to be broadcast; raises if there are more than MOST_KEYS, as the result has a row for each of them and each key of the other side."""
    rows = keys.limit(MOST_KEYS + 1).toArrow()
    if rows.num_rows > MOST_KEYS:
        raise ValueError(f"the second side of a comparison of all pairs has over {MOST_KEYS} keys")
    return F.broadcast(keys.sparkSession.createDataFrame(rows, keys.schema))


def cosine_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, value: str = "weight", component: str = "component") -> DataFrame:
    """key_a, key_b, cosine of all pairs of vectors in long form; b's side is joined on components, so absent entries cost nothing.

    The result has one row per pair of keys, which both sides' numbers of
    signatures bound; pairs without a common component have cosine 0.
    """
    norm = lambda d, k: d.groupBy(k).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(f"_n_{k}"))
    x = a.select(key_a, F.col(component).alias("_c"), F.col(value).alias("_x"))
    y = b.select(F.col(key_b).alias(f"_{key_b}"), F.col(component).alias("_c"), F.col(value).alias("_y"))
    dot = x.join(y, "_c").groupBy(key_a, f"_{key_b}").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    pairs = norm(a, key_a).crossJoin(_few(norm(b, key_b)).withColumnsRenamed({key_b: f"_{key_b}", f"_n_{key_b}": "_m"}))
    d = pairs.join(dot, [key_a, f"_{key_b}"], "left")
    cos = F.when((F.col(f"_n_{key_a}") > 0) & (F.col("_m") > 0), F.coalesce("_dot", F.lit(0.0)) / (F.col(f"_n_{key_a}") * F.col("_m")))
    return d.select(F.col(key_a).alias("a"), F.col(f"_{key_b}").alias("b"), cos.alias("cosine"))


def rss_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, value: str = "weight") -> DataFrame:
    """a, b and the residual sum of squares between the signatures of two sets."""
    sq = lambda d, k: d.groupBy(k).agg(F.sum(F.col(value) * F.col(value)).alias("s"))
    x = a.select(F.col(key_a).alias("a"), "component", F.col(value).alias("x"))
    y = b.select(F.col(key_b).alias("b"), "component", F.col(value).alias("y"))
    dot = x.join(y, "component").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    p = sq(a, key_a).select(F.col(key_a).alias("a"), F.col("s").alias("sa")).crossJoin(_few(sq(b, key_b).select(F.col(key_b).alias("b"), F.col("s").alias("sb"))))
    return p.join(dot, ["a", "b"], "left").select("a", "b", (F.col("sa") + F.col("sb") - 2 * F.coalesce("d", F.lit(0.0))).alias("rss"))


def similarity(signature: DataFrame, reference: DataFrame, feature: Column | None = None, remove: str | None = None, strict: bool = True, set_order: bool = False) -> DataFrame:
    """a, b, cosine (three decimals), rss (six decimals) and best (whether b is a's best match, ties all) of two sets of signatures (sig, component, weight).

    Weights are shares of a signature, or with feature, a column over component,
    of a signature's feature. remove is a pattern of components to leave out
    first. strict raises if the sets have different components. set_order adds
    position, the place of b: best matches in the order of the signatures that
    they match, then the others by name.
    """
    sets = []
    for d in (signature, reference):
        d = d.where(~F.col("component").rlike(remove)) if remove else d
        d = d.withColumn("_f", F.lit(1) if feature is None else feature)
        sets.append(normalize(d, "weight", ["sig", "_f"]).drop("_f"))
    a, b = sets
    if strict:
        names = [d.select("component").distinct() for d in sets]
        lost = names[0].exceptAll(names[1]).unionByName(names[1].exceptAll(names[0])).limit(5).collect()
        if lost:
            raise ValueError(f"components of one set only: {', '.join(r['component'] for r in lost)}")
    d = cosine_pairs(a, b, "sig", "sig").join(rss_pairs(a, b, "sig", "sig"), ["a", "b"])
    d = d.select("a", "b", F.round("cosine", 3).alias("cosine"), F.abs(F.round("rss", 6)).alias("rss"))
    d = d.withColumn("best", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine"))) == 1)
    if not set_order:
        return d
    first = d.groupBy("b").agg(F.min(F.when(F.col("best"), F.col("a"))).alias("_a"))  # a row per reference, whose number has been checked
    place = first.select("b", F.row_number().over(Window.orderBy(F.col("_a").asc_nulls_last(), "b")).alias("position"))
    return d.join(F.broadcast(place), "b").select("a", "b", "cosine", "rss", "best", "position")


def best_match(similarity: DataFrame) -> DataFrame:
    """For each a the b of the highest cosine, to three decimals; ties are all kept."""
    d = similarity.withColumn("cosine", F.round("cosine", 3))
    return d.withColumn("_r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).where("_r = 1").drop("_r")


def reconstruction_similarity(catalog: DataFrame, signature: DataFrame, exposure: DataFrame) -> DataFrame:
    """Per sample the cosine, the residual sum of squares and its share of the squared counts between the catalogue and signature times exposure."""
    made = exposure.select("sample", "sig", "amount").join(dimension(signature.select("sig", "component", "weight")), "sig").groupBy("sample", "component").agg(F.sum(F.col("amount") * F.col("weight")).alias("y"))
    d = catalog.select("sample", "component", F.col("n").cast("double").alias("x")).join(made, ["sample", "component"], "full_outer").na.fill(0.0, ["x", "y"])
    x, y = F.col("x"), F.col("y")
    a = d.groupBy("sample").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    rss = F.col("xx") + F.col("yy") - 2 * F.col("xy")
    return a.select("sample", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"), rss.alias("rss"), F.when(F.col("xx") > 0, rss / F.col("xx")).alias("unexplained"))


def dominant_signature(exposure: DataFrame) -> DataFrame:
    """sample, sig of the largest exposure; ties are all kept."""
    w = Window.partitionBy("sample").orderBy(F.desc("amount"))
    return exposure.withColumn("_r", F.rank().over(w)).where("_r = 1").select("sample", "sig")


def group_signature(groups: DataFrame, exposure: DataFrame) -> DataFrame:
    """Most frequent dominant signature of each group (sample, grp), the first by name among equals."""
    d = groups.join(dominant_signature(exposure), "sample").groupBy("grp", "sig").agg(F.count("*").alias("n"))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "sig"))).where("_r = 1").drop("_r")


def bootstrap_summary(reps: DataFrame) -> DataFrame:
    """mean, median, least and most exposure of the repetitions of (sample, sig)."""
    return reps.groupBy("sample", "sig").agg(F.avg("exposure").alias("mean"), F.median("exposure").alias("median"), F.min("exposure").alias("least"), F.max("exposure").alias("most"))


def bootstrap_stability(reps: DataFrame, optimal: DataFrame) -> DataFrame:
    """rmse, cv, mae and abs_diff of repetitions (sample, sig, exposure) against optimal (sample, sig, exposure)."""
    d = reps.join(optimal.select("sample", "sig", F.col("exposure").alias("_o")), ["sample", "sig"])
    e = F.col("exposure") - F.col("_o")
    a = d.groupBy("sample", "sig").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("exposure").alias("_m"), F.avg(F.abs(e)).alias("mae"), F.first("_o").alias("_o"))
    return a.select("sample", "sig", "rmse", F.when(F.col("_m") != 0, F.col("rmse") / F.col("_m")).alias("cv"), "mae", F.abs(F.col("_o") - F.col("_m")).alias("abs_diff"))


def run_statistics(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sd, least and most over runs of each key."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def rank_solutions(stats: DataFrame) -> DataFrame:
    """Scores of solutions (signature_number, silhouette, l2_error): silhouette ranked by its drop to the next number, the error as it is; 100 less 5 a rank, weighted 0.4 and 0.6."""
    w = Window.orderBy("signature_number")  # one row per number of signatures
    d = stats.withColumn("_d", F.coalesce(F.lead("silhouette").over(w) - F.col("silhouette"), F.lit(0.0)))

    def average_rank(c: Column) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    score = lambda c: 100 - (average_rank(c) - 1) * 5
    d = d.withColumns({"score_silhouette": score(F.col("_d")), "score_error": score(F.col("l2_error"))})
    return d.withColumn("aggregate", 0.4 * F.col("score_silhouette") + 0.6 * F.col("score_error")).drop("_d")


def rescale(df: DataFrame, value: str, low: float, high: float, out: str = "scaled") -> DataFrame:
    """value mapped linearly from its own range to [low, high]; low where it does not vary."""
    whole = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = df.crossJoin(F.broadcast(whole))
    x = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return d.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), low + x * (high - low)).otherwise(F.lit(low))).drop("_lo", "_hi")
