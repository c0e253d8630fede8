"""Fitting, bootstrap and extraction of signatures as Spark jobs.

Catalogues stay in long form until a sample's counts are one array. Signature
matrices and the catalogue of an extraction are small (components times
signatures, components times samples) and are broadcast after a check of
their size; every (sample, repetition) or (rank, run) is a row with a seed of
its own, so a lost executor repeats exactly the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.functions.lineage import settled
from locusframe.plans.ledger import fingerprint, remembered, table_fingerprint

#: Numbers in a matrix that is broadcast, at most.
MATRIX_LIMIT = 20_000_000
SEED = 123456


def _limited(n: int) -> None:
    if n > MATRIX_LIMIT:
        raise ValueError(f"a matrix of {n} numbers is over the limit of {MATRIX_LIMIT}; select fewer samples or components")


def signature_matrix(signature: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Components, signatures and the matrix of shares of (sig, component, weight)."""
    n_sig, n_comp = signature.agg(F.countDistinct("sig"), F.countDistinct("component")).first()
    _limited(n_sig * n_comp)
    d = signature.groupBy("component", "sig").agg(F.sum("weight").cast("double").alias("w")).toPandas()
    m = d.pivot(index="component", columns="sig", values="w").fillna(0.0).sort_index().sort_index(axis=1)
    p = m.to_numpy()
    return list(m.index), list(m.columns), p / np.maximum(p.sum(axis=0), 1e-300)


def sample_arrays(catalog: DataFrame, components: Sequence[str]) -> DataFrame:
    """sample and counts: its numbers in the order of the components. Raises if a component with counts is none of these."""
    at = {c: i for i, c in enumerate(components)}
    lost = [r["component"] for r in catalog.where(~F.col("component").isin(list(at)) & (F.col("n") != 0)).select("component").distinct().limit(5).collect()]
    if lost:
        raise ValueError(f"components without signature weights: {', '.join(map(str, lost))}")
    d = catalog.where(F.col("component").isin(list(at))).groupBy("sample").agg(F.collect_list(F.struct("component", F.col("n").cast("double").alias("n"))).alias("x"))
    spark = catalog.sparkSession
    shared = spark.sparkContext.broadcast(at)

    @F.pandas_udf("array<double>")
    def dense(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            v = np.zeros(len(shared.value))
            for r in x:
                v[shared.value[r["component"]]] += r["n"]
            out.append(v)
        return pd.Series(out)

    return d.select("sample", dense("x").alias("counts"))


def fit(catalog: DataFrame, signature: DataFrame, method: str = "QP", auto_reduce: bool = False, kind: str = "absolute", threshold: float = 0.0, seed: int = SEED) -> DataFrame:
    """sample, sig, exposure, error (Frobenius) and cosine. An empty catalogue has exposures of 0."""
    if method not in solvers.METHODS:
        raise ValueError(f"method must be one of {', '.join(solvers.METHODS)}")
    components, sigs, p = signature_matrix(signature)
    shared = catalog.sparkSession.sparkContext.broadcast(p)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for s, c in zip(pdf["sample"], pdf["counts"], strict=True):
                c = np.asarray(c)
                e = solvers.fit_one(c, shared.value, method, auto_reduce, seed)
                made = shared.value @ e * c.sum()
                err, cos = round(float(np.linalg.norm(c - made)), 3), round(solvers.cosine(c, made), 6)
                rows += [(s, k, v, err, cos) for k, v in zip(sigs, solvers.absolute(e, c.sum(), threshold, kind).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "sig", "exposure", "error", "cosine"])

    return sample_arrays(catalog, components).mapInPandas(run, "sample string, sig string, exposure double, error double, cosine double")


def _bootstrap_tasks(catalog: DataFrame, components: Sequence[str], n: int, min_count: int, seed: int) -> DataFrame:
    """sample, counts, rep (0: the catalogue as it is) and a seed of its own for each."""
    d = sample_arrays(catalog, components).where(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) > min_count)
    return d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("seed", F.abs(F.xxhash64("sample", "rep", F.lit(seed)) % (1 << 31)))


def _fit_tasks(tasks: DataFrame, sigs: list[str], p: np.ndarray, method: str) -> DataFrame:
    """key, sample, rep, sig, exposure, error and cosine of the tasks."""
    shared = tasks.sparkSession.sparkContext.broadcast(p)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, s, c, rep, sd in zip(pdf["key"], pdf["sample"], pdf["counts"], pdf["rep"], pdf["seed"], strict=True):
                c = np.asarray(c)
                e = solvers.bootstrap(c, shared.value, int(sd), method)[0] if rep else solvers.fit_one(c, shared.value, method) * c.sum()
                made = shared.value @ e
                err, cos = float(np.linalg.norm(c - made)), solvers.cosine(c, made)
                rows += [(key, s, rep, k, v, err, cos) for k, v in zip(sigs, np.round(e, 6).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "sample", "rep", "sig", "exposure", "error", "cosine"])

    return tasks.select("key", "sample", "counts", "rep", "seed").mapInPandas(run, "key string, sample string, rep int, sig string, exposure double, error double, cosine double")


def fit_bootstrap(catalog: DataFrame, signature: DataFrame, n: int = 100, method: str = "QP", min_count: int = 1, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """sample, type (optimal or Rep_i), sig, exposure, error, cosine: each catalogue fitted as it is and in n multinomial resamples. Samples with totals up to min_count go.

    With a folder each fit of a (sample, repetition) is kept there, under a key
    of the sample's counts, the signatures, the method and the seed. A stopped
    job goes on with what is missing, more repetitions add to those that are
    there, and other data or arguments never meet them.
    """
    components, sigs, p = signature_matrix(signature)
    tasks = _bootstrap_tasks(catalog, components, n, min_count, seed)
    if folder is None:
        fits = _fit_tasks(tasks.withColumn("key", F.lit("")), sigs, p, method)
    else:
        shares = signature.groupBy("sig", "component").agg(F.sum("weight").cast("double").alias("weight"))
        key = fingerprint(F.col("sample"), F.col("counts"), F.lit(table_fingerprint(shares)), F.lit(method), F.lit(seed))
        fits = remembered(tasks.withColumn("key", key), ["sample", "rep"], lambda t: _fit_tasks(t, sigs, p, method), f"{folder}/fits")
    kind = F.when(F.col("rep") > 0, F.concat(F.lit("Rep_"), F.col("rep").cast("string"))).otherwise("optimal")
    return fits.select("sample", kind.alias("type"), "sig", "exposure", "error", "cosine")


def fit_bootstrap_batch(catalog: DataFrame, signature: DataFrame, methods: Sequence[str] = ("QP",), n: int = 100, min_count: int = 1, thresholds: Sequence[float] = (0.05,), seed: int = SEED, folder: str | None = None) -> dict[str, DataFrame]:
    """Four tables over samples, methods and repetitions: expo (method, sample, sig, exposure, type), error, cosine (method, sample, type, value) and p_val. A folder keeps every fit, see fit_bootstrap."""
    whole = None
    for m in methods:
        one = fit_bootstrap(catalog, signature, n, m, min_count, seed, folder).withColumn("method", F.lit(m))
        whole = one if whole is None else whole.unionByName(one)
    single = lambda c: whole.groupBy("method", "sample", "type").agg(F.first(c).alias(c))
    p = None
    for m in methods:
        q = bootstrap_p_values(whole.where(F.col("method") == m), thresholds).withColumn("method", F.lit(m))
        p = q if p is None else p.unionByName(q)
    return {"expo": whole.select("method", "sample", "sig", "exposure", "type"), "error": single("error"), "cosine": single("cosine"), "p_val": p}


def fit_suboptimal(catalog: DataFrame, signature: DataFrame, n: int = 100, factor: float = 1.05, seed: int = SEED) -> DataFrame:
    """sample, type (Rep_i), sig, exposure, error, cosine of n fits of each catalogue whose error is within factor times the least one; the catalogues are not resampled."""
    components, sigs, p = signature_matrix(signature)
    shared = catalog.sparkSession.sparkContext.broadcast(p)
    d = sample_arrays(catalog, components).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("seed", F.abs(F.xxhash64("sample", "rep", F.lit(seed)) % (1 << 31)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for s, c, rep, sd in zip(pdf["sample"], pdf["counts"], pdf["rep"], pdf["seed"], strict=True):
                c = np.asarray(c)
                e = solvers.suboptimal(c, shared.value, int(sd), factor)
                made = shared.value @ e
                rows += [(s, f"Rep_{rep}", k, v, float(np.linalg.norm(c - made)), solvers.cosine(c, made)) for k, v in zip(sigs, np.round(e, 6).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "type", "sig", "exposure", "error", "cosine"])

    return d.mapInPandas(run, "sample string, type string, sig string, exposure double, error double, cosine double")


def attribute(catalog: DataFrame, signature: DataFrame, exposure: DataFrame, classes: DataFrame | None = None, method: str = "bt", cutoff: float = 0.05, by_proportion: bool = False, seed: int = SEED) -> DataFrame:
    """sample, sig, exposure, cosine: activities of the signatures with which signatures may be in which sample decided first.

    exposure (sample, sig, amount) is an earlier estimate and classes (sample,
    cls) the samples' classes, see tables.allowed_signatures. bt: medians over
    resamples, without what is not significantly there; stepwise: allowed ones
    removed and global ones added by their worth for the cosine.
    """
    from locusframe.operators.catalog import relative_exposure
    from locusframe.operators.tables import allowed_signatures

    if method not in ("bt", "stepwise"):
        raise ValueError("method must be bt or stepwise")
    components, sigs, p = signature_matrix(signature)
    at = {s: i for i, s in enumerate(sigs)}
    flags = allowed_signatures(relative_exposure(exposure), classes, cutoff)
    held = flags.groupBy("sample").agg(F.collect_list(F.struct("sig", "flag")).alias("flags"))
    d = sample_arrays(catalog, components).join(held, "sample", "left").withColumn("seed", F.abs(F.xxhash64("sample", F.lit(seed)) % (1 << 31)))
    shared = catalog.sparkSession.sparkContext.broadcast((p, at))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, at = shared.value
        for pdf in it:
            rows = []
            for s, c, fs, sd in zip(pdf["sample"], pdf["counts"], pdf["flags"], pdf["seed"], strict=True):
                c = np.asarray(c)
                flag = np.full(len(at), 1 if fs is None else 2)
                for f in fs if fs is not None else ():
                    if f["sig"] in at:
                        flag[at[f["sig"]]] = f["flag"]
                e, cos = solvers.attribute_bootstrap(c, p, flag, int(sd), by_proportion=by_proportion) if method == "bt" else solvers.attribute_stepwise(c, p, flag)
                rows += [(s, k, v, cos) for k, v in zip(at, np.round(e, 6).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "sig", "exposure", "cosine"])

    return d.mapInPandas(run, "sample string, sig string, exposure double, cosine double")


def bootstrap_p_values(boot: DataFrame, thresholds: Sequence[float] = (0.05,)) -> DataFrame:
    """sample, sig, threshold, p_value: that the mean relative exposure over repetitions exceeds the threshold (one-sided t-test); where it does not vary, the share of repetitions at or below it."""
    from locusframe.functions import tests_of_significance as T
    from locusframe.operators.stats import kernel

    reps = boot.where("type != 'optimal'")
    w = Window.partitionBy("sample", "type")
    rel = reps.withColumn("_t", F.sum("exposure").over(w)).withColumn("rel", F.when(F.col("_t") > 0, F.col("exposure") / F.col("_t")).otherwise(0.0))
    d = rel.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    a = d.groupBy("sample", "sig", "threshold").agg(F.count("*").alias("n"), F.avg("rel").alias("m"), F.stddev("rel").alias("sd"), F.avg(F.when(F.col("rel") <= F.col("threshold"), 1.0).otherwise(0.0)).alias("below"))
    p = kernel(lambda n, m, sd, t: T.exceeds(int(n), m, sd, t), F.col("n").cast("double"), F.col("m"), F.when(F.col("sd") > 0, F.col("sd")), F.col("threshold"))
    return a.select("sample", "sig", "threshold", F.coalesce(p, F.col("below")).alias("p_value"))


def catalogue_matrix(catalog: DataFrame, min_total: float = 0.01) -> tuple[list[str], list[str], np.ndarray]:
    """Components, samples (those whose totals reach min_total) and the matrix, after a check of its size."""
    d = catalog.withColumn("_t", F.sum("n").over(Window.partitionBy("sample"))).where(F.col("_t") >= min_total)
    n_s, n_c = d.agg(F.countDistinct("sample"), F.countDistinct("component")).first()
    _limited((n_s or 0) * (n_c or 0))
    m = d.groupBy("component", "sample").agg(F.sum("n").cast("double").alias("n")).toPandas().pivot(index="component", columns="sample", values="n").fillna(0.0).sort_index().sort_index(axis=1)
    return list(m.index), list(m.columns), m.to_numpy()


def _runs(spark: SparkSession, tasks: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(tasks, schema).repartition(max(1, min(len(tasks), 1000)))


_RUN = "k int, catalogue int, run int, seed long, score double, kept int, w array<double>, h array<double>"


def _factorise(catalog: DataFrame, tasks: list[tuple], method: str, resample: bool, n_iter: int, folder: str | None = None) -> tuple[list[str], list[str], DataFrame]:
    """Components, samples and the runs of the tasks (k, catalogue, run, seed); a folder keeps every run, under a key of the catalogue and the arguments, for a later call."""
    components, samples, v = catalogue_matrix(catalog)
    spark = catalog.sparkSession
    shared = spark.sparkContext.broadcast(v)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, cat, r, seed in pdf.itertuples(index=False):
                x = shared.value
                if resample and cat:
                    x = np.random.default_rng(SEED + int(cat)).poisson(x).astype(float)
                if method == "KL":
                    w, h, score = solvers.nmf(x, int(k), int(seed), n_iter)
                    score = -score
                else:
                    w, h, score = solvers.bayes_nmf(x, int(k), int(seed), method, n_iter)
                    at = solvers.kept_signatures(w)
                    w, h = w[:, at], h[at]
                rows.append((k, cat, r, seed, score, w.shape[1], w.ravel(), h.ravel()))
            yield pd.DataFrame(rows, columns=["k", "catalogue", "run", "seed", "score", "kept", "w", "h"])

    todo = _runs(spark, tasks, "k int, catalogue int, run int, seed long")
    if folder is None:
        return components, samples, todo.mapInPandas(run, _RUN)
    whole = table_fingerprint(catalog.groupBy("sample", "component").agg(F.sum("n").cast("double").alias("n")))
    key = F.sha2(F.lit("|".join([whole, method, str(resample), str(n_iter)])), 256)
    ids = ["k", "catalogue", "run", "seed"]
    work = lambda t: t.select(*ids).mapInPandas(run, _RUN).withColumn("key", key)
    return components, samples, remembered(todo.withColumn("key", key), ids, work, f"{folder}/runs").drop("key")


def _solution(spark: SparkSession, components: list[str], samples: list[str], w: np.ndarray, h: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """signature (sig, component, weight, share) and exposure (sample, sig, amount, rel) of one solution, the largest signature first."""
    sig, expo = solvers.scale_solution(w, h)
    order = np.argsort(-expo.sum(axis=1), kind="stable")
    sig, expo = sig[:, order], expo[order]
    share, rel = sig / np.maximum(sig.sum(axis=0), 1e-300), expo / np.maximum(expo.sum(axis=0), 1e-300)
    names = [f"Sig{i + 1}" for i in range(sig.shape[1])]
    a = [(n, c, float(sig[i, j]), float(share[i, j])) for j, n in enumerate(names) for i, c in enumerate(components)]
    b = [(s, n, float(expo[j, i]), float(rel[j, i])) for j, n in enumerate(names) for i, s in enumerate(samples)]
    return spark.createDataFrame(a, "sig string, component string, weight double, share double"), spark.createDataFrame(b, "sample string, sig string, amount double, rel double")


def _refitted(catalog: DataFrame, sig: DataFrame) -> DataFrame:
    """Exposures (sample, sig, amount, rel) of the catalogue fitted to the signatures by quadratic programming."""
    from locusframe.operators.catalog import share

    e = fit(catalog, sig.select("sig", "component", F.col("share").alias("weight"))).select("sample", "sig", F.col("exposure").alias("amount"))
    return e.withColumn("rel", share("amount", "sample"))


def extract(catalog: DataFrame, n_sig: int, n_run: int = 10, seed: int = SEED, n_iter: int = 2000, optimize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signatures and exposures of the best of n_run factorisations with n_sig signatures; with optimize the exposures are those of a fit to the signatures found. Halves of split samples (hyper_split) are summed again."""
    from locusframe.operators.catalog import hyper_collapse, share

    sig, expo = _extract(catalog, n_sig, n_run, seed, n_iter)
    if optimize:
        expo = _refitted(catalog, sig)
    whole = hyper_collapse(expo.select("sample", "sig", "amount"), "amount", ["sig"])
    return sig, whole.withColumn("rel", share("amount", "sample"))


def _extract(catalog: DataFrame, n_sig: int, n_run: int, seed: int, n_iter: int) -> tuple[DataFrame, DataFrame]:
    tasks = [(n_sig, 0, r, seed + r) for r in range(n_run)]
    components, samples, runs = _factorise(catalog, tasks, "KL", False, n_iter)
    best = runs.orderBy(F.desc("score"), "run").first()
    return _solution(catalog.sparkSession, components, samples, np.array(best["w"]).reshape(-1, n_sig), np.array(best["h"]).reshape(n_sig, -1))


def randomised(catalog: DataFrame, seed: int = SEED) -> DataFrame:
    """The catalogue with each sample's counts, zeros included, dealt anew over all components, at random but alike in every run.

    A component's place in the list of all components is the rank, by a hash of
    (sample, component), of the component to which its count goes.
    """
    counts = catalog.groupBy("sample", "component").agg(F.sum("n").alias("n"))
    listed = counts.select("component").distinct().withColumn("_i", F.row_number().over(Window.orderBy("component")))  # one row per component
    _limited(listed.count())
    listed = F.broadcast(listed)
    dealt = counts.select("sample").distinct().crossJoin(listed.select("component"))  # the grid of a catalogue
    dealt = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("sample").orderBy(F.xxhash64("sample", "component", F.lit(seed)), "component")))
    held = counts.join(listed, "component").select("sample", "_i", "n")
    none = F.lit(0).cast(counts.schema["n"].dataType)
    return dealt.join(held, ["sample", "_i"], "left").select("sample", "component", F.coalesce("n", none).alias("n"))


def estimate(catalog: DataFrame, ranks: Sequence[int], n_run: int = 10, seed: int = SEED, n_iter: int = 500, use_random: bool = False) -> DataFrame:
    """Survey of ranks over the catalogue, and with use_random over a randomised one too (column data tells them apart). See _estimate for the columns."""
    out = _estimate(catalog, ranks, n_run, seed, n_iter)
    if use_random:
        out = out.withColumn("data", F.lit("own")).unionByName(_estimate(randomised(catalog, seed), ranks, n_run, seed, n_iter).withColumn("data", F.lit("random")))
    return out


def _estimate(catalog: DataFrame, ranks: Sequence[int], n_run: int, seed: int, n_iter: int) -> DataFrame:
    """Survey of ranks: k, residual (divergence), rss, evar, cophenetic, dispersion, sparseness of the basis and mean silhouette of the consensus.

    The consensus is looked at by kinds of samples (those with the same
    dominant signature in every run) with their numbers as weights, so a task
    meets the pairs of kinds, not of samples; their number is checked.
    """
    tasks = [(k, 0, r, seed + r) for k in ranks for r in range(n_run)]
    _, samples, runs = _factorise(catalog, tasks, "KL", False, n_iter)
    _, _, v = catalogue_matrix(catalog)
    shared = catalog.sparkSession.sparkContext.broadcast(v)
    runs = settled(runs)
    _, kinds = _label_kinds(runs, samples)
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "run"))
    best = runs.select("k", "score", "w", "h", first.alias("_r")).where("_r = 1").drop("_r")

    def survey(kinds: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        best = best.iloc[0]
        k = int(best["k"])
        w, h = np.array(best["w"]).reshape(-1, k), np.array(best["h"]).reshape(k, -1)
        rss = float(((shared.value - w @ h) ** 2).sum())
        dist, size = _kinds(kinds)
        n = len(size)
        merges = solvers.hclust(dist, size)
        m = w.shape[0]
        sparse = float(np.mean((np.sqrt(m) - np.abs(w).sum(axis=0) / np.maximum(np.linalg.norm(w, axis=0), 1e-300)) / (np.sqrt(m) - 1)))
        pairs = np.outer(size, size)
        dispersion = float((pairs * 4 * (0.5 - dist) ** 2).sum() / pairs.sum())
        sil = float(np.average(solvers.silhouette(dist, solvers.cut_tree(merges, n, min(k, n)), size), weights=size)) if size.sum() > k else 0.0
        return pd.DataFrame([(k, -float(best["score"]), rss, 1 - rss / float((shared.value**2).sum()), solvers.cophenetic(dist, merges, size), dispersion, sparse, sil)], columns=["k", "residual", "rss", "evar", "cophenetic", "dispersion", "sparseness", "silhouette"])

    schema = "k int, residual double, rss double, evar double, cophenetic double, dispersion double, sparseness double, silhouette double"
    return kinds.groupBy("k").cogroup(best.groupBy("k")).applyInPandas(survey, schema)  # one run and the kinds of a number of signatures


def auto_extract(catalog: DataFrame, k0: int = 25, n_run: int = 10, prior: str = "L1KL", strategy: str = "stable", seed: int = SEED, n_iter: int = 20_000, reference: DataFrame | None = None, optimize: bool = False, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Signatures and exposures of a factorisation that finds its own number of signatures.

    stable: the most frequent number, then the best posterior; optimal: the best
    posterior; ms: the largest mean, over a run's signatures, of the best cosine
    with a signature of reference (sig, component, weight). With optimize the
    exposures are those of a fit to the signatures found. A folder keeps the
    runs: a stopped extraction goes on, and other strategies choose among the
    same runs.
    """
    if strategy not in ("stable", "optimal", "ms"):
        raise ValueError("strategy must be one of stable, optimal, ms")
    if strategy == "ms" and reference is None:
        raise ValueError("strategy ms needs reference signatures")
    tasks = [(k0, 0, r, seed + r) for r in range(n_run)]
    components, samples, runs = _factorise(catalog, tasks, prior, False, n_iter, folder)
    runs = runs.where("kept > 0").withColumn("_n", F.count("*").over(Window.partitionBy("kept")))
    if strategy == "ms":
        names, _, p = signature_matrix(reference)
        at = {c: i for i, c in enumerate(names)}
        ref = np.array([p[at[c]] if c in at else np.zeros(p.shape[1]) for c in components])

        def similarity(r) -> float:
            w = np.array(r["w"]).reshape(-1, r["kept"])
            return float(np.mean([max(solvers.cosine(x, y) for y in ref.T) for x in w.T]))

        best = min(runs.collect(), key=lambda r: (-similarity(r), r["run"]))  # n_run rows
    else:
        order = [F.desc("_n"), F.desc("score")] if strategy == "stable" else [F.desc("score")]
        best = runs.orderBy(*order, "run").first()
    k = best["kept"]
    sig, expo = _solution(catalog.sparkSession, components, samples, np.array(best["w"]).reshape(-1, k), np.array(best["h"]).reshape(k, -1))
    return sig, _refitted(catalog, sig) if optimize else expo


def worthwhile(catalog: DataFrame, min_contribution: float = 0.0, handle_hyper_mutation: bool = True) -> DataFrame:
    """The catalogue without empty samples and without components that hold less than min_contribution of all counts, samples with far too many counts split."""
    from locusframe.operators.catalog import hyper_split

    d = catalog.join(catalog.groupBy("sample").agg(F.sum("n").alias("_t")).where("_t > 0").select("sample"), "sample", "left_semi")
    if min_contribution > 0:
        whole = d.agg(F.sum("n").alias("_all"))
        kept = d.groupBy("component").agg(F.sum("n").alias("_c")).crossJoin(F.broadcast(whole)).where(F.col("_c") >= min_contribution * F.col("_all")).select("component")
        d = d.join(kept, "component", "left_semi")
    return hyper_split(d) if handle_hyper_mutation else d


def unify_extract(catalog: DataFrame, ranks: Sequence[int], approach: str = "bayes_auto", **options):
    """One entry to the extractions: bayes_auto (auto_extract), repeated_nmf (extract, ranks of one number), bootstrap_nmf (best_practice)."""
    if approach == "bayes_auto":
        return auto_extract(catalog, k0=max(ranks), **options)
    if approach == "repeated_nmf":
        if len(ranks) != 1:
            raise ValueError("repeated_nmf takes one number of signatures; survey others with estimate")
        return extract(catalog, ranks[0], **options)
    if approach == "bootstrap_nmf":
        return best_practice(worthwhile(catalog, options.pop("min_contribution", 0.0), options.pop("handle_hyper_mutation", True)), ranks, **options)
    raise ValueError("approach must be one of bayes_auto, repeated_nmf, bootstrap_nmf")


def _label_kinds(runs: DataFrame, samples: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(k, sample, kind) and (k, kind, labels, n): samples whose dominant signatures agree in every run with k signatures are one kind, n of them. The squared number of kinds is checked."""
    shared = runs.sparkSession.sparkContext.broadcast(samples)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, r, h in pdf.itertuples(index=False):
                yield pd.DataFrame({"k": np.int32(k), "sample": shared.value, "run": r, "label": np.asarray(h).reshape(k, -1).argmax(axis=0).astype(np.int32)})

    each = runs.select("k", "run", "h").mapInPandas(run, "k int, sample string, run int, label int")
    listed = F.sort_array(F.collect_list(F.struct("run", "label")))  # an entry per run
    held = settled(each.groupBy("k", "sample").agg(listed.alias("x")).select("k", "sample", F.col("x.label").alias("labels")))
    kinds = held.groupBy("k", "labels").agg(F.count("*").alias("n"))
    kinds = settled(kinds.withColumn("kind", F.row_number().over(Window.partitionBy("k").orderBy("labels")) - 1))
    n = kinds.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    _limited(n * n)
    return held.join(F.broadcast(kinds), ["k", "labels"]).select("k", "sample", "kind"), kinds


def _dominant(catalog: DataFrame, n_sig: int, n_run: int, seed: int, n_iter: int) -> tuple[DataFrame, DataFrame]:
    """Kinds of samples of n_run factorisations with n_sig signatures, see _label_kinds."""
    _, samples, runs = _factorise(catalog, [(n_sig, 0, r, seed + r) for r in range(n_run)], "KL", False, n_iter)
    held, kinds = _label_kinds(runs, samples)
    return held.select("sample", "kind"), kinds


def _kinds(kinds: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the kinds, the share of runs in which their labels differ, and their sizes."""
    d = kinds.sort_values("kind")
    x = np.stack(d["labels"].to_list())
    dist = np.zeros((len(x), len(x)))
    for column in x.T:
        dist += column[:, None] != column[None]
    return dist / x.shape[1], d["n"].to_numpy(float)


def consensus_matrix(catalog: DataFrame, n_sig: int, n_run: int = 20, seed: int = SEED, n_iter: int = 500) -> DataFrame:
    """a, b, share: how often runs give two samples the same dominant signature. A row for each pair of samples, whose number is checked first."""
    held, kinds = _dominant(catalog, n_sig, n_run, seed, n_iter)
    n = held.count()
    _limited(n * n)
    dist, _ = _kinds(kinds.toPandas())
    cells = catalog.sparkSession.createDataFrame([(i, j, float(1 - v)) for (i, j), v in np.ndenumerate(dist)], "kind int, other int, share double")
    other = held.select(F.col("sample").alias("b"), F.col("kind").alias("other"))
    return held.withColumnRenamed("sample", "a").join(F.broadcast(cells), "kind").join(other, "other").select("a", "b", "share")


def cluster_iterations(signatures: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """k, sig, cluster, silhouette: average-linkage clusters of signatures (sig, component, weight; of several extractions) by their cosine distances, for each number k.

    Mean cosine distances are products of sums of unit vectors, so neither the
    linkage, which is made once, nor a task for a k sees the distances of all pairs.
    """
    _, sigs, p = signature_matrix(signatures)
    n = len(sigs)
    unit = p / np.maximum(np.linalg.norm(p, axis=0), 1e-300)
    ranks = [int(k) for k in ranks if 1 < k < n]
    schema = "k int, sig string, cluster int, silhouette double"
    if not ranks:
        return signatures.sparkSession.createDataFrame([], schema)
    shared = signatures.sparkSession.sparkContext.broadcast((sigs, unit.T, solvers.cosine_linkage(unit.T)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, unit, merges = shared.value
        for pdf in it:
            for k in pdf["k"]:
                label = solvers.cut_tree(merges, len(sigs), int(k))
                yield pd.DataFrame({"k": np.int32(k), "sig": sigs, "cluster": label.astype(np.int32), "silhouette": solvers.cosine_silhouette(unit, label)})

    return _runs(signatures.sparkSession, [(k,) for k in ranks], "k int").mapInPandas(run, schema)


def saved_run(runs: DataFrame, components: Sequence[str], samples: Sequence[str], run: int) -> tuple[DataFrame, DataFrame]:
    """Signatures and exposures of one run of a table of runs, columns of W with sums up to 1 left out."""
    r = runs.where(F.col("run") == run).first()
    if r is None:
        raise ValueError(f"no run {run}")
    k = r["kept"]
    w, h = np.array(r["w"]).reshape(-1, k), np.array(r["h"]).reshape(k, -1)
    at = solvers.kept_signatures(w)
    return _solution(runs.sparkSession, list(components), list(samples), w[:, at], h[at])


def best_practice(catalog: DataFrame, ranks: Sequence[int], n_bootstrap: int = 20, n_run: int = 50, rtol: float = 1e-3, seed: int = SEED, n_iter: int = 1000) -> DataFrame:
    """Runs over resampled catalogues, those near the best of their catalogue aligned: k, sig, component, mean, sd, least, most, silhouette and l2_error per number of signatures."""
    tasks = [(k, b, r, seed + 1000 * b + r) for k in ranks for b in range(n_bootstrap) for r in range(n_run)]
    components, _, runs = _factorise(catalog, tasks, "KL", True, n_iter)
    w = Window.partitionBy("k", "catalogue")
    runs = runs.withColumn("_best", F.max("score").over(w)).where(-F.col("score") <= -F.col("_best") * (1 + rtol))
    runs = runs.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "run"))).where("_r <= 10")  # the best ten of a catalogue, as the method has it
    _, _, v = catalogue_matrix(catalog)
    shared = catalog.sparkSession.sparkContext.broadcast((v, components))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        pdf = pdf.sort_values(["catalogue", "run"])
        v, names = shared.value
        ws = [np.array(x).reshape(-1, k) for x in pdf["w"]]
        hs = [np.array(x).reshape(k, -1) for x in pdf["h"]]
        order = solvers.align_runs(ws)
        shares = [(w / np.maximum(w.sum(axis=0), 1e-300))[:, o] for w, o in zip(ws, order, strict=True)]
        cube = np.stack(shares)
        flat = np.concatenate([s.T for s in shares])
        unit = flat / np.maximum(np.linalg.norm(flat, axis=1), 1e-300)[:, None]
        label = np.tile(np.arange(k), len(shares))
        sil = solvers.silhouette(1 - unit @ unit.T, label)
        error = float(np.mean([np.linalg.norm(v - w @ h) / np.linalg.norm(v) for w, h in zip(ws, hs, strict=True)]))
        rows = [(k, f"Sig{j + 1}", c, *(float(f(cube[:, i, j])) for f in (np.mean, np.std, np.min, np.max)), float(sil[label == j].mean()), error) for j in range(k) for i, c in enumerate(names)]
        return pd.DataFrame(rows, columns=["k", "sig", "component", "mean", "sd", "least", "most", "silhouette", "l2_error"])

    schema = "k int, sig string, component string, mean double, sd double, least double, most double, silhouette double, l2_error double"
    return runs.groupBy("k").applyInPandas(summarise, schema)  # a number of signatures has n_bootstrap * 10 runs at most


def simulate_catalogs(catalog: DataFrame, n: int = 1, seed: int = SEED) -> DataFrame:
    """n multinomial draws of each sample's own total: sample, rep, component, n."""
    d = catalog.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("component", F.col("n").cast("double").alias("n")))).alias("x")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    d = d.withColumn("seed", F.abs(F.xxhash64("sample", "rep", F.lit(seed)) % (1 << 31)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for s, x, rep, sd in zip(pdf["sample"], pdf["x"], pdf["rep"], pdf["seed"], strict=True):
                v = np.array([r["n"] for r in x])
                draw = np.random.default_rng(int(sd)).multinomial(int(round(v.sum())), v / v.sum()) if v.sum() > 0 else v.astype(int)
                rows += [(s, rep, r["component"], int(k)) for r, k in zip(x, draw, strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "rep", "component", "n"])

    return d.mapInPandas(run, "sample string, rep int, component string, n long")


def kmeans_groups(relative: DataFrame, k: int, seed: int = 1024) -> DataFrame:
    """sample, grp and silhouette (of squared distances): k-means over the shares of the signatures (sample, sig, rel)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sigs = [r["sig"] for r in relative.select("sig").distinct().orderBy("sig").collect()]  # one row per signature
    wide = relative.groupBy("sample").pivot("sig", sigs).agg(F.first("rel")).na.fill(0.0)
    d = wide.select("sample", array_to_vector(F.array(*[F.col(f"`{s}`") for s in sigs])).alias("features"))
    return _with_silhouette(relative, KMeans(k=k, seed=seed).fit(d).transform(d).select("sample", F.col("prediction").alias("grp")))


def attribute_activity(catalog: DataFrame, signature: DataFrame, loss: float = 0.01) -> DataFrame:
    """sample, sig, exposure: signatures whose removal costs less than `loss` of the cosine are dropped one by one, the least costly first."""
    components, sigs, p = signature_matrix(signature)
    shared = catalog.sparkSession.sparkContext.broadcast(p)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for pdf in it:
            rows = []
            for s, c in zip(pdf["sample"], pdf["counts"], strict=True):
                c = np.asarray(c)
                held = list(range(q.shape[1]))
                fit_ = lambda at: solvers.fit_one(c, q[:, at])  # noqa: B023,E731
                now = solvers.cosine(c, q @ solvers.fit_one(c, q))
                while len(held) > 1:
                    tries = [(solvers.cosine(c, q[:, at] @ fit_(at)), at) for at in ([x for x in held if x != y] for y in held)]
                    score, at = max(tries, key=lambda t: t[0])
                    if now - score >= loss:
                        break
                    held, now = at, score
                e = np.zeros(q.shape[1])
                e[held] = fit_(held) * c.sum()
                rows += [(s, k, v) for k, v in zip(sigs, np.round(e, 6).tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "sig", "exposure"])

    return sample_arrays(catalog, components).mapInPandas(run, "sample string, sig string, exposure double")


def extract_iterative(catalog: DataFrame, n_sig: int, n_run: int = 10, threshold: float = 0.95, max_iter: int = 10, seed: int = SEED, n_iter: int = 1000) -> list[tuple[DataFrame, DataFrame]]:
    """Solutions of repeated extraction: each round takes the samples that the round before reconstructed with a cosine under the threshold, until fewer than two or all remain."""
    from locusframe.operators.catalog import reconstruction_similarity

    out, rest = [], catalog
    for _ in range(max_iter):
        sig, expo = extract(rest, n_sig, n_run, seed, n_iter)
        out.append((sig, expo))
        fit_ = reconstruction_similarity(rest, sig.select("sig", "component", F.col("share").alias("weight")), expo)
        r = fit_.agg(F.count("*").alias("n"), F.count(F.when(F.col("cosine") < threshold, 1)).alias("poor")).first()
        if r["poor"] < 2 or r["poor"] == r["n"]:
            break
        rest = rest.join(fit_.where(F.col("cosine") < threshold).select("sample"), "sample", "left_semi")
    return out


def consensus_groups(catalog: DataFrame, n_sig: int, n_run: int = 20, seed: int = SEED, n_iter: int = 500) -> DataFrame:
    """sample, grp and silhouette: average-linkage groups of how often runs give two samples the same dominant signature.

    Samples of one kind, with the same dominant signature in every run, are a
    node with their number as its weight: the linkage meets kinds, not samples.
    """
    held, kinds = _dominant(catalog, n_sig, n_run, seed, n_iter)
    dist, size = _kinds(kinds.toPandas())
    grp = solvers.cut_tree(solvers.hclust(dist, size), len(size), min(n_sig, len(size)))
    rows = [(i, int(g), float(s)) for i, (g, s) in enumerate(zip(grp, solvers.silhouette(dist, grp, size), strict=True))]
    return held.join(F.broadcast(catalog.sparkSession.createDataFrame(rows, "kind int, grp int, silhouette double")), "kind").select("sample", "grp", "silhouette")


def sample_groups(catalog: DataFrame, n_sig: int, method: str = "consensus", **options) -> DataFrame:
    """sample, grp and silhouette by consensus (average linkage of the samples that share dominant signatures) or samples (each in the group of the signature that is dominant in the best run)."""
    if method == "consensus":
        return consensus_groups(catalog, n_sig, **options)
    if method != "samples":
        raise ValueError("method must be consensus or samples")
    _, expo = extract(catalog, n_sig, **options)
    w = Window.partitionBy("sample").orderBy(F.desc("rel"), "sig")
    top = expo.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("sample", F.regexp_extract("sig", r"(\d+)$", 1).cast("int").alias("grp"))
    return _with_silhouette(expo, top)


def _with_silhouette(relative: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (sample, grp) with silhouette of squared distances between the samples' shares (sample, sig, rel).

    The mean squared distance of a sample to a group follows from the group's
    mean and its mean of squares, so a sample meets the groups' sums only.
    """
    sigs = [r["sig"] for r in relative.select("sig").distinct().orderBy("sig").collect()]  # one row per signature
    wide = relative.groupBy("sample").pivot("sig", sigs).agg(F.first("rel")).na.fill(0.0).select("sample", F.array(*[F.col(f"`{s}`") for s in sigs]).alias("x"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)
    d = wide.join(groups, "sample")
    means = d.groupBy("grp").agg(F.count("*").alias("n"), F.avg(square("x")).alias("q"), F.array(*[F.avg(F.element_at("x", i + 1)) for i in range(len(sigs))]).alias("m"))
    means = F.broadcast(means.select(F.col("grp").alias("other"), "n", "q", "m"))  # a row per group
    dot = F.aggregate(F.zip_with("x", "m", lambda a, b: a * b), F.lit(0.0), lambda a, y: a + y)
    e = d.crossJoin(means).withColumn("mean", F.greatest(F.lit(0.0), square("x") - 2 * dot + F.col("q")))
    own = F.col("grp") == F.col("other")
    a = F.max(F.when(own & (F.col("n") > 1), F.col("mean") * F.col("n") / (F.col("n") - 1)))
    e = e.groupBy("sample", "grp").agg(a.alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    most = F.greatest("a", "b")
    return e.select("sample", "grp", F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(0.0).alias("silhouette"))
