"""Consensus extraction: many factorisations of resampled catalogues, told as tables.

Runs are rows. Which signature of the consensus each column of a run belongs to
is a table of its own (k, catalogue, run, col, sig): every run is matched to the
present centroids by itself, the centroids are means that Spark takes over all
runs, and both alternate until no column changes its place. From that table and
the runs Spark aggregates signatures, exposures and their statistics; no task
meets all runs. What is broadcast (centroids, unit vectors of the signatures,
the catalogue) is checked against MATRIX_LIMIT.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.functions.lineage import settled
from locusframe.operators.catalog import rank_solutions
from locusframe.plans import extraction as X

#: Rounds of matching and averaging at most, and runs of a catalogue that take part at most.
ROUNDS, RUNS_KEPT = 20, 10
_RUN_KEY = ("k", "catalogue", "run")
_UNIT = lambda m: m / np.maximum(np.linalg.norm(m, axis=0), 1e-300)


@dataclass(frozen=True)
class Consensus:
    """alignment: k, catalogue, run, col, sig. signature: k, sig, component, weight (mean), sd, least, most, share. exposure: k, sample, sig, amount (mean), sd, least, most, rel.

    stats_signature and stats_sample: a row per k and signature or sample, see
    signature_statistics and sample_statistics. stats: a row per k. rank: scores
    of the numbers of signatures, and suggested: the best of them, the larger on
    a tie; None if only one was tried.
    """

    alignment: DataFrame
    signature: DataFrame
    exposure: DataFrame
    stats_signature: DataFrame
    stats_sample: DataFrame
    stats: DataFrame
    rank: DataFrame
    suggested: int | None

    def best(self, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """signature (sig, component, weight, share) and exposure (sample, sig, amount, rel) with k signatures, the suggested number by default."""
        k = self.suggested if k is None else k
        pick = lambda d, *c: d.where(F.col("k") == k).select(*c)
        return pick(self.signature, "sig", "component", "weight", "share"), pick(self.exposure, "sample", "sig", "amount", "rel")


def _matrix(values, rows: int) -> np.ndarray:
    return np.asarray(values, float).reshape(rows, -1)


def near_best(runs: DataFrame, rtol: float = 1e-3, most: int = RUNS_KEPT) -> DataFrame:
    """Runs whose divergence is within a share rtol of their catalogue's best, the best `most` of each."""
    w = Window.partitionBy("k", "catalogue")
    close = runs.withColumn("_best", F.max("score").over(w)).where(-F.col("score") <= -F.col("_best") * (1 + rtol))
    return close.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "run"))).where(F.col("_r") <= most).drop("_r", "_best")


def align(runs: DataFrame) -> DataFrame:
    """k, catalogue, run, col, sig (1 to k): the signature of the consensus to which each column of W of each run (k, catalogue, run, score, w) belongs.

    Centroids start as the columns of the best run of each k. A run's columns are
    dealt to the centroids by the assignment of greatest total cosine; centroids
    become the means of their unit columns. Signatures are numbered in the order
    of the best run.
    """
    spark = runs.sparkSession
    n_w, n_k = runs.select(F.max(F.size("w")), F.countDistinct("k")).first()
    X._limited((n_w or 0) * (n_k or 0))
    first = runs.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "catalogue", "run"))).where("_r = 1")
    centroids = {r["k"]: _UNIT(np.asarray(r["w"], float).reshape(-1, r["k"])) for r in first.select("k", "w").collect()}  # a run per k
    placed = None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(centroids)

        def place(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in it:
                rows = []
                for k, cat, run, w in pdf.itertuples(index=False):
                    unit = _UNIT(np.asarray(w, float).reshape(-1, k))
                    at = solvers.assignment(1 - shared.value[k].T @ unit)
                    rows += [(k, cat, run, int(c), s + 1, unit[:, c]) for s, c in enumerate(at)]
                yield pd.DataFrame(rows, columns=["k", "catalogue", "run", "col", "sig", "unit"])

        found = settled(runs.select(*_RUN_KEY, "w").mapInPandas(place, "k int, catalogue int, run int, col int, sig int, unit array<double>"))
        moved = None if placed is None else found.join(placed.select(*_RUN_KEY, "col", F.col("sig").alias("_s")), [*_RUN_KEY, "col"]).where("sig != _s").limit(1).count()
        placed = found
        if moved == 0:
            break
        means = placed.select("k", "sig", F.posexplode("unit").alias("i", "u")).groupBy("k", "sig", "i").agg(F.avg("u").alias("u")).toPandas()  # k * components numbers per k
        centroids = {int(k): _UNIT(d.pivot(index="i", columns="sig", values="u").to_numpy()) for k, d in means.groupby("k")}
    return placed


def _ordered(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """runs with `at`: the columns in the order of the signatures."""
    at = placed.groupBy(*_RUN_KEY).agg(F.sort_array(F.collect_list(F.struct("sig", "col"))).alias("p")).select(*_RUN_KEY, F.col("p.col").alias("at"))  # k entries
    return runs.join(at, list(_RUN_KEY))


def _whole(samples: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Names of true samples, and for each sample the place of its own; halves of split ones share one."""
    names = [s.split("_[hyper]_")[0] for s in samples]
    true = list(dict.fromkeys(names))
    at = {s: i for i, s in enumerate(true)}
    return true, np.array([at[s] for s in names], int)


def _summed(m: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((m.shape[0], n))
    np.add.at(out.T, at, m.T)
    return out


def _spread(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """name_mean, name_sd, name_min and name_max of a value."""
    return df.groupBy(*keys).agg(F.avg(value).alias(f"{name}_mean"), F.stddev(value).alias(f"{name}_sd"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"))


def signature_statistics(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """k, sig and over the aligned runs: kld (least divergence), similarity_* (cosines within a signature), cross_similarity_* (with the nearest other signature), silhouette of both means, and expo_pos_cor_*.

    Cosines are those of each run with later ones, in the order of catalogue and
    run; a single run counts with itself. expo_pos_cor are the positive rank
    correlations of a signature's exposures with those of the others, run by run,
    weighted by the share of positive ones; 0 where none is.
    """
    n, least, most, length = placed.agg(F.count("*"), F.min("k"), F.max("k"), F.max(F.size("unit"))).first()
    X._limited((n or 0) * (length or 0))
    numbered = placed.select("k", "catalogue", "run").distinct().withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("catalogue", "run")) - 1)
    units = placed.join(numbered, list(_RUN_KEY)).select("k", "sig", "i", "unit")
    held = {int(k): np.stack([np.stack(g.sort_values("i")["unit"].to_list()) for _, g in d.groupby("sig", sort=True)]) for k, d in units.toPandas().groupby("k")}  # signatures x runs x components
    shared = placed.sparkSession.sparkContext.broadcast(held)

    def cosines(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, sig, i, unit in pdf.itertuples(index=False):
                x = shared.value[k]
                later = x[:, i + 1 :] if x.shape[1] > 1 else x
                for s, dots in enumerate(later @ np.asarray(unit)):
                    if len(dots):
                        rows.append((k, sig, s + 1, len(dots), dots.mean(), ((dots - dots.mean()) ** 2).sum(), dots.min(), dots.max()))
            yield pd.DataFrame(rows, columns=["k", "sig", "other", "n", "m", "q", "least", "most"])

    dots = units.mapInPandas(cosines, "k int, sig int, other int, n long, m double, q double, least double, most double")
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    a = dots.groupBy("k", "sig", "other").agg(F.sum("n").alias("n"), mean.alias("mean"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"), F.min("least").alias("min"), F.max("most").alias("max"))
    a = a.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("q") + F.col("s") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1))))
    a = settled(a)
    four = lambda d, name: d.select("k", "sig", *[F.col(c).alias(f"{name}_{c}") for c in ("mean", "sd", "min", "max")])
    within = four(a.where("sig = other"), "similarity")
    nearest = a.where("sig != other").withColumn("_r", F.row_number().over(Window.partitionBy("k", "sig").orderBy(F.desc("mean"), "other"))).where("_r = 1")
    out = within.join(four(nearest, "cross_similarity"), ["k", "sig"], "left")

    def ranks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, at, h in pdf.itertuples(index=False):
                x = pd.DataFrame(_matrix(h, k)[np.asarray(at)]).rank(axis=1).to_numpy()
                x = x - x.mean(axis=1, keepdims=True)
                c = _UNIT(x.T).T @ _UNIT(x.T)
                rows += [(k, i + 1, round(float(c[i, j]), 12)) for i in range(k) for j in range(k) if i != j]
            yield pd.DataFrame(rows, columns=["k", "sig", "r"])

    r = _ordered(runs, placed).select("k", "at", "whole").mapInPandas(ranks, "k int, sig int, r double")
    r = r.withColumns({"_n": F.count("*").over(Window.partitionBy("k", "sig")), "_p": F.count(F.when(F.col("r") > 0, 1)).over(Window.partitionBy("k", "sig"))}).where("r > 0")
    cor = _spread(r.withColumn("r", F.col("r") * F.col("_p") / F.col("_n")), ["k", "sig"], "r", "expo_pos_cor")
    kld = runs.groupBy("k").agg((-F.max("score")).alias("kld"))
    out = out.join(cor, ["k", "sig"], "left").na.fill(0.0, [f"expo_pos_cor_{c}" for c in ("mean", "sd", "min", "max")]).join(kld, "k")
    apart, own = 1 - F.col("cross_similarity_mean"), 1 - F.col("similarity_mean")
    return out.withColumn("silhouette", F.when(F.greatest(apart, own) > 0, (apart - own) / F.greatest(apart, own)))


def _per_sample(runs: DataFrame, v: np.ndarray, samples: list[str], at: np.ndarray) -> DataFrame:
    """k, sample, cosine_distance, l1 and l2 between each run's reconstruction and the catalogue."""
    shared = runs.sparkSession.sparkContext.broadcast((v, samples, at))

    def errors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, samples, at = shared.value
        size = np.linalg.norm(v, axis=0)
        for pdf in it:
            for k, w, h in pdf.itertuples(index=False):
                made = np.asarray(w, float).reshape(-1, k) @ _summed(_matrix(h, k), at, len(samples))
                norm = np.linalg.norm(made, axis=0) * size
                cos = np.where(norm > 0, (made * v).sum(axis=0) / np.where(norm > 0, norm, 1), 0.0)
                yield pd.DataFrame({"k": k, "sample": samples, "cosine_distance": 1 - cos, "l1": np.abs(made - v).sum(axis=0), "l2": np.linalg.norm(made - v, axis=0)})

    return runs.select("k", "w", "h").mapInPandas(errors, "k int, sample string, cosine_distance double, l1 double, l2 double")


def _sample_silhouettes(runs: DataFrame, samples: list[str], at: np.ndarray) -> DataFrame:
    """k, sample and silhouette of its reconstructions over the runs against those of the nearest other sample; means of cosines between different runs come from sums of unit vectors."""
    spark = runs.sparkSession
    n = len(samples)
    X._limited(n * n)
    names = spark.sparkContext.broadcast((samples, at))

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = names.value[1], {}
        for pdf in it:
            for k, w, h in pdf.itertuples(index=False):
                u = _UNIT(np.asarray(w, float).reshape(-1, k) @ _summed(_matrix(h, k), at, n))
                total = held.setdefault(k, [0, np.zeros_like(u), np.zeros((n, n))])
                total[0], total[1], total[2] = total[0] + 1, total[1] + u, total[2] + u.T @ u
        for k, (runs_, u, g) in held.items():
            yield pd.DataFrame({"k": k, "i": np.arange(n, dtype=np.int32), "runs": runs_, "u": list(u.T), "g": list(g)})

    parts = runs.select("k", "w", "h").mapInPandas(sums, "k int, i int, runs long, u array<double>, g array<double>")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "i": pdf["i"].iloc[:1], "runs": [int(pdf["runs"].sum())], "u": [np.sum(pdf["u"].to_list(), axis=0)], "g": [np.sum(pdf["g"].to_list(), axis=0)]})

    whole = settled(parts.groupBy("k", "i").applyInPandas(merged, "k int, i int, runs long, u array<double>, g array<double>"))  # a row per task
    units = {int(k): np.stack(d.sort_values("i")["u"].to_list(), axis=1) for k, d in whole.select("k", "i", "u").toPandas().groupby("k")}
    shared = spark.sparkContext.broadcast(units)

    def widths(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, i, r, u, g in pdf.itertuples(index=False):
                mean = (np.asarray(u) @ shared.value[k] - np.asarray(g)) / (r * (r - 1)) if r > 1 else np.asarray(g)
                a, b = 1 - mean[i], 1 - np.delete(mean, i).max() if n > 1 else np.nan
                rows.append((k, names.value[0][i], (b - a) / max(a, b) if max(a, b) > 0 else np.nan))
            yield pd.DataFrame(rows, columns=["k", "sample", "silhouette"])

    return whole.mapInPandas(widths, "k int, sample string, silhouette double").withColumn("silhouette", F.nanvl("silhouette", F.lit(None).cast("double")))


def sample_statistics(runs: DataFrame, v: np.ndarray, samples: Sequence[str], only_core: bool | None = None) -> DataFrame:
    """k, sample and cosine_distance_*, l1_*, l2_* of the runs' reconstructions (mean, sd, min, max), split samples taken as one; silhouette too unless only_core (as it is over 100 samples)."""
    true, at = _whole(samples)
    held = _per_sample(runs, _summed(v, at, len(true)), true, at)
    out = None
    for c in ("cosine_distance", "l1", "l2"):
        one = _spread(held, ["k", "sample"], c, c)
        out = one if out is None else out.join(one, ["k", "sample"])
    if only_core or only_core is None and len(true) > 100:
        return out.withColumn("silhouette", F.lit(None).cast("double"))
    return out.join(_sample_silhouettes(runs, true, at), ["k", "sample"])


def _told(runs: DataFrame, placed: DataFrame, components: list[str], samples: list[str]) -> tuple[DataFrame, DataFrame]:
    """(k, sig, component, x) and (k, sig, sample, x) of every run: signatures weighted by their contribution, exposures by the size of their signature."""
    true, at = _whole(samples)
    shared = runs.sparkSession.sparkContext.broadcast((components, true, at))

    def rows(which: int):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            components, true, at = shared.value
            for pdf in it:
                for k, order, w, h in pdf.itertuples(index=False):
                    sig, expo = solvers.scale_solution(np.asarray(w, float).reshape(-1, k), _matrix(h, k))
                    m = sig.T if which == 0 else _summed(expo, at, len(true))
                    m, names = m[np.asarray(order)], components if which == 0 else true
                    yield pd.DataFrame({"k": k, "sig": np.repeat(np.arange(1, k + 1, dtype=np.int32), len(names)), "name": np.tile(np.array(names, object), k), "x": m.ravel()})

        return run

    d = _ordered(runs, placed).select("k", "at", "w", "h")
    schema = "k int, sig int, name string, x double"
    return d.mapInPandas(rows(0), schema).withColumnRenamed("name", "component"), d.mapInPandas(rows(1), schema).withColumnRenamed("name", "sample")


def consensus_of(runs: DataFrame, components: list[str], samples: list[str], v: np.ndarray, only_core: bool | None = None) -> Consensus:
    """The tables of a Consensus from runs (k, catalogue, run, score, w, h) over the components and samples of the catalogue v."""
    true, at = _whole(samples)
    joined = runs.sparkSession.sparkContext.broadcast((at, len(true)))

    @F.pandas_udf("array<double>")
    def whole(k: pd.Series, h: pd.Series) -> pd.Series:
        at, n = joined.value
        return pd.Series([_summed(_matrix(x, j), at, n).ravel() for j, x in zip(k, h, strict=True)])

    runs = settled(runs.select(*_RUN_KEY, "score", "w", "h", whole("k", "h").alias("whole")))
    placed = align(runs)
    sigs, expos = _told(runs, placed, components, samples)
    renamed = {"x_mean": "weight", "x_sd": "sd", "x_min": "least", "x_max": "most"}
    signature = settled(_spread(sigs, ["k", "sig", "component"], "x", "x").withColumnsRenamed(renamed))
    exposure = _spread(expos, ["k", "sig", "sample"], "x", "x").withColumnsRenamed(renamed | {"x_mean": "amount"})
    size = signature.groupBy("k", "sig").agg(F.sum("weight").alias("_w"))
    name = F.concat(F.lit("Sig"), F.row_number().over(Window.partitionBy("k").orderBy(F.desc("_w"), "sig")).cast("string"))
    names = settled(size.select("k", "sig", "_w", name.alias("name")))

    def called(d: DataFrame) -> DataFrame:
        return d.join(names.drop("_w"), ["k", "sig"]).drop("sig").withColumnRenamed("name", "sig")

    signature = signature.join(names, ["k", "sig"]).select("k", F.col("name").alias("sig"), "component", "weight", "sd", "least", "most", F.when(F.col("_w") > 0, F.col("weight") / F.col("_w")).otherwise(0.0).alias("share"))
    total = F.sum("amount").over(Window.partitionBy("k", "sample"))
    exposure = called(exposure).select("k", "sample", "sig", "amount", "sd", "least", "most", F.when(total > 0, F.col("amount") / total).otherwise(0.0).alias("rel"))
    stats_signature = settled(called(signature_statistics(runs, placed)))
    stats_sample = settled(sample_statistics(runs, v, samples, only_core))
    a = stats_signature.groupBy("k").agg(F.avg("silhouette").alias("silhouette"), F.avg("expo_pos_cor_mean").alias("exposure_positive_correlation"), F.avg("similarity_mean").alias("similarity_within"), F.avg("cross_similarity_mean").alias("similarity_across"))
    b = stats_sample.groupBy("k").agg(F.avg("cosine_distance_mean").alias("cosine_distance"), F.avg("l1_mean").alias("l1_error"), F.avg("l2_mean").alias("l2_error"), F.avg("silhouette").alias("silhouette_sample"))
    stats = settled(a.join(b, "k").withColumnRenamed("k", "signature_number"))
    rank = rank_solutions(stats)
    best = rank.orderBy(F.desc("aggregate"), F.desc("signature_number")).first() if stats.count() > 1 else None
    return Consensus(called(placed.drop("unit")), signature, exposure, stats_signature, stats_sample, stats, rank, best and best["signature_number"])


def consensus_extract(
    catalog: DataFrame, ranks: Sequence[int], n_bootstrap: int = 20, n_run: int = 50, rtol: float = 1e-3, min_contribution: float = 0.0, split: bool = True, only_core: bool | None = None, seed: int = X.SEED, n_iter: int = 1000
) -> Consensus:
    """Signatures, exposures, statistics and a suggested number from n_run factorisations of each of n_bootstrap resampled catalogues, for each number in ranks. Rare components go and samples with far too many counts are split, see worthwhile; components that went come back with weight 0."""
    kept = settled(X.worthwhile(catalog, min_contribution, split))
    tasks = [(k, b, r, seed + 1000 * b + r) for k in ranks for b in range(n_bootstrap) for r in range(n_run)]
    components, samples, runs = X._factorise(kept, tasks, "KL", True, n_iter)
    _, _, v = X.catalogue_matrix(kept)
    out = consensus_of(near_best(runs, rtol), components, samples, v, only_core)
    gone = catalog.select("component").distinct().join(kept.select("component").distinct(), "component", "left_anti")
    none = F.lit(0.0)
    back = out.signature.select("k", "sig").distinct().crossJoin(F.broadcast(gone)).select("k", "sig", "component", *[none.alias(c) for c in ("weight", "sd", "least", "most", "share")])  # a row per signature and component
    return Consensus(**{**vars(out), "signature": out.signature.unionByName(back)})


def consensus_iterative(catalog: DataFrame, ranks: Sequence[int], threshold: float = 0.95, max_iter: int = 10, **options) -> list[Consensus]:
    """Rounds of consensus_extract: each takes the samples whose mean cosine distance at the suggested number (or the only one) exceeds 1 - threshold, until fewer than two or all of them do."""
    out, rest = [], catalog
    for _ in range(max_iter):
        found = consensus_extract(rest, ranks, **options)
        out.append(found)
        k = found.suggested or ranks[0]
        s = found.stats_sample.where(F.col("k") == k)
        poor = s.where(F.col("cosine_distance_mean") > 1 - threshold).select("sample")
        n_poor, n = poor.count(), s.count()
        if n_poor < 2 or n_poor == n:
            break
        rest = settled(rest.join(poor, "sample", "left_semi"))
    return out
