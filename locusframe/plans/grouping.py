"""Groups of samples around medoids and groups of equal size.

The values of the samples are one matrix, held against MATRIX_LIMIT and
broadcast. Distances of all pairs are held nowhere: a task takes a block of
samples, meets the others block by block and keeps sums. What a step decides
(a medoid, the room left at a centre) is one number a sample or a centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.plans.extraction import _limited

#: Samples a block; distances of two blocks are in memory at once.
BLOCK = 1024
#: Distances of a block to centres, at most.
TO_CENTRES = 2_000_000


class Points:
    """The samples of a long table (sample, sig, value) as rows of a matrix around its mean; what a table lacks counts as 0."""

    def __init__(self, long: DataFrame, value: str):
        self.spark = long.sparkSession
        n, m = long.agg(F.countDistinct("sample"), F.countDistinct("sig")).first()
        _limited(n * m)
        cells = long.where("sample IS NOT NULL AND sig IS NOT NULL").groupBy("sample", "sig").agg(F.sum(value).cast("double").alias("v")).toPandas()
        wide = cells.pivot(index="sample", columns="sig", values="v").fillna(0.0).sort_index().sort_index(axis=1)
        self.samples = list(wide.index)
        self.x = wide.to_numpy(float)
        if self.samples:
            self.x = self.x - self.x.mean(axis=0)
        self._shared = self.spark.sparkContext.broadcast((self.x, self.samples))

    def __len__(self) -> int:
        return len(self.samples)

    def each(self, work: Callable[[np.ndarray, np.ndarray, object], dict], schema: str, state: object = None, block: int = BLOCK) -> DataFrame:
        """The columns that work(matrix, rows, state) gives for each block of rows; a column `sample` of rows becomes their names."""
        shared, held = self._shared, self.spark.sparkContext.broadcast(state)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, names = shared.value
            for batch in it:
                rows = batch.column(0).to_numpy()
                for start in range(0, len(rows), block):
                    out = work(x, rows[start : start + block], held.value)
                    if "sample" in out:
                        out = {**out, "sample": [names[i] for i in out["sample"]]}
                    yield pa.RecordBatch.from_pydict(out)

        tasks = max(1, min(-(-len(self) // BLOCK), 4 * self.spark.sparkContext.defaultParallelism))
        return self.spark.range(0, len(self), 1, tasks).mapInArrow(run, schema)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b from their dot products; under 1e-7 of the lengths they count as 0."""
    scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    d = scale - 2 * a @ b.T
    return np.sqrt(np.where(d > 1e-14 * scale, d, 0.0))


def _blocks(x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for start in range(0, len(x), BLOCK):
        at = slice(start, start + BLOCK)
        yield at, apart(x[rows], x[at])


def _cost(x: np.ndarray, rows: np.ndarray, near: np.ndarray) -> dict:
    """Sum of distances to the nearest medoid if a row became one more."""
    return {"id": rows, "cost": sum(np.minimum(d, near[at]).sum(axis=1) for at, d in _blocks(x, rows))}


def _swap(x: np.ndarray, rows: np.ndarray, state: tuple) -> dict:
    """The best swap of a medoid for one of the rows: all medoids are tried at once, from each sample's nearest and second nearest."""
    label, first, second, k = state
    member = np.eye(k)[label]
    change = np.tile((second - first) @ member, (len(rows), 1))
    for at, d in _blocks(x, rows):
        a, b = first[at], second[at]
        change += np.minimum(d - a, 0).sum(axis=1)[:, None] + np.where(d < a, a - b, np.minimum(d - b, 0)) @ member[at]
    row, medoid = np.unravel_index(change.argmin(), change.shape)
    return {"change": [float(change[row, medoid])], "medoid": [int(medoid)], "id": [int(rows[row])]}


def _told(x: np.ndarray, rows: np.ndarray, label: np.ndarray) -> dict:
    """Group and silhouette of the rows, from their sums of distances to each group."""
    size = np.bincount(label)
    total, own, at = np.zeros((len(rows), len(size))), label[rows], np.arange(len(rows))
    for cols, d in _blocks(x, rows):
        total += d @ np.eye(len(size))[label[cols]]
    a = total[at, own] / np.maximum(size[own] - 1, 1)
    mean = total / np.maximum(size, 1)
    mean[:, size == 0] = np.inf
    mean[at, own] = np.inf
    b = mean.min(axis=1)
    most = np.maximum(a, b)
    fine = (size[own] > 1) & np.isfinite(b) & (most > 0)
    s = np.divide(b - a, most, out=np.zeros(len(rows)), where=fine)
    return {"sample": rows, "grp": own.astype(np.int32), "silhouette": s}


def _nearest_two(x: np.ndarray, medoids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = apart(x, x[medoids])
    label, every = d.argmin(axis=1), np.arange(len(x))
    first = d[every, label]
    d[every, label] = np.inf
    return label, first, d.min(axis=1)


def pam_groups(relative: DataFrame, k: int) -> DataFrame:
    """sample, grp and silhouette: k groups around medoids by the distances of the samples' shares (sample, sig, rel).

    Medoids are chosen greedily, then the best of all swaps is taken while one
    helps. A pass of tasks meets all pairs; fewer samples than k are a group
    each, no samples no rows.
    """
    schema = "sample string, grp int, silhouette double"
    points = Points(relative, "rel")
    n, k = len(points), min(k, len(points))
    if n == 0:
        return points.spark.createDataFrame([], schema)
    _limited(n * k)
    medoids, near = [], np.full(n, np.inf)
    while len(medoids) < k:
        found = points.each(_cost, "id long, cost double", near).where(~F.col("id").isin(medoids)).agg(F.min_by("id", F.struct("cost", "id")).alias("id")).first()
        medoids.append(found["id"])
        near = np.minimum(near, apart(points.x, points.x[medoids[-1:]])[:, 0])
    while 1 < k < n:
        label, first, second = _nearest_two(points.x, medoids)
        tried = points.each(_swap, "change double, medoid long, id long", (label, first, second, k))
        best = tried.agg(F.min(F.struct("change", "medoid", "id")).alias("x")).first()["x"]
        swapped = [best["id"] if i == best["medoid"] else m for i, m in enumerate(medoids)]
        if best["change"] >= 0 or _nearest_two(points.x, swapped)[1].sum() >= first.sum() * (1 - 1e-12):
            break
        medoids = swapped
    return points.each(_told, schema, apart(points.x, points.x[sorted(medoids)]).argmin(axis=1))


def _sums(x: np.ndarray, rows: np.ndarray, _) -> dict:
    return {"id": rows, "total": sum(d.sum(axis=1) for _, d in _blocks(x, rows))}


def nearest_rounds(points: Points, size: int, choose: str = "far", seed: int = 1) -> np.ndarray:
    """Label of each sample: round by round the sample farthest from all left (or nearest to them, or any: far, near, random) with its size - 1 nearest.

    Sums over all are taken in tasks once. What a round removes lies near its
    first sample, so the distances to that one bound, by the triangle, what the
    others lose; a sum is taken anew only for a sample that may be the next.
    """
    if choose not in ("far", "near", "random"):
        raise ValueError("choose must be one of far, near, random")
    n, rng = len(points), np.random.default_rng(seed)
    label, left, x = np.full(n, -1), np.arange(n), points.x
    low = high = None
    if choose != "random":
        total = points.each(_sums, "id long, total double").toPandas().sort_values("id")["total"].to_numpy()
        low, high = total.copy(), total.copy()
    for g in range(-(-n // size)):
        if choose == "random":
            first = int(rng.integers(len(left)))
        else:
            while True:
                first = int(high[left].argmax() if choose == "far" else low[left].argmin())
                i = left[first]
                if low[i] == high[i]:
                    break
                low[i] = high[i] = apart(x[i : i + 1], x[left]).sum()
        d = apart(x[left[first : first + 1]], x[left])[0]
        d[first] = -1  # the first sample itself, before equal ones
        gone = np.argsort(d, kind="stable")[:size]
        d[first] = 0
        label[left[gone]] = g
        if choose != "random":
            radius, lost = d[gone].sum(), len(gone) * d
            low[left] -= lost + radius
            high[left] -= np.maximum(lost - radius, 0)
        left = np.delete(left, gone)
    return label


def _reach(x: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> dict:
    d = apart(x[rows], centre)
    return {"id": rows, "least": d.min(axis=1), "most": d.max(axis=1)}


def _choice(x: np.ndarray, rows: np.ndarray, state: tuple) -> np.ndarray:
    """The nearest centre that still takes a sample of this rank."""
    centre, rank, last = state
    return np.where(rank[rows][:, None] <= last, apart(x[rows], centre), np.inf).argmin(axis=1)


def _offers(x: np.ndarray, rows: np.ndarray, state: tuple) -> dict:
    return {"centre": _choice(x, rows, state).astype(np.int32), "rank": state[1][rows]}


def _placed(x: np.ndarray, rows: np.ndarray, state: tuple) -> dict:
    return {"sample": rows, "cluster": _choice(x, rows, state)}


def assigned(points: Points, centre: np.ndarray, size: int, choose: str = "spread", seed: int = 1) -> DataFrame:
    """sample and cluster: samples in order of preference each go to the nearest centre with room for one more of its `size`.

    The order is by the distances to centres: nearest less farthest (spread),
    farthest first (far), nearest first (near), or random; ties go by name.
    Instead of one sample after another all choose at once; a centre with too
    many keeps the first `size`, and its last rank is told to all before they
    choose again. This ends in the same groups: a sample leaves a centre only
    for `size` samples that come before it.
    """
    n, k = len(points), len(centre)
    if n > k * size:
        raise ValueError("the centres have no room for all samples")
    _limited(centre.size)
    block = max(1, min(BLOCK, TO_CENTRES // k))
    if choose == "random":
        order = np.random.default_rng(seed).permutation(n)
    else:
        d = points.each(_reach, "id long, least double, most double", centre, block).toPandas().sort_values("id")
        by = {"spread": d["least"] - d["most"], "far": -d["most"], "near": d["least"]}
        if choose not in by:
            raise ValueError("choose must be one of spread, far, near, random")
        order = np.argsort(by[choose].to_numpy(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    last = np.full(k, n, np.int64)
    w = Window.partitionBy("centre").orderBy("rank")
    while True:
        offers = points.each(_offers, "centre int, rank long", (centre, rank, last), block).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size + 1)
        full = offers.groupBy("centre").agg(F.max("_r").alias("n"), F.max(F.when(F.col("_r") <= size, F.col("rank"))).alias("last")).where(F.col("n") > size).collect()  # a row per centre
        if not full:
            return points.each(_placed, "sample string, cluster long", (centre, rank, last), block)
        last = last.copy()
        for r in full:
            last[r["centre"]] = r["last"]


def _centres(points: Points, k: int, seed: int) -> np.ndarray:
    """k centres by k-means; where it finds fewer they are used again."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.each(lambda x, rows, _: {"x": list(x[rows])}, "x array<double>")
    found = np.array(KMeans(k=k, seed=seed).fit(rows.select(array_to_vector("x").alias("features"))).clusterCenters()) if k > 1 else np.zeros((1, points.x.shape[1]))
    return found[np.arange(k) % len(found)]


def equal_size_clusters(exposure: DataFrame, size: int, method: str = "nearest", seed: int = 1, choose: str | None = None) -> DataFrame:
    """sample and cluster: groups of `size` samples each (one may have fewer), near one another by their exposures (sample, sig, amount).

    nearest takes a sample and those around it round by round, kmeans centres
    with limited room; `choose` says which samples come first (`nearest_rounds`,
    `assigned`). hclust takes subtrees of a dendrogram, for which a task looks
    at all distances after a check of their number.
    """
    schema = "sample string, cluster long"
    if size < 1 or method not in ("nearest", "kmeans", "hclust"):
        raise ValueError("size must be 1 or more, method one of nearest, kmeans, hclust")
    points = Points(exposure, "amount")
    n = len(points)
    if n == 0:
        return points.spark.createDataFrame([], schema)
    if method == "kmeans":
        return assigned(points, _centres(points, -(-n // size), seed), size, choose or "spread", seed)
    if method == "nearest":
        label = nearest_rounds(points, size, choose or "far", seed)
        return points.each(lambda _, rows, label: {"sample": rows, "cluster": label[rows]}, schema, label)
    _limited(n * n)
    x, samples = points.x, points.samples

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in it:
            yield pd.DataFrame({"sample": samples, "cluster": solvers.bottom_up_groups(x, size)})

    return points.spark.range(1).mapInPandas(run, schema)
