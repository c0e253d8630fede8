"""Groups around medoids and of equal size, held against plain versions that see all distances."""

import time

import numpy as np
import pytest

from locusframe.functions import solvers
from locusframe.plans import grouping as P


def long(spark, x, value):
    return spark.createDataFrame([(f"s{i:05d}", f"g{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], f"sample string, sig string, {value} double")


def plain_medoids(d, k):
    """Greedy start, then the best swap of all while one helps, each tried by its whole cost."""
    cost = lambda ms: d[:, ms].min(axis=1).sum()
    n, ms = len(d), []
    while len(ms) < k:
        ms.append(min((i for i in range(n) if i not in ms), key=lambda i: cost([*ms, i])))
    while True:
        tries = [[i if x == m else x for x in ms] for m in ms for i in range(n) if i not in ms]
        best = min(tries, key=cost, default=ms)
        if cost(best) >= cost(ms) - 1e-9:
            return sorted(ms)
        ms = best


@pytest.mark.parametrize("k", [1, 2, 4])
def test_medoids_as_by_trial(spark, monkeypatch, k):
    monkeypatch.setattr(P, "BLOCK", 16)  # several blocks and tasks
    x = np.random.default_rng(k).dirichlet(np.full(4, 0.5), 70)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    label = d[:, plain_medoids(d, k)].argmin(axis=1)
    rows = P.pam_groups(long(spark, x, "rel"), k).orderBy("sample").collect()
    assert [r.grp for r in rows] == label.tolist()
    assert np.abs(np.array([r.silhouette for r in rows]) - solvers.silhouette(d, label)).max() < 1e-9


def test_medoids_of_few_equal_and_no_samples(spark):
    same = long(spark, np.full((6, 3), 1 / 3), "rel")
    assert {(r.grp, r.silhouette) for r in P.pam_groups(same, 2).collect()} == {(0, 0.0)}
    few = P.pam_groups(long(spark, np.eye(3), "rel"), 5).orderBy("sample").collect()
    assert [r.grp for r in few] == [0, 1, 2]
    assert P.pam_groups(same.limit(0), 2).count() == 0
    for method in ("nearest", "kmeans", "hclust"):
        empty = P.equal_size_clusters(same.withColumnRenamed("rel", "amount").limit(0), 2, method)
        assert empty.count() == 0 and empty.columns == ["sample", "cluster"]


def plain_greedy(d, size, order):
    d, label, room = d.copy(), np.full(len(d), -1), np.full(d.shape[1], size)
    for i in order:
        label[i] = g = int(d[i].argmin())
        room[g] -= 1
        if not room[g]:
            d[:, g] = np.inf
    return label


@pytest.mark.parametrize("choose", ["spread", "far", "near", "random"])
def test_centres_with_room_as_one_by_one(spark, monkeypatch, choose):
    monkeypatch.setattr(P, "BLOCK", 32)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.1, (90, 3)), rng.normal(1, 0.4, (30, 3))])  # most want the same centres
    points = P.Points(long(spark, x, "amount"), "amount")
    centre = points.x[rng.choice(120, 12, replace=False)]
    d = P.apart(points.x, centre)
    by = {"spread": d.min(axis=1) - d.max(axis=1), "far": -d.max(axis=1), "near": d.min(axis=1), "random": None}[choose]
    order = np.random.default_rng(3).permutation(120) if by is None else np.argsort(by, kind="stable")
    rows = P.assigned(points, centre, 10, choose, 3).orderBy("sample").collect()
    assert [r.cluster for r in rows] == plain_greedy(d, 10, order).tolist()
    with pytest.raises(ValueError, match="room"):
        P.assigned(points, centre, 9)


@pytest.mark.parametrize("choose", ["far", "near"])
def test_rounds_as_with_all_distances(spark, choose):
    x = np.random.default_rng(2).dirichlet(np.full(5, 0.4), 203)
    points = P.Points(long(spark, x, "amount"), "amount")
    d, label, g = P.apart(points.x, points.x), np.full(203, -1), 0
    while (label < 0).any():
        left = np.flatnonzero(label < 0)
        total = d[np.ix_(left, left)].sum(axis=1)
        first = left[total.argmax() if choose == "far" else total.argmin()]
        label[left[np.argsort(d[first, left], kind="stable")[:10]]] = g
        g += 1
    assert P.nearest_rounds(points, 10, choose).tolist() == label.tolist()


@pytest.mark.parametrize("method,choose", [("nearest", "random"), ("nearest", None), ("kmeans", None), ("kmeans", "far"), ("hclust", None)])
def test_groups_have_equal_size(spark, method, choose):
    x = np.vstack([np.random.default_rng(1).normal(0, 0.3, (55, 2)), np.zeros((46, 2))])  # nearly half are the same
    rows = P.equal_size_clusters(long(spark, x, "amount"), 10, method, choose=choose).collect()
    sizes = sorted(np.bincount([r.cluster for r in rows]))
    assert len(rows) == len({r.sample for r in rows}) == 101 and sum(sizes) == 101 and max(sizes) == 10


def test_wrong_arguments(spark):
    e = long(spark, np.eye(3), "amount")
    for args in ((0, "nearest"), (2, "other")):
        with pytest.raises(ValueError):
            P.equal_size_clusters(e, *args)
    for method in ("nearest", "kmeans"):
        with pytest.raises(ValueError, match="choose"):
            P.equal_size_clusters(e, 2, method, choose="other")


def test_four_thousand_samples(spark):
    x = np.random.default_rng(7).dirichlet(np.full(5, 0.3), 4000)
    points = P.Points(long(spark, x, "amount"), "amount")
    centre = points.x[:200]
    began = time.perf_counter()
    assert set(np.bincount([r.cluster for r in P.assigned(points, centre, 20).collect()])) == {20}
    took = time.perf_counter() - began
    began = time.perf_counter()
    assert set(np.bincount(P.nearest_rounds(points, 20))) == {20}
    assert took < 60 and time.perf_counter() - began < 30
