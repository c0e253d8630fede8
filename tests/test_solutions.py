"""Consensus extraction against a plain version that holds all runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.plans import extraction as X
from locusframe.plans import solutions as N

COMPONENTS, SAMPLES = [f"c{i}" for i in range(8)], ["s0", "s1", "s2_[hyper]_1", "s2_[hyper]_2", "s3"]


def made(k, rng):
    w = rng.dirichlet(np.full(8, 0.3), k).T
    h = rng.gamma(2.0, 50, (k, 5))
    return w, h


@pytest.fixture(scope="module")
def told(spark):
    rng = np.random.default_rng(3)
    rows, plain = [], {}
    for k in (2, 3):
        w0, h0 = made(k, rng)
        for cat in range(3):
            for run in range(4):
                at = rng.permutation(k)
                w, h = (w0 * rng.uniform(0.8, 1.2, w0.shape))[:, at], (h0 * rng.uniform(0.8, 1.2, h0.shape))[at]
                rows.append((k, cat, run, -float(rng.uniform(5, 6)), w.ravel().tolist(), h.ravel().tolist()))
                plain.setdefault(k, []).append((w, h, np.argsort(at), -rows[-1][3]))
    v = w0 @ h0
    runs = spark.createDataFrame(rows, "k int, catalogue int, run int, score double, w array<double>, h array<double>")
    return N.consensus_of(runs, COMPONENTS, SAMPLES, v), plain, v


def whole(m):
    return np.stack([m[:, 0], m[:, 1], m[:, 2] + m[:, 3], m[:, 4]], axis=1)


def spread(x, axis=0):
    return np.stack([x.mean(axis), x.std(axis, ddof=1), x.min(axis), x.max(axis)])


def test_signatures_exposures_and_statistics(spark, told):
    found, plain, v = told
    assert found.alignment.count() == 12 * 5
    sig, expo = found.signature.toPandas(), found.exposure.toPandas()
    stats, samples, numbers = found.stats_signature.toPandas(), found.stats_sample.toPandas(), found.stats.toPandas().set_index("signature_number")
    for k, runs in plain.items():
        ws = np.stack([solvers.scale_solution(w, h)[0][:, o] for w, h, o, _ in runs])
        hs = np.stack([whole(solvers.scale_solution(w, h)[1])[o] for w, h, o, _ in runs])
        order = np.argsort(-ws.mean(axis=0).sum(axis=0), kind="stable")
        ws, hs = ws[:, :, order], hs[:, order]
        of = lambda d, s, *c: d[(d.k == k) & (d.sig == f"Sig{s + 1}")].sort_values(list(c)) if c else d[(d.k == k) & (d.sig == f"Sig{s + 1}")]  # noqa: B023,E731
        for s in range(k):
            assert np.allclose(of(sig, s, "component")[["weight", "sd", "least", "most"]].to_numpy().T, spread(ws[:, :, s]))
            assert np.allclose(of(sig, s, "component").share, ws[:, :, s].mean(axis=0) / ws[:, :, s].mean(axis=0).sum())
            assert np.allclose(of(expo, s, "sample")[["amount", "sd", "least", "most"]].to_numpy().T, spread(hs[:, s]))
            u = [ws[:, :, j] / np.linalg.norm(ws[:, :, j], axis=1)[:, None] for j in range(k)]
            upper = np.triu_indices(len(runs), 1)
            within = (u[s] @ u[s].T)[upper]
            cross = max(((u[s] @ u[j].T)[upper] for j in range(k) if j != s), key=np.mean)
            r = of(stats, s).iloc[0]
            four = lambda name: [r[f"{name}_{c}"] for c in ("mean", "sd", "min", "max")]  # noqa: B023,E731
            assert np.allclose(four("similarity"), spread(within)) and np.allclose(four("cross_similarity"), spread(cross))
            a, b = 1 - within.mean(), 1 - cross.mean()
            assert r.silhouette == pytest.approx((b - a) / max(a, b)) and r.kld == pytest.approx(min(x[3] for x in runs))
            rank = lambda x: np.argsort(np.argsort(x))
            cor = np.array([np.corrcoef(rank(x[s]), rank(x[j]))[0, 1] for x in hs for j in range(k) if j != s])
            good = cor[cor > 1e-12] * (cor > 1e-12).mean()
            assert np.allclose(four("expo_pos_cor"), np.nan_to_num(spread(good)) if len(good) > 1 else [*good, 0, *good, *good] if len(good) else [0] * 4, atol=1e-9)
        made = np.stack([w @ whole(h) for w, h, _, _ in runs])
        target = whole(v)
        errors = {
            "cosine_distance": 1 - (made * target).sum(axis=1) / np.linalg.norm(made, axis=1) / np.linalg.norm(target, axis=0),
            "l1": np.abs(made - target).sum(axis=1),
            "l2": np.linalg.norm(made - target, axis=1),
        }
        mine = samples[samples.k == k].sort_values("sample")
        assert mine["sample"].tolist() == ["s0", "s1", "s2", "s3"]
        for c, e in errors.items():
            assert np.allclose(mine[[f"{c}_{x}" for x in ("mean", "sd", "min", "max")]].to_numpy().T, spread(e))
        u = made / np.linalg.norm(made, axis=1)[:, None]
        off = ~np.eye(len(runs), dtype=bool)
        mean = np.array([[(u[:, :, i] @ u[:, :, j].T)[off].mean() for j in range(4)] for i in range(4)])
        for i, got in enumerate(mine.silhouette):
            a, b = 1 - mean[i, i], 1 - np.delete(mean[i], i).max()
            assert got == pytest.approx((b - a) / max(a, b))
        assert numbers.loc[k].l2_error == pytest.approx(errors["l2"].mean()) and numbers.loc[k].silhouette == pytest.approx(stats[stats.k == k].silhouette.mean())
    best = found.rank.orderBy(F.desc("aggregate"), F.desc("signature_number")).first()
    assert found.suggested == best.signature_number
    s, e = found.best()
    assert s.select("sig").distinct().count() == found.suggested and e.count() == 4 * found.suggested
    assert e.groupBy("sample").agg(F.sum("rel").alias("r")).where("abs(r - 1) > 1e-9").count() == 0


def test_alignment_mends_a_bad_start(spark):
    # the best run is odd: centroids move to where the others agree
    rng = np.random.default_rng(5)
    w0 = np.eye(4)[:, :3] + 0.05
    rows = [(3, 0, 0, -1.0, np.array([[1.0, 0.6, 0.1], [0.5, 1.0, 0.1], [0.1, 0.1, 1.0], [0.3, 0.1, 0.1]]).ravel().tolist())]
    truth = {}
    for run in range(1, 9):
        at = rng.permutation(3)
        truth[run] = at
        rows.append((3, 0, run, -2.0, (w0[:, at] * rng.uniform(0.9, 1.1, (4, 3))).ravel().tolist()))
    placed = N.align(spark.createDataFrame(rows, "k int, catalogue int, run int, score double, w array<double>")).collect()
    names = {}
    for r in placed:
        if r.run:
            names.setdefault(r.sig, set()).add(int(truth[r.run][r.col]))
    assert sorted(map(tuple, names.values())) == [(0,), (1,), (2,)]


def test_whole_extraction_and_rounds(spark):
    rng = np.random.default_rng(7)
    w = np.array([[0.5, 0.4, 0.1, 0, 0, 0], [0, 0, 0, 0.2, 0.3, 0.5]]).T
    rows = [(f"s{j}", f"c{i}", int(n)) for j in range(9) for i, n in enumerate(rng.poisson(w @ (rng.gamma(2, 150, 2) * [(1, 0), (0, 1), (1, 1)][j % 3])))]  # pure samples make the signatures unique
    rows += [("s0", "rare", 1), ("none", "c0", 0)]
    c = spark.createDataFrame(rows, "sample string, component string, n long")
    found = N.consensus_extract(c, [2, 3], n_bootstrap=3, n_run=4, min_contribution=0.002, n_iter=300)
    sig, expo = found.best(2)
    assert found.suggested in (2, 3) and sig.where("component = 'rare' AND weight = 0").count() == 2 and expo.select("sample").distinct().count() == 9
    truth = w / w.sum(axis=0)
    got = sig.where("component != 'rare'").toPandas().pivot(index="component", columns="sig", values="share").sort_index().to_numpy()
    assert min(max(solvers.cosine(g, t) for t in truth.T) for g in got.T) > 0.97
    assert found.stats_sample.where("k = 2 AND silhouette IS NULL").count() == 0
    one = N.consensus_extract(c, [2], n_bootstrap=1, n_run=1, n_iter=50, only_core=True)
    assert one.suggested is None and one.stats_signature.where("similarity_mean < 0.999999").count() == 0 and one.stats_sample.where("silhouette IS NOT NULL").count() == 0
    rounds = N.consensus_iterative(c, [2], threshold=0.9999999, n_bootstrap=2, n_run=2, n_iter=50)
    assert len(rounds) == 1  # all samples are under the threshold
    assert X.best_practice(c.where("component != 'rare'"), [2], 2, 2, n_iter=50).count() == 12
