import itertools
import math

import numpy as np
import pytest

from locusframe.functions import solvers as S
from locusframe.functions import tests_of_significance as T
from locusframe.operators.rearrangements import RS_32, RS_38, segment_constant
from locusframe.operators.classify import CN_40, CN_48, component_bins, vocabulary_t
from locusframe.operators.variants import DBS_78, ID_83, SBS_96, doublet_pairs


def test_vocabularies():
    assert [len(set(x)) for x in (CN_40, CN_48, SBS_96, DBS_78, ID_83, RS_38, RS_32)] == [40, 48, 96, 78, 83, 38, 32]
    assert len(component_bins()) == 80 and len(doublet_pairs()) == 144 and len(set(doublet_pairs().values())) == 78
    assert len(vocabulary_t()) == len(set(vocabulary_t()))


def test_fisher_by_enumeration():
    for a, b, c, d in [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 4, 1), (7, 7, 7, 7)]:
        n, r, k = a + b + c + d, a + b, a + c
        p = {x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r) for x in range(max(0, r - n + k), min(r, k) + 1)}
        assert T.fisher(a, b, c, d)[0] == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))
        assert T.fisher(a, b, c, d, "greater")[0] == pytest.approx(sum(v for x, v in p.items() if x >= a))
    assert T.fisher(3, 1, 1, 3)[1] == pytest.approx(6.408309, abs=1e-4)


def test_distributions():
    assert T.t_tail(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert T.f_tail(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.studentized_range_tail(3.877676, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert T.benjamini_hochberg(np.array([0.01, 0.04, 0.03, 0.2])).tolist() == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_rank_sum_by_enumeration():
    n1, n2 = 4, 5
    ws = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for w in range(n1 * n2 + 1):
        low = sum(x <= w for x in ws) / len(ws)
        high = sum(x >= w for x in ws) / len(ws)
        assert T.rank_sum(w, n1, n2, 0) == pytest.approx(min(1, 2 * min(low, high)))


@pytest.mark.parametrize("seed", range(5))
def test_least_squares_optimal(seed):
    rng = np.random.default_rng(seed)
    p = rng.random((12, 5))
    p /= p.sum(axis=0)
    m = rng.random(12)
    m /= m.sum()
    e = S.simplex_ls(p, m)
    assert e.min() >= 0 and e.sum() == pytest.approx(1)
    x = S.nnls(p, m)
    for _ in range(300):  # no feasible point nearby is better
        y = np.maximum(e + rng.normal(0, 0.05, 5), 0)
        y /= y.sum()
        assert np.linalg.norm(m - p @ e) <= np.linalg.norm(m - p @ y) + 1e-9
        assert np.linalg.norm(m - p @ x) <= np.linalg.norm(m - p @ np.maximum(x + rng.normal(0, 0.05, 5), 0)) + 1e-9
    assert np.linalg.norm(m - p @ S.anneal(p, m)) <= np.linalg.norm(m - p @ e) * 1.05 + 1e-3


def test_fit_recovers_exposure():
    w = np.arange(1, 7, dtype=float).reshape(3, 2, order="F")
    w /= w.sum(axis=0)
    h = np.array([[2, 3, 1, 1], [5, 6, 9, 2]], float)
    for method in ("QP", "NNLS"):
        for j in range(4):
            got = S.fit_one(w @ h[:, j], w, method) * h[:, j].sum()
            assert got == pytest.approx(h[:, j], abs=1e-6)
    assert not S.fit_one(np.zeros(3), w).any()


def test_factorisations():
    rng = np.random.default_rng(0)
    w, h = rng.random((20, 3)) ** 3, rng.random((3, 30)) * 50
    v = rng.poisson(w @ h * 10).astype(float)
    a, b, d = S.nmf(v, 3, 1)
    assert d < 0.05 * v.sum() and S.kl(v + 1e-12, a @ b) == pytest.approx(d)
    for prior in ("L1KL", "L2KL", "L1W.L2H"):
        a, b, _ = S.bayes_nmf(v, 8, 1, prior, 3000)
        assert np.linalg.norm(v - a @ b) < 0.35 * np.linalg.norm(v)
    x, y = S.scale_solution(a, b)
    assert x.sum(axis=0) == pytest.approx(a.sum(axis=0) * b.sum(axis=1))
    mask = np.ones((3, 30))
    mask[0, :5] = 0
    assert not S.attribute(v, w, mask, 50)[0, :5].any()


def test_assignment_and_alignment():
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.random((5, 5))
        best = min(itertools.permutations(range(5)), key=lambda p: sum(c[i, j] for i, j in enumerate(p)))
        assert S.assignment(c).tolist() == list(best)
    base = rng.random((30, 4))
    perms = [rng.permutation(4) for _ in range(6)]
    runs = [base] + [base[:, p] + rng.random((30, 4)) * 0.05 for p in perms]
    for r, o in zip(runs, S.align_runs(runs), strict=True):
        assert np.abs(r[:, o] - base).max() < 0.1


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.3, (50, 2)), rng.normal(1, 0.3, (50, 2))])
    assert np.bincount(S.bottom_up_groups(x, 10)).tolist() == [10] * 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    label = S.cut_tree(S.hclust(d), 100, 2)
    assert len(set(label)) == 2 and -1 <= S.silhouette(d, label).mean() <= 1


def test_piecewise_constant():
    y = np.r_[np.random.default_rng(0).normal(10, 1, 40), np.random.default_rng(1).normal(100, 1, 30)]
    assert [(a, b) for a, b, _ in segment_constant(y)] == [(0, 40), (40, 70)]
    assert segment_constant(np.zeros(0)) == []
