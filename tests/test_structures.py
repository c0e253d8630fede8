"""Structures for size: the interval index, sequences by lines, clustering by kinds and chains."""

import random
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.operators import intervals as I
from locusframe.operators import segments as S
from locusframe.operators.interval_index import IntervalIndex
from locusframe.plans import extraction as X
from locusframe.sources import readers


def some(rnd, n, span=1000):
    rows = [(rnd.choice(["a", "b", None]), s := rnd.randrange(span), s + rnd.choice([-1, 0, 1, 7, 90, span])) for _ in range(n)]
    return [*rows, ("a", None, 5), ("a", 5, None), ("a", 0, 3 * span)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_index_joins_as_the_plain_join(spark, monkeypatch, how):
    rnd = random.Random(1)
    left, right = [(i, *r) for i, r in enumerate(some(rnd, 150))], [(*r, i, f"x{i}" if i % 3 else None) for i, r in enumerate(some(rnd, 200))]
    a = spark.createDataFrame(left, "id long, c string, s long, e long")
    b = spark.createDataFrame(right, "rc string, rs long, re long, k long, t string")
    out = {}
    for dense in (0, 10**9):
        monkeypatch.setattr(I, "DENSE", dense)
        j = I.overlap_join(a, b, ("c", "s", "e"), ("rc", "rs", "re"), how)
        assert ("MapInArrow" in j._jdf.queryExecution().executedPlan().toString()) == (dense == 0)
        out[dense] = sorted(map(repr, map(tuple, j.where("s <= e OR k IS NULL AND s > e" if how == "left" else "s <= e").collect()))), j.columns
    ok = lambda c, s, e: None not in (c, s, e) and s <= e
    pairs = {(i, k) for i, c, s, e in left for rc, rs, re, k, _ in right if ok(c, s, e) and ok(rc, rs, re) and rc == c and s <= re and e >= rs}
    assert out[0][1] == out[10**9][1]
    monkeypatch.setattr(I, "DENSE", 0)
    j = I.overlap_join(a, b, ("c", "s", "e"), ("rc", "rs", "re"), how)
    if how == "left_semi":
        assert sorted(r.id for r in j.collect()) == sorted({i for i, _ in pairs})
    else:
        want = pairs | ({(i, None) for i in range(len(left)) if i not in {x for x, _ in pairs}} if how == "left" else set())
        assert sorted(((r.id, r.k) for r in j.collect()), key=repr) == sorted(want, key=repr)
    assert I.overlap_join(a.limit(0), b, ("c", "s", "e"), ("rc", "rs", "re"), how).count() == 0


@pytest.mark.parametrize("small", [None, False])
@pytest.mark.parametrize("end", ["s", "e"])
def test_first_match_looks_each_row_up_once(spark, monkeypatch, end, small):
    rnd = random.Random(2)
    left, right = [(i // 2, *r) for i, r in enumerate(some(rnd, 300, 500))], [(*r, f"x{i}" if i % 3 else None) for i, r in enumerate(some(rnd, 200))]
    right += [("b", 700, 700 + i % 50, f"y{i}") for i in range(400)]
    left = [(i, c, s, s if end == "s" else e) for i, c, s, e in left if None in (c, s, e) or s <= e]
    a = spark.createDataFrame(left, "id long, c string, s long, e long")
    b = spark.createDataFrame(right, "rc string, rs long, re long, gene string")
    want = {}
    for i, c, s, e in left:
        for rc, rs, re, gene in right:
            if None not in (c, s, e, rc, rs, re) and rs <= re and rc == c and s <= re and e >= rs:
                want[i] = min(want.get(i, (10**9,)), (rs, re, gene is not None, gene or ""))
    got = I.first_match(a, b.where("rs IS NULL OR re IS NULL OR rs <= re"), ("c", "s", end), ("rc", "rs", "re"), ["id"], "gene", small)
    assert {r.id: r.gene for r in got.collect()} == {i: w[3] or None for i, w in want.items()}
    monkeypatch.setattr(I, "overlap_join", None)  # pairs of a row with all that overlap it are never made
    assert I.first_match(a, b, ("c", "s", end), ("rc", "rs", "re"), ["id"], "gene", small).count() > 0
    assert I.first_match(a, b.limit(0), ("c", "s", end), ("rc", "rs", "re"), ["id"], "gene", small).count() == 0


def test_bands_meet_merged_stretches(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice("st"), rnd.choice("ab"), s := rnd.randrange(1000), s + rnd.choice([-1, 0, 1, 9, 60]), rnd.randrange(5)) for _ in range(400)] + [("u", "a", None, 9, 1)]
    bands = [(c, i * 10, i * 10 + rnd.choice([3, 9, 25]), f"b{i}") for c in "ab" for i in range(110)]
    d = spark.createDataFrame(rows, "sample string, chromosome string, start_pos long, end_pos long, seg_val int")
    seen, join = [], S.overlap_join
    monkeypatch.setattr(S, "overlap_join", lambda left, *a: seen.append(left) or join(left, *a))
    got = {(r.chrom, r.band): (round(r.amp * 3), round(r["del"] * 3)) for r in S.freq_by_band(d, spark.createDataFrame(bands, "chrom string, start_pos long, end_pos long, band string")).collect()}
    ok = [r for r in rows if r[2] is not None and r[2] <= r[3]]
    meets = lambda c, a, z, f: len({r[0] for r in ok if r[1] == c and r[2] <= z and r[3] >= a and f(r[4])})
    assert got == {(c, n): (meets(c, a, z, lambda v: v > 2), meets(c, a, z, lambda v: v < 2)) for c, a, z, n in bands}
    assert seen[0].count() < 150  # 400 segments before
    a, b = seen[0].alias("a"), seen[0].alias("b")
    assert a.join(b, ["sample", "chromosome", "gain"]).where("a.start_pos < b.start_pos AND a.end_pos >= b.start_pos").count() == 0


def test_a_probe_looks_at_little():
    n = 200_000
    start = np.arange(n) * 10
    end = start + 9
    start, end = np.append(start, 0), np.append(end, 10 * n)  # one interval over all
    index = IntervalIndex(pa.array(["c"] * (n + 1)), pa.array(start), pa.array(end))
    rng = np.random.default_rng(1)
    s = rng.integers(0, 10 * n, 20_000)
    began = time.perf_counter()
    left, right = index.probe(pa.array(["c"] * len(s)), pa.array(s), pa.array(s + 15))
    assert time.perf_counter() - began < 1.0
    assert np.bincount(left).tolist() == (np.minimum((s + 15) // 10, n - 1) - s // 10 + 2).tolist() and np.bincount(right)[n] == len(s)


def test_bands_through_the_index(spark, monkeypatch):
    rnd = random.Random(2)
    segments = spark.createDataFrame([(f"s{rnd.randrange(6)}", rnd.choice(["chr1", "chr2"]), a := rnd.randrange(5000), a + rnd.randrange(900), rnd.randrange(5)) for _ in range(200)], "sample string, chromosome string, start_pos long, end_pos long, seg_val long")
    bands = spark.createDataFrame([(c, i * 20, i * 20 + 19, f"b{i}") for c in ("chr1", "chr2") for i in range(300)], "chrom string, start_pos long, end_pos long, band string")
    got = {}
    for dense in (0, 10**9):
        monkeypatch.setattr(I, "DENSE", dense)
        got[dense] = [sorted(map(repr, map(tuple, d.collect()))) for d in (S.freq_by_band(segments, bands), S.band_values(segments, bands))]
    assert got[0] == got[10**9]
    rows = segments.collect()
    for r in S.freq_by_band(segments, bands).where("band IN ('b0', 'b100', 'b299')").collect():
        on = [x for x in rows if x.chromosome == r.chrom and x.start_pos <= r.end_pos and x.end_pos >= r.start_pos]
        assert r.amp == len({x.sample for x in on if x.seg_val > 2}) / 6 and r["del"] == len({x.sample for x in on if x.seg_val < 2}) / 6


def plain_words(sequences, k):
    n = Counter()
    for s in sequences:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                other = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
                n[min(w, other) if k % 2 == 0 else w if w[k // 2] in "CT" else other] += 1
    return n


@pytest.mark.parametrize("block", [None, 700])
def test_sequences_by_lines(spark, tmp_path, block):
    rnd = random.Random(4)
    seqs = {f"chr{i}": "".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=k)) for i, k in enumerate([950, 0, 40, 3000, 1, 100, 99, 101, 2500])}
    for part, names in (("a.fa", list(seqs)[:4]), ("b.fa", list(seqs)[4:])):
        body = "no name yet\n" if part == "b.fa" else ""
        for n in names:
            body += f">{n} described\r\n" + "".join(seqs[n][i : i + 60].lower() + "\n" for i in range(0, len(seqs[n]), 60)) + "\n"
        (tmp_path / part).write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        ref = readers.read_reference(spark, str(tmp_path), chunk=100, overlap=20)
        rows = ref.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.chrom, r.chunk_id): r.seq for r in rows}
    want = {(n, k): s[k * 100 - min(20, k * 100) :][:140] for n, s in seqs.items() for k in range(-(-len(s) // 100))}
    assert got == want and len(rows) == len(want) and max(map(len, got.values())) <= 140
    for k in (1, 2, 3, 5, 20):
        o = {r.component: r.n for r in readers.opportunities(ref, k, 100, 20).collect()}
        assert o == dict(plain_words(seqs.values(), k))
    with pytest.raises(ValueError):
        readers.opportunities(ref, 21, 100, 20)
    parts = spark.createDataFrame([("A[C>T]G",), ("T[T>A]A",)], "component string")
    words = readers.opportunities(ref, 3, 100, 20)
    plain = plain_words(seqs.values(), 3)
    assert {r.component: r.n for r in readers.component_opportunities(words, parts).collect()} == {"A[C>T]G": plain["ACG"], "T[T>A]A": plain["TTA"]}


def plain_linkage(dist, weight):
    groups = {i: [i] for i in range(len(dist))}
    heights = []
    mean = lambda a, b: np.average(dist[np.ix_(a, b)], weights=np.outer(weight[a], weight[b]))
    while len(groups) > 1:
        h, a, b = min((mean(groups[i], groups[j]), i, j) for i in groups for j in groups if i < j)
        heights.append(h)
        groups[a] += groups.pop(b)
    return heights


def test_linkage_by_chains():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 30):
        x, w = rng.normal(size=(n, 3)), rng.integers(1, 6, n).astype(float)
        dist = solvers.distances(x)
        assert np.allclose(dist, np.linalg.norm(x[:, None] - x[None], axis=2), atol=1e-7)
        for weight in (np.ones(n), w):
            merges = solvers.hclust(dist, weight)
            assert np.allclose([h for *_, h in merges], plain_linkage(dist, weight))
            assert sorted(v for a, b, _ in merges for v in (a, b)) == list(range(2 * n - 2))
    # an item of weight w is w equal items
    x, w = rng.normal(size=(12, 2)), rng.integers(1, 5, 12)
    many = np.repeat(np.arange(12), w)
    label = solvers.cut_tree(solvers.hclust(solvers.distances(x), w), 12, 4)
    spread = solvers.cut_tree(solvers.hclust(solvers.distances(x)[np.ix_(many, many)]), len(many), 4)
    assert spread.tolist() == label[many].tolist()
    assert np.allclose(solvers.silhouette(solvers.distances(x), label, w)[many], solvers.silhouette(solvers.distances(x)[np.ix_(many, many)], label[many]))
    began = time.perf_counter()
    big = solvers.distances(rng.normal(size=(4000, 4)))
    assert len(solvers.hclust(big)) == 3999 and time.perf_counter() - began < 10


def test_groups_by_kinds_and_sums(spark):
    rng = np.random.default_rng(6)
    w = rng.dirichlet(np.full(6, 0.3), 3).T
    rows = [(f"s{j:02d}", f"c{i}", int(v)) for j in range(24) for i, v in enumerate(rng.poisson(w[:, j % 3] * 400))]
    c = spark.createDataFrame(rows, "sample string, component string, n long")
    got = X.sample_groups(c, 3, n_run=6, n_iter=200).toPandas().sort_values("sample")
    runs = X._factorise(c, [(3, 0, r, X.SEED + r) for r in range(6)], "KL", False, 200)[2].collect()
    label = np.stack([np.array(r.h).reshape(3, -1).argmax(axis=0) for r in runs])
    share = (label[:, :, None] == label[:, None]).mean(axis=0)
    grp = solvers.cut_tree(solvers.hclust(1 - share), 24, 3)
    assert len({*zip(grp, got.grp, strict=True)}) == len(set(got.grp)) and np.allclose(got.silhouette, solvers.silhouette(1 - share, grp))
    m = {(r.a, r.b): r.share for r in X.consensus_matrix(c, 3, n_run=6, n_iter=200).collect()}
    assert len(m) == 24 * 24 and all(m[f"s{i:02d}", f"s{j:02d}"] == pytest.approx(share[i, j]) for i in range(24) for j in range(24))
    by = X.sample_groups(c, 3, method="samples", n_run=3, n_iter=200).toPandas().sort_values("sample")
    assert len({*zip(by.grp, [j % 3 for j in range(24)], strict=True)}) == 3 and by.silhouette.min() > 0.5
    rel = X.extract(c, 3, 3, n_iter=200)[1].select("sample", "sig", "rel")
    k = X.kmeans_groups(rel, 3).toPandas().sort_values("sample")
    x = rel.toPandas().pivot(index="sample", columns="sig", values="rel").sort_index().to_numpy()
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(k.silhouette, solvers.silhouette(square, k.grp.to_numpy()), atol=1e-9)
    with pytest.raises(ValueError):
        X.sample_groups(c, 3, method="other")


def test_cophenetic_of_weighted_items_as_of_copies():
    rng = np.random.default_rng(4)
    x, weight = rng.random((9, 3)), np.array([1, 1, 3, 2, 1, 4, 1, 1, 2])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    copy = np.repeat(np.arange(9), weight)
    whole = d[np.ix_(copy, copy)]
    merges = solvers.hclust(whole)
    members, height = {i: [i] for i in range(len(copy))}, np.zeros_like(whole)
    for step, (a, b, h) in enumerate(merges):
        p, q = members.pop(a), members.pop(b)
        for i in p:
            for j in q:
                height[i, j] = height[j, i] = h
        members[len(copy) + step] = p + q
    at = np.triu_indices(len(copy), 1)
    want = np.corrcoef(whole[at], height[at])[0, 1]
    assert solvers.cophenetic(d, solvers.hclust(d, weight), weight) == pytest.approx(want)
    assert solvers.cophenetic(whole, merges) == pytest.approx(want)
    assert solvers.cophenetic(np.zeros((1, 1)), []) == 1.0


def test_survey_by_kinds_as_over_all_samples(spark):
    rng = np.random.default_rng(6)
    sig = rng.dirichlet(np.full(8, 0.4), 3)
    rows = [(f"s{i:02d}", f"c{j}", int(v)) for i in range(30) for j, v in enumerate(rng.multinomial(400, sig[i % 3] * 0.8 + sig[(i + 1) % 3] * 0.2))]
    catalog = spark.createDataFrame(rows, "sample string, component string, n long")
    got = {r.k: r for r in X.estimate(catalog, [2, 4], n_run=6, seed=3, n_iter=60).collect()}
    assert set(got) == {2, 4}
    _, samples, runs = X._factorise(catalog, [(k, 0, r, 3 + r) for k in (2, 4) for r in range(6)], "KL", False, 60)
    _, _, v = X.catalogue_matrix(catalog)
    for k, r in got.items():
        mine = sorted((x for x in runs.collect() if x.k == k), key=lambda x: (-x.score, x.run))
        label = [np.array(x.h).reshape(k, -1).argmax(axis=0) for x in mine]
        share = np.mean([a[:, None] == a[None] for a in label], axis=0)
        assert r.dispersion == pytest.approx((4 * (share - 0.5) ** 2).mean())
        w, h = np.array(mine[0].w).reshape(-1, k), np.array(mine[0].h).reshape(k, -1)
        assert r.rss == pytest.approx(((v - w @ h) ** 2).sum()) and r.residual == pytest.approx(-mine[0].score)
        dist = 1 - share
        merges = solvers.hclust(dist)
        assert r.cophenetic == pytest.approx(solvers.cophenetic(dist, merges), abs=0.02)  # heights of ties may differ
        kinds = len(set(zip(*[a.tolist() for a in label], strict=True)))
        if kinds > k:
            assert r.silhouette == pytest.approx(solvers.silhouette(dist, solvers.cut_tree(merges, 30, k)).mean(), abs=0.05)


def test_survey_of_more_samples_than_pairs_allow(spark, monkeypatch):
    rows = [(f"s{i:03d}", f"c{j}", 50 if i % 2 == j // 2 else 1) for i in range(200) for j in range(4)]
    catalog = spark.createDataFrame(rows, "sample string, component string, n long")
    monkeypatch.setattr(X, "MATRIX_LIMIT", 5000)  # 200 x 200 samples are over it
    (r,) = X.estimate(catalog, [2], n_run=4, n_iter=200).collect()
    assert r.cophenetic == pytest.approx(1) and r.dispersion == pytest.approx(1) and r.silhouette == pytest.approx(1)


def test_linkage_of_unit_vectors_without_distances(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet(np.full(6, 0.5), 40)
    unit = p / np.linalg.norm(p, axis=1)[:, None]
    dist = np.maximum(1 - unit @ unit.T, 0)
    np.fill_diagonal(dist, 0)
    want, got = solvers.hclust(dist), solvers.cosine_linkage(unit)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    rows = [(f"g{i:02d}", f"c{j}", float(v)) for i, x in enumerate(p) for j, v in enumerate(x)]
    table = X.cluster_iterations(spark.createDataFrame(rows, "sig string, component string, weight double"), [1, 2, 7, 40, 99]).orderBy("k", "sig").collect()
    assert [r.k for r in table] == [2] * 40 + [7] * 40
    for k in (2, 7):
        label = solvers.cut_tree(want, 40, k)
        mine = [r for r in table if r.k == k]
        assert [r.cluster for r in mine] == label.tolist()
        assert np.allclose([r.silhouette for r in mine], solvers.silhouette(dist, label))


def test_linkage_of_equal_vectors():
    unit = np.repeat(np.eye(3), 4, axis=0)
    label = solvers.cut_tree(solvers.cosine_linkage(unit), 12, 3)
    assert label.tolist() == [0] * 4 + [1] * 4 + [2] * 4 and solvers.cosine_silhouette(unit, label).tolist() == [1.0] * 12
    assert solvers.cosine_linkage(unit[:1]) == []
