"""Queries that do the whole job: no row of their tables is left out."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import stats as T
from locusframe.plans import extraction as X
from locusframe.plans.queries import QUERIES
from locusframe.sources.domain import view
from tests.conftest import SF


def test_overlap_left_keeps_every_segment(spark):
    key = ["sample", "chromosome", "start_pos", "end_pos", "t1"]
    out = QUERIES["interval_overlap_left"](spark, SF)
    s = view(spark, SF, "segments").select(key)
    assert s.exceptAll(out.select(key)).count() == 0
    assert out.select(key).distinct().count() == s.distinct().count()


def test_complement_keeps_every_segment_and_fills_gaps(spark):
    s = view(spark, SF, "segments")
    out = QUERIES["complement_chromosomes"](spark, SF)
    samples, ones = s.select("sample").distinct().count(), s.select("sample").distinct().where("sample LIKE '%1'").count()
    assert 0 < ones < samples
    assert s.select("sample", "start_pos", "end_pos", "seg_val").exceptAll(out.select("sample", "start_pos", "end_pos", "seg_val")).count() == 0
    assert out.count() == s.count() + samples  # each sample lacks chr7 or chrX
    assert out.where("chromosome = 'chrY'").count() == 0
    assert out.where("chromosome IN ('chr7', 'chrX') AND start_pos = 1 AND seg_val = 2").groupBy("chromosome").agg(F.count("*").alias("n")).count() == 2


def tau_b(rows):
    sign = lambda v: (v > 0) - (v < 0)
    s = nx = ny = 0
    for i, (x, y) in enumerate(rows):
        for x2, y2 in rows[:i]:
            a, b = sign(x - x2), sign(y - y2)
            s, nx, ny = s + a * b, nx + a * a, ny + b * b
    return s / (nx * ny) ** 0.5


def test_kendall_counts_every_row(spark):
    rows = [tuple(r) for r in view(spark, SF, "traits").select("score", "extra").collect()]
    assert QUERIES["kendall_tau"](spark, SF).first().tau == pytest.approx(tau_b(rows), abs=1e-6)


@pytest.mark.parametrize("cells", [5, 10_000])
def test_kendall_in_blocks_without_pairs(spark, monkeypatch, cells):
    rnd = random.Random(3)
    monkeypatch.setattr(T, "KENDALL_CELLS", cells)
    rows = [(x := rnd.choice([7, rnd.randrange(60)]), rnd.choice([-1.5, x / 3 + rnd.random(), rnd.randrange(9) * 1.0])) for _ in range(300)]
    d = spark.createDataFrame([*rows, (None, 1.0), (3, None)], "x long, y double")
    out = T.kendall(d, "x", "y")
    assert out.first().tau == pytest.approx(tau_b(rows), abs=1e-12)
    assert "x2" not in out._jdf.queryExecution().toString()  # no join of cells by an inequality
    assert T.kendall(spark.createDataFrame([(1, 2), (1, 3)], "x long, y long"), "x", "y").first().tau is None
    assert T.kendall(d.limit(0), "x", "y").first().tau is None


@pytest.mark.parametrize(
    ("name", "runs", "ranks", "catalogues", "n_iter"),
    [("nmf_bayes", 10, {25}, 1, 20_000), ("nmf_best_practice", 2000, {2, 3}, 20, 1000), ("nmf_kl", 10, {3}, 1, 2000), ("nmf_survey", 30, {2, 3, 4}, 1, 500), ("nmf_iterative", 10, {2}, 1, 1000), ("nmf_consensus_groups", 20, {3}, 1, 500)],
)
def test_extraction_queries_run_in_full(spark, monkeypatch, name, runs, ranks, catalogues, n_iter):
    def seen(catalog, tasks, method, resample, iterations, folder=None):
        assert (len(tasks), {t[0] for t in tasks}, len({t[1] for t in tasks}), iterations) == (runs, ranks, catalogues, n_iter)
        raise StopIteration

    monkeypatch.setattr(X, "_factorise", seen)
    with pytest.raises(StopIteration):
        QUERIES[name](spark, SF)


def test_bootstrap_queries_take_100_resamples(spark, monkeypatch):
    kept, whole = [], X.fit_bootstrap
    monkeypatch.setattr(X, "fit_bootstrap", lambda *a, **k: kept.append(whole(*a, **k)) or kept[-1])
    QUERIES["fit_bootstrap"](spark, SF)
    QUERIES["bootstrap_p_values"](spark, SF)
    assert [d.select("type").distinct().count() for d in kept] == [101, 101]


def test_auto_extract_strategies(spark, monkeypatch):
    c = spark.createDataFrame([("s", "x", 1), ("s", "y", 1)], "sample string, component string, n long")
    with pytest.raises(ValueError, match="strategy"):
        X.auto_extract(c, strategy="best")
    with pytest.raises(ValueError, match="reference"):
        X.auto_extract(c, strategy="ms")
    # run 0 has the better posterior, run 1 the signatures nearer to the reference
    rows = [(2, 0, 0, 1, 9.0, 1, [1.0, 1.0], [2.0]), (2, 0, 1, 2, 5.0, 2, [1.0, 0.0, 0.0, 1.0], [1.0, 1.0])]
    monkeypatch.setattr(X, "_factorise", lambda *a: (["x", "y"], ["s"], spark.createDataFrame(rows, X._RUN)))
    ref = spark.createDataFrame([("A", "x", 1.0), ("B", "y", 1.0)], "sig string, component string, weight double")
    assert X.auto_extract(c, strategy="optimal")[0].select("sig").distinct().count() == 1
    assert X.auto_extract(c, strategy="ms", reference=ref)[0].select("sig").distinct().count() == 2


def test_rs32_by_segmentation(spark):
    whole = {tuple(r) for r in QUERIES["rs38_catalog"](spark, SF).select("sample", "component", "n").collect()}
    got = {tuple(r) for r in QUERIES["rs32_catalog"](spark, SF).select("sample", "component", "n").collect()}
    assert got and got == {r for r in whole if "<1Kb" not in r[1]}
