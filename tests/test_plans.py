"""Operators whose plans were made for size: same results as plain versions, no row lost."""

import random
import re
import time
from collections import Counter
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.functions import tests_of_significance as K
from locusframe.operators import catalog as C
from locusframe.operators import intervals as I
from locusframe.operators import rearrangements as R
from locusframe.operators import stats as T
from locusframe.operators import variants as V
from locusframe.plans import extraction as X
from locusframe.plans.queries import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_fisher_many(alternative):
    t = np.random.default_rng(2).integers(0, 70, (200, 4))
    t[:4] = 0
    want = [K.fisher(*map(int, x), alternative)[0] for x in t]
    for cells in (100, 1 << 20):
        assert np.allclose(K.fisher_many(*t.T, alternative=alternative, cells=cells), want, atol=1e-10)


def test_strand_by_stretches(spark):
    rnd = random.Random(4)
    genes = [(rnd.choice(["a", "b"]), s := rnd.randrange(200), s + rnd.randrange(40), rnd.choice("+-")) for _ in range(40)]
    muts = [(i, rnd.choice(["a", "b", "c"]), rnd.randrange(260), rnd.random() < 0.5) for i in range(300)] + [(7, "a", 5, True), (8, None, 5, True)]
    t = spark.createDataFrame(genes, "chrom string, start_pos long, end_pos long, strand string")
    got = V.strand_label(spark.createDataFrame(muts, "id long, chrom string, pos long, should_reverse boolean"), t).select("id", "chrom", "pos", "should_reverse", "strand_label").collect()

    def label(c, p, rev):
        on = {s for g, a, z, s in genes if g == c and a <= p <= z}
        return "N" if not on else "B" if len(on) > 1 else "T" if rev != (on == {"-"}) else "U"

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, c, p, r, label(c, p, r))) for i, c, p, r in muts)
    assert V.strand_label(spark.createDataFrame(muts[:3], "id long, chrom string, pos long, should_reverse boolean"), t.limit(0)).where("strand_label != 'N'").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("small", [None, False])
def test_points_in_bins(spark, how, small):
    rnd = random.Random(5)
    regions = [("a", s := rnd.randrange(300), s + rnd.choice([0, 3, 90]), k) for k in range(25)]
    points = [(i, rnd.choice("ab"), rnd.randrange(400)) for i in range(80)]
    p, r = spark.createDataFrame(points, "id long, c string, p long"), spark.createDataFrame(regions, "rc string, s long, e long, k long")
    got = sorted(tuple(x)[: 1 if how == "left_semi" else None] for x in I.overlap_join(p, r, ("c", "p", "p"), ("rc", "s", "e"), how, small=small).select("id", *["k"] * (how != "left_semi")).na.fill(-1).collect())
    hits = {i: [k for rc, s, e, k in regions if rc == c and s <= x <= e] for i, c, x in points}
    want = sorted((i,) for i in hits if hits[i]) if how == "left_semi" else sorted((i, k) for i, ks in hits.items() for k in (ks or [-1] * (how == "left")))
    assert got == want


@pytest.mark.parametrize("cells", [4, 10_000])
def test_ranks_in_blocks(spark, monkeypatch, cells):
    rnd = random.Random(6)
    monkeypatch.setattr(T, "KENDALL_CELLS", cells)
    rows = [(rnd.choice([5, rnd.randrange(40)]), rnd.random() < 0.4, rnd.randrange(12) * 0.5) for _ in range(200)] + [(None, True, 1.0)]
    d = spark.createDataFrame(rows, "x long, f boolean, y double")
    have = [r for r in rows if r[0] is not None]
    rank = lambda vs: [sum(b < a for b in vs) + (sum(b == a for b in vs) + 1) / 2 for a in vs]
    rx, ry = rank([r[0] for r in have]), rank([r[2] for r in have])
    got = T.rank_sum(d, F.col("f"), "x").first()
    n1 = sum(r[1] for r in have)
    assert (got.n1, got.n2) == (n1, len(have) - n1) and got.w == pytest.approx(sum(k for k, r in zip(rx, have) if r[1]) - n1 * (n1 + 1) / 2)
    assert T.correlations(d, ["x"], ["y"], rank=True).first().r == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-12)
    assert T.rank_sum(d.limit(0), F.col("f"), "x").first().n1 == 0


def test_clustered_by_sweep(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("st"), rnd.choice("12"), rnd.randrange(100), rnd.choice("12"), rnd.randrange(100)) for i in range(120)]
    rows.append(rows[3])
    regions = [(rnd.choice("st"), rnd.choice("12"), a := rnd.randrange(100), a + rnd.randrange(9)) for _ in range(12)]
    d = spark.createDataFrame(rows, "id long, sample string, chr1 string, start1 long, chr2 string, start2 long")
    got = R.label_clustered(d, ["id"], regions=spark.createDataFrame(regions, "sample string, chrom string, start_pos long, end_pos long"))
    inside = lambda s, c, p: any((s, c) == r[:2] and r[2] <= p <= r[3] for r in regions)
    want = [(*r, "clustered" if inside(r[1], r[2], r[3]) or inside(r[1], r[4], r[5]) else "non-clustered") for r in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_are_not_put_together_again(spark):
    d = spark.createDataFrame([("s", "1", 5, "2", 9, "lone")], "sample string, chr1 string, start1 long, chr2 string, start2 long, note string")
    regions = spark.createDataFrame([("s", "2", 8, 9)], "sample string, chrom string, start_pos long, end_pos long")
    plan = R.label_clustered(d, ["note"], regions=regions).select("sample", "clustered")._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "LogicalRDD" not in line]
    assert not any("Aggregate" in line or "note" in line for line in steps)  # what is not asked for is not shuffled


def test_hyper_split_limits(spark):
    c = spark.createDataFrame([(f"s{i}", "x", 10.0 + i) for i in range(20)] + [("big", "x", 5000.0)], "sample string, component string, n double")
    out = C.hyper_split(c)
    parts = out.where("sample LIKE 'big%'")
    assert parts.count() > 1 and C.hyper_collapse(out).where("sample = 'big'").first().n == pytest.approx(5000)
    with pytest.raises(ValueError, match="rounds"):
        C.hyper_split(c, max_rounds=1)


def test_fit_stops_on_unmatched_components(spark):
    c = spark.createDataFrame([("s", "x", 3), ("s", "lost", 1)], "sample string, component string, n long")
    sig = spark.createDataFrame([("A", "x", 1.0)], "sig string, component string, weight double")
    with pytest.raises(ValueError, match="lost"):
        X.fit(c, sig)


def test_all_pairs_are_refused_beyond_their_limit(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_KEYS", 3)
    d = spark.range(5).select(F.col("id").cast("string").alias("sig"), F.lit("x").alias("component"), F.lit(1.0).alias("weight"))
    with pytest.raises(ValueError, match="all pairs"):
        C.cosine_pairs(d, d, "sig", "sig")


@pytest.mark.parametrize("seed", range(6))
def test_segmentation_is_the_best_there_is(seed):
    rng = np.random.default_rng(seed)
    y = np.concatenate([rng.normal(m, 1, k) for m, k in zip(rng.normal(0, 6, 5), rng.integers(3, 40, 5), strict=True)])
    kmin = int(rng.integers(2, 6))
    sd = np.median(np.abs(np.diff(y))) * 1.4826 / np.sqrt(2) or 1.0
    worth = lambda cuts: sum(((y[a:b] - y[a:b].mean()) ** 2).sum() + 25.0 * sd**2 for a, b in cuts)
    best = {0: (0.0, [])}
    for j in range(kmin, len(y) + 1):
        options = [(best[i][0] + worth([(i, j)]), [*best[i][1], (i, j)]) for i in best if j - i >= kmin]
        best[j] = min(options, key=lambda x: x[0])
    got = [(a, b) for a, b, _ in R.segment_constant(y, 25.0, kmin)]
    assert got[0][0] == 0 and got[-1][1] == len(y) and worth(got) == pytest.approx(best[len(y)][0])


def test_segmentation_of_long_series_in_few_steps():
    rng = np.random.default_rng(5)
    noise = [rng.exponential(1000, n) for n in (12_000, 19, 0, 7_000, 20)]
    began = time.perf_counter()
    got = R.segment_all(noise)  # squares of the lengths took half a minute
    assert time.perf_counter() - began < 15
    assert [g[-1][1] if g else 0 for g in got] == [12_000, 19, 0, 7_000, 20]
    assert got == [R.segment_constant(y) for y in noise]


def test_segmentation_stays_sharp_behind_a_wide_gap():
    rng = np.random.default_rng(3)
    y = np.r_[rng.exponential(1e6, 30), 1e16, rng.exponential(1e6, 25), rng.exponential(1e7, 20), rng.exponential(1e6, 25)].round()
    penalty = Fraction(25 * (np.median(np.abs(np.diff(y))) * 1.4826 / np.sqrt(2)) ** 2)
    s = [Fraction(0), *accumulate(Fraction(int(v)) for v in y)]
    q = [Fraction(0), *accumulate(Fraction(int(v)) ** 2 for v in y)]
    best = {0: (-penalty, [])}
    for j in range(10, len(y) + 1):
        best[j] = min((best[i][0] + penalty + q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i), [*best[i][1], (i, j)]) for i in best if j - i >= 10)
    assert [(i, j) for i, j, _ in R.segment_constant(y)] == best[len(y)][1]  # sums from the beginning lost all below 10^16


@pytest.fixture
def some_sv(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in ("s1", "s2", "s3", None):
        for c in ("1", "2", None):
            for p in np.cumsum(np.r_[rng.integers(900, 1100, 40), rng.integers(0, 9, 30), rng.integers(900, 1100, 25)]):
                far = rng.integers(0, 3)
                rows.append((s, c, int(p), c if far else "3", int(p) + 200_000, int(p) + int(rng.choice([500, 5000])), str(rng.choice(["deletion", "inversion", "other"])) if far and c else "translocation"))
    rows += [("s1", "1", None, "2", 5, 9, "translocation"), ("lone", "1", 5, "2", 5, 9, "translocation"), ("lone", "2", None, "2", None, None, "deletion"), ("none", None, None, "1", None, 9, "translocation")]
    d = spark.createDataFrame(rows, "sample string, chr1 string, start1 long, chr2 string, start2 long, end2 long, svclass string")
    return R.label_size(d)


def test_rs_catalogue_by_segments_is_that_of_the_labels(spark, some_sv):
    known = R.low_distance_regions(some_sv).where("chrom IS NOT NULL AND sample IS NOT NULL")
    want = R.label_rs(R.label_clustered(some_sv, [], regions=known)).where("rs38 IS NOT NULL").groupBy("sample", "rs38").count()
    got = R.rs_catalogue(some_sv)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.where("component LIKE 'clustered%'").count() > 3


def test_rs_catalogue_by_steps_is_that_of_the_labels(spark, some_sv):
    x = R.distances(some_sv).join(R.mean_distances(some_sv), "sample").where("10 * dist < m AND chrom IS NOT NULL").selectExpr("sample", "chrom", "pos - dist AS start_pos", "pos AS end_pos")
    want = R.label_rs(R.label_clustered(some_sv, [], regions=x)).where("rs38 IS NOT NULL").groupBy("sample", "rs38").count()
    assert Counter(map(tuple, R.rs_catalogue(some_sv, R.by_steps).collect())) == Counter(map(tuple, want.collect()))


def test_rs_catalogue_over_batches(spark, some_sv, monkeypatch):
    kinds = F.array(*map(F.lit, R.KINDS))
    rows = some_sv.select("sample", F.array_position(kinds, R._kind()).cast("byte").alias("kind"), "chr1", "start1", "chr2", "start2", F.xxhash64("sample").alias("_key")).orderBy("_key").toArrow()
    whole = sorted(map(str, pa.Table.from_batches(R._by_samples(iter(rows.to_batches()), R.by_segments)).to_pylist()))
    monkeypatch.setattr(R, "ROWS", 1)
    parts = list(R._by_samples(iter(rows.combine_chunks().to_batches(max_chunksize=7)), R.by_segments))
    assert len(parts) > 3 and sorted(map(str, pa.Table.from_batches(parts).to_pylist())) == whole


@pytest.mark.parametrize("rule", ["by_segments", "by_steps"])
def test_rs_catalogue_in_one_shuffle_of_narrow_rows(some_sv, rule):
    plan = R.rs_catalogue(some_sv.withColumn("note", F.uuid()), getattr(R, rule))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any("note" in line for line in plan.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("name", ["profile_split_rs", "rs32_plain_rule"])
def test_rs_queries_are_dealt_by_their_rows(spark, name, monkeypatch):
    def run():
        d = QUERIES[name](spark, SF)
        found = re.findall(r"hashpartitioning\(sample#\d+, (\d+)\)", d._jdf.queryExecution().executedPlan().toString())
        return [int(k) for k in found], Counter(map(tuple, d.collect()))

    n, few = spark.read.parquet(f"{SF}/lineitem.parquet").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, want = run()
    assert parts == [few]
    monkeypatch.setattr(R, "ROWS", n // (2 * few))
    parts, got = run()
    assert got == want and parts[0] >= 2 * few  # a task's sort does not grow with the table


def test_rs_queries_are_dealt_by_their_rows_in_a_session_of_many_partitions(spark, monkeypatch):
    want = Counter(map(tuple, QUERIES["rs32_plain_rule"](spark, SF).collect()))
    few = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(R, "ROWS", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        d = QUERIES["rs32_plain_rule"](spark, SF)
        found = re.findall(r"hashpartitioning\(sample#\d+, (\d+)\)", d._jdf.queryExecution().executedPlan().toString())
        assert Counter(map(tuple, d.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert found == [str(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500))]  # 300 would be merged, and sorted by the tasks that read


@pytest.mark.parametrize("name", ["rs38_plain_rule", "rs32_plain_rule", "rs38_catalog", "rs32_catalog"])
def test_rs_queries_shuffle_rearrangements_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1


def test_split_profile_shuffles_rearrangements_once(spark):
    plan = QUERIES["profile_split_rs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Scan parquet") == 1  # the second has counts by context


def test_low_regions_over_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(s, c, int(p)) for s in "stuv" for c in "12" for p in np.cumsum(np.r_[rng.integers(900, 1100, 40), rng.integers(1, 9, 30), rng.integers(900, 1100, 25)])] + [("w", "1", 5), ("s", "3", None)]
    d = spark.createDataFrame([(*r, "9", None) for r in rows], "sample string, chr1 string, start1 long, chr2 string, start2 long")
    got = {}
    for batch in (1, 10**6):
        monkeypatch.setattr(R, "BATCH", batch)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if batch == 1 else 10_000)
        got[batch] = sorted(map(tuple, R.low_distance_regions(d).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pos = {(s, c): [p for a, b, p in rows if (a, b) == (s, c)] for s in "stuv" for c in "12"}
    assert got[1] == got[10**6] == sorted((s, c, p[40], p[69]) for (s, c), p in pos.items())


def test_enrichment_by_ranks_and_reference(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("abc"), rnd.randrange(20) * 1.0) for _ in range(90)]
    d = spark.createDataFrame(rows, "g string, x double")

    def want(level, others):
        x, y = [v for g, v in rows if g == level], [v for g, v in rows if g in others]
        w = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        lo = min(x + y)
        return w, (np.mean(x) - lo) / (np.mean(y) - lo)

    for ref, rest in ((None, None), ("c", "c")):
        got = {r.grp: r for r in T.group_enrichment(d, ["g"], ["x"], reference=ref, method="wilcox").collect()}
        assert set(got) == ({"a", "b", "c"} if ref is None else {"a", "b"})
        for level, r in got.items():
            w, m = want(level, rest or "abc".replace(level, ""))
            assert r.statistic == w and r.measure_observed == pytest.approx(m) and 0 <= r.p_value <= 1
    with pytest.raises(ValueError, match="method"):
        T.group_enrichment(d, ["g"], ["x"], method="other")


def test_enrichment_of_large_values(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(1e9 + x), bool(x > 0)) for g, m, k in (("a", 0.0, 30), ("b", 0.4, 25), ("c", -0.3, 40)) for x in rng.normal(m, 1, k)]
    d = spark.createDataFrame(rows, "g string, x double, f boolean")
    got = {(r.grp, r.enrich_var): r for r in T.group_enrichment(d, ["g"], ["x"], ["f"]).collect()}
    for level in "abc":
        want = T.welch_columns(T.two_groups(d, F.col("g") == level, "x")).first()
        r = got[level, "x"]
        assert r.statistic == pytest.approx(want.t, rel=1e-5) and r.p_value == pytest.approx(want.p_value, rel=1e-5) and r.odds is None
        mine = [[sum(f == v for g, _, f in rows if (g == level) == own) for v in (True, False)] for own in (True, False)]
        o = got[level, "f"]
        assert np.allclose([o.odds, o.odds_low, o.odds_high], K.odds_intervals(*[[x] for x in mine[0] + mine[1]])[0])
    far = {r.grp: r.statistic for r in T.group_enrichment(d, ["g"], ["x"], reference="c").collect()}
    for level in "ab":
        assert far[level] == pytest.approx(T.welch_columns(T.two_groups(d.where(F.col("g").isin(level, "c")), F.col("g") == level, "x")).first().t, rel=1e-5)  # a mean near 1e9 has seven places


def test_odds_intervals():
    from math import comb

    t = np.random.default_rng(3).integers(0, 40, (200, 4))
    t[:2] = 0
    for cells in (50, 1 << 20):
        for (a, b, c, d), (odds, low, high) in zip(t.tolist(), K.odds_intervals(*t.T, cells=cells), strict=True):
            m, n, k = a + c, b + d, a + b
            lo, hi = max(0, k - n), min(k, m)
            weights = {x: comb(m, x) * comb(n, k - x) for x in range(lo, hi + 1)}

            def tail(w, chosen):
                p = {x: v * w ** (x - lo) for x, v in weights.items()}  # noqa: B023
                return sum(p[x] for x in p if chosen(x)) / sum(p.values())

            if lo == hi:
                assert np.isnan(odds) and (low, high) == (0, np.inf)
                continue
            assert odds == pytest.approx(K.fisher(a, b, c, d)[1], rel=1e-6)
            assert low == 0 if a == lo else tail(low, lambda x: x >= a) == pytest.approx(0.025, rel=1e-6)
            assert high == np.inf if a == hi else tail(high, lambda x: x <= a) == pytest.approx(0.025, rel=1e-6)


@pytest.mark.parametrize("cells", [7, 50_000])
def test_associations_and_correlations_in_one_pass(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "KENDALL_CELLS", cells)
    rnd = random.Random(11)
    rows = [(rnd.random(), rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.random() < 0.4, rnd.choice([True, False, None]), rnd.randrange(9), 3) for _ in range(120)]
    d = spark.createDataFrame(rows, "s1 double, s2 double, f1 boolean, f2 boolean, x int, one int")
    got = {(r.signature, r.feature): r for r in T.feature_association(d, ["s1", "s2"], ["x"], ["f1", "f2"]).collect()}
    assert len(got) == 6
    for i, s in enumerate(("s1", "s2")):
        for j, f in ((2, "f1"), (3, "f2")):
            have = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x, y = [v for v, f in have if f], [v for v, f in have if not f]
            r = got[s, f]
            want = T.rank_sum(d.where(F.col(f).isNotNull()), F.col(f), s).first().p_value
            assert r["count"] == len(have) and r.measure == pytest.approx(np.mean(x) - np.mean(y)) and r.p_value == pytest.approx(want)
    rank = lambda vs: [sum(b < a for b in vs) + (sum(b == a for b in vs) + 1) / 2 for a in vs]
    c = T.correlations(d, ["s1", "x"], ["x", "one"], rank=True, adjust="BH")
    by = {(r.a, r.b): r for r in c.collect()}
    assert by["s1", "x"].r == pytest.approx(np.corrcoef(rank([r[0] for r in rows]), rank([r[4] for r in rows]))[0, 1]) and by["s1", "one"].r is None
    kept = T.correlations(d, ["s1", "s2"], ["x", "one"], adjust="bonferroni", drop_constant=True).collect()
    assert {(r.a, r.b) for r in kept} == {("s1", "x"), ("s2", "x")} and all(r.p_adjusted == pytest.approx(min(1, 2 * r.p_value)) for r in kept)
    with pytest.raises(ValueError):
        T.correlations(d, ["one"], ["x"], drop_constant=True)


def test_similarity_needs_the_same_components(spark):
    a = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 3.0)], "sig string, component string, weight double")
    with pytest.raises(ValueError, match="y"):
        C.similarity(a, a.where("component = 'x'"))
    r = C.similarity(a, a.where("component = 'x'"), remove="y").first()
    assert (r.cosine, r.rss, r.best) == (1.0, 0.0, True)


def test_strand_label_of_repeated_rows(spark):
    rnd = random.Random(8)
    genes = [(rnd.choice("ab"), s := rnd.randrange(200), s + rnd.randrange(40), rnd.choice("+-")) for _ in range(30)]
    muts = [(rnd.choice(["a", "b", "c", None]), p := rnd.choice([None, *range(0, 230, 5)]), None if p is None else p + rnd.randrange(25), rnd.random() < 0.5, rnd.choice(["x", None])) for _ in range(150)]
    muts += muts[:40] + muts[:9]
    t = spark.createDataFrame(genes, "chrom string, start_pos long, end_pos long, strand string")
    d = spark.createDataFrame(muts, "chrom string, pos long, last long, should_reverse boolean, start_pos string")

    def label(c, p, e, turned, _):
        strands = {g[3] for g in genes if c == g[0] and p is not None and p <= g[2] and e >= g[1]}
        return "N" if not strands else "B" if len(strands) == 2 else "T" if turned != ("-" in strands) else "U"

    key = lambda r: tuple(map(str, r))
    got = V.strand_label(d, t, "last").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(*m, label(*m)) for m in muts], key=key)


def test_tests_of_associations(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, rnd.gauss(0, 1)]), rnd.choice([True, False, None]), i == 3, rnd.randrange(5)) for i in range(90)]
    d = spark.createDataFrame(rows, "s double, f boolean, rare boolean, x int")
    cells = [(a, f) for a, f, *_ in rows if a is not None and f is not None]
    x, y = [a for a, f in cells if f], [a for a, f in cells if not f]
    welch = T.welch_columns(T.two_groups(d.where("f IS NOT NULL"), F.col("f"), "s")).first().p_value
    assert T.feature_association(d, ["s"], logical=["f"], test="t").first().p_value == pytest.approx(welch)
    seen = lambda n1, m1, v1, n2, m2, v2: (m1 - m2) ** 2 / (1 + (m1 - m2) ** 2 + v1 / n1 + v2 / n2)
    want = seen(len(x), np.mean(x), np.var(x, ddof=1), len(y), np.mean(y), np.var(y, ddof=1))
    got = {r.feature: r for r in T.feature_association(d, ["s"], logical=["f", "rare"], test=seen, min_n=5).collect()}
    assert got["f"].p_value == pytest.approx(want) and got["rare"].p_value is None and got["rare"].measure is None
    ranked = T.feature_association(d, ["s"], ["x"], rank=True).first().measure
    assert ranked == pytest.approx(T.correlations(d, ["s"], ["x"], rank=True).first().r)
    with pytest.raises(ValueError):
        T.feature_association(d, ["s"], logical=["f"], test="sign")


def test_adjusted_pairs_of_groups_by_rank(spark):
    from locusframe.operators import tables as B

    rnd = random.Random(6)
    rows = [(rnd.choice(["b", "a", "Z", "é", None]), rnd.choice([None, *range(6)])) for _ in range(120)]
    d = spark.createDataFrame(rows, "g string, x int")
    got = {(r.g1, r.g2): r for r in B.adjusted_pairs(d, "x", "g").collect()}
    assert sorted(got) == [("Z", "a"), ("Z", "b"), ("Z", "é"), ("a", "b"), ("a", "é"), ("b", "é")]
    for (a, b), r in got.items():
        x, y = ([v for g, v in rows if g == k and v is not None] for k in (a, b))
        assert (r.n1, r.n2) == (len(x), len(y)) and r.statistic == sum((v > w) + (v == w) / 2 for v in x for w in y)


def test_order_of_similar_references(spark):
    sig = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 0.0), ("B", "x", 0.0), ("B", "y", 1.0)], "sig string, component string, weight double")
    ref = spark.createDataFrame([(s, c, w) for s, p in (("P", (1, 1)), ("Q", (0, 1)), ("R", (1, 0)), ("O", (2, 1))) for c, w in zip("xy", map(float, p))], "sig string, component string, weight double")
    d = C.similarity(sig, ref, set_order=True)
    assert [r.b for r in d.where("a = 'A'").orderBy("position").collect()] == ["R", "Q", "O", "P"] and d.count() == 8
