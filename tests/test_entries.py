"""The entries over catalogues, extractions, fits and files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import solvers
from locusframe.operators import classify as K
from locusframe.operators import tables as B
from locusframe.plans import extraction as X
from locusframe.plans import tally as Y
from locusframe.sources import genomes as G
from locusframe.sources import readers as RD
from locusframe.sources.domain import view
from tests.conftest import SF


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_genome_dimensions(spark):
    assert [G.genome_size(b) for b in ("hg19", "hg38", "mm10")] == [2881033286, 2875001522, 2462745373]
    d = G.genome_annotation(spark, "chr_size", "hg38", ["chrX", "chr2"]).collect()
    assert [(r.chrom, r.size) for r in d] == [("chrX", 156040895), ("chr2", 242193529)]
    assert all(0 < r.cen_left < r.cen_right < r.size for r in G.genome_annotation(spark, "centro_loc").collect())
    with pytest.raises(ValueError, match="folder"):
        G.genome_annotation(spark, "cytobands", "hg19")


def test_genome_tables_from_folder(spark, tmp_path):
    spark.createDataFrame([("chr2", 5, "b"), ("chr1", 9, "c"), ("chr1", 1, "a")], "chrom string, start_pos long, band string").write.parquet(str(tmp_path / "hg19" / "cytobands"))
    got = G.genome_annotation(spark, "cytobands", "hg19", folder=str(tmp_path)).collect()
    assert [r.band for r in got] == ["a", "c", "b"]


def test_tally_segments(spark):
    s = view(spark, SF, "segments")
    all_, some = (Y.tally(s, "segments", method="X", ignore_chrs=i)["cn_x_standard"] for i in ((), ("chr1",)))
    assert some.agg(F.sum("n")).first()[0] < all_.agg(F.sum("n")).first()[0]
    assert {r.component for r in all_.select("component").distinct().collect()} <= set(K.vocabulary_x())
    few = s.withColumn("index", F.when((F.col("t1") % 10 == 0), 1).otherwise(2))
    kept = Y.tally(few, "segments", method="T", indices=[1])["cn_t_standard"]
    assert 0 < kept.agg(F.sum("n")).first()[0] <= s.where("t1 % 10 = 0").count()
    for bad in ({"method": "Z"}, {"method": "W"}, {"method": "W", "indices": [1], "sizes": s}):
        with pytest.raises(ValueError):
            Y.tally(few, "segments", **bad)
    with pytest.raises(ValueError, match="kind"):
        Y.tally(s, "points")


def test_tally_variants(spark):
    rows = [
        ("s", "1", 10, "C", "T", "AACGT", "Silent"), ("s", "chr1", 11, "C", "A", "ACCGT", "Missense_Mutation"), ("s", "chrX", 5, "A", "G", "TTAGG", "Missense_Mutation"),
        ("s", "chr2", 7, "CC", "TT", None, "Missense_Mutation"), ("s", "chr2", 9, None, "T", None, "Silent"),
    ]
    v = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref string, alt string, context string, classification string")
    tx = spark.createDataFrame([("chr1", 1, 10, "+"), ("chr1", 11, 20, "-"), ("chr2", 1, 50, "-")], "chrom string, start_pos long, end_pos long, strand string")
    out = {k: {r.component: r.n for r in d.collect()} for k, d in Y.tally(v, "variants", add_trans_bias=True, transcripts=tx).items()}
    assert out["sbs6"] == {"C>T": 1, "C>A": 1, "T>C": 1}
    assert out["sbs6_strand"] == {"U:C>T": 1, "T:C>A": 1, "N:T>C": 1}
    assert out["dbs78"] == {"CC>TA": 1, "CC>TT": 1} and out["dbs78_strand"] == {"B:CC>TA": 1, "T:CC>TT": 1}
    assert set(Y.tally(v, "variants", use_syn=False)["sbs6"].toPandas()["component"]) == {"C>A", "T>C"}
    assert set(Y.tally(v, "variants", mode="SBS", ignore_chrs=["chrX"])["sbs6"].toPandas()["component"]) == {"C>T", "C>A"}
    known = Y.tally(v, "variants", mode="SBS", sizes=spark.createDataFrame([("chr1",), ("chr1",)], "chrom string"), apobec=True)
    assert {r.component for r in known["sbs6"].collect()} == {"C>T", "C>A"}
    assert [(r.sample, r.n_mutations) for r in known["apobec"].collect()] == [("s", 2)]
    with pytest.raises(ValueError, match="transcripts"):
        Y.tally(v, "variants", add_trans_bias=True)
    with pytest.raises(ValueError):
        Y.tally(v.drop("context"), "variants", mode="SBS")


def test_strand_looks_up_needed_columns_only(spark, monkeypatch):
    v = spark.createDataFrame([("s", "1", 5 + i % 2, "CT", "C", "GGA", "TTTA", i) for i in range(6)], "sample string, chrom string, pos long, ref string, alt string, upstream string, downstream string, note long")
    tx = spark.createDataFrame([("chr1", 1, 5, "+"), ("chr1", 6, 9, "-")], "chrom string, start_pos long, end_pos long, strand string")
    seen, label = [], Y.V.strand_label
    monkeypatch.setattr(Y.V, "strand_label", lambda d, *a: seen.append(d) or label(d, *a))
    out = Y.tally(v, "variants", mode="ID", add_trans_bias=True, transcripts=tx)["id83_strand"]
    assert sum(r.n for r in out.collect()) == 6
    assert not {"note", "upstream", "downstream"} & set(seen[0].columns) and seen[0].distinct().count() == 2


@pytest.fixture()
def mixed(spark):
    rng = np.random.default_rng(3)
    w = rng.dirichlet(np.ones(12) * 0.3, 3)
    comps = [f"c{i}" for i in range(12)]
    cat = [(f"s{j}", c, int(n)) for j in range(8) for c, n in zip(comps, rng.poisson(rng.gamma(2, 200, 3) @ w))]
    return spark.createDataFrame(cat, "sample string, component string, n long"), spark.createDataFrame([(f"S{k}", c, float(w[k, i])) for k in range(3) for i, c in enumerate(comps)], "sig string, component string, weight double")


def test_batch_goes_on_where_it_stopped(spark, mixed, tmp_path, monkeypatch):
    c, sig = mixed
    tables = X.fit_bootstrap_batch(c, sig, ("QP", "NNLS"), n=5, folder=str(tmp_path))
    assert {r.method for r in tables["expo"].select("method").distinct().collect()} == {"QP", "NNLS"}
    assert tables["error"].count() == 2 * 8 * 6 and tables["p_val"].count() == 2 * 8 * 3
    seen, fit, stop = [], X._fit_tasks, [99]

    def counted(tasks, *a):
        n = tasks.count()
        if n:
            if len(seen) >= stop[0]:
                raise RuntimeError("lost")
            seen.append(n)
        return fit(tasks, *a)

    monkeypatch.setattr(X, "_fit_tasks", counted)

    def again(data=c, **options):
        seen.clear()
        out = X.fit_bootstrap_batch(data, sig, ("QP", "NNLS"), folder=str(tmp_path), **options)
        return out, sum(seen)

    out, fitted = again(n=5)
    assert fitted == 0 and rows_of(out["expo"]) == rows_of(tables["expo"])
    out, fitted = again(n=7)  # what is there is taken, what is more is added
    assert fitted == 2 * 8 * 2 and out["error"].select("type").distinct().count() == 8
    out, fitted = again(n=2)
    assert fitted == 0 and out["error"].select("type").distinct().count() == 3
    assert again(n=2, seed=9)[1] == 2 * 8 * 3
    more = c.withColumn("n", F.when(F.col("sample") == "s0", F.col("n") * 100).otherwise(F.col("n")))
    out, fitted = again(more, n=2)  # only the sample that has changed
    assert fitted == 2 * 3
    sums = {r.sample: r.e for r in out["expo"].where("method = 'QP' AND type = 'optimal'").groupBy("sample").agg(F.sum("exposure").alias("e")).collect()}
    totals = {r.sample: r.n for r in more.groupBy("sample").agg(F.sum("n").alias("n")).collect()}
    assert all(abs(sums[s] - totals[s]) < 1e-3 * totals[s] for s in totals)
    stop[0] = 3
    with pytest.raises(RuntimeError):
        again(n=2, seed=11)
    done, stop[0] = sum(seen), 99
    out, fitted = again(n=2, seed=11)
    assert 0 < done < 2 * 8 * 3 and fitted == 2 * 8 * 3 - done
    assert rows_of(out["expo"]) == rows_of(X.fit_bootstrap_batch(c, sig, ("QP", "NNLS"), n=2, seed=11)["expo"])


def test_extraction_goes_on(spark, mixed, tmp_path):
    c, sig = mixed
    one = X.auto_extract(c, 4, 3, n_iter=50, folder=str(tmp_path))
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert runs.count() == 3
    best = X.auto_extract(c, 4, 5, n_iter=50, strategy="optimal", folder=str(tmp_path), optimize=True)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 5 and best[1].count() == 8 * best[0].select("sig").distinct().count()
    assert rows_of(X.auto_extract(c, 4, 3, n_iter=50)[0]) == rows_of(one[0])
    X.auto_extract(c.where("sample != 's1'"), 4, 3, n_iter=50, folder=str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 8


def test_suboptimal_fits_stay_near_the_best(mixed):
    c, sig = mixed
    best = {r.sample: r.e for r in X.fit(c, sig).groupBy("sample").agg(F.first("error").alias("e")).collect()}
    got = X.fit_suboptimal(c, sig, n=4, factor=1.2).select("sample", "type", "error").distinct().collect()
    assert len(got) == 32 and all(r.error <= 1.2 * best[r.sample] + 0.01 for r in got)


def test_attribution(mixed):
    p = np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    counts = p @ np.array([900.0, 100.0, 0.0])
    e, cos = solvers.attribute_stepwise(counts, p, np.array([1, 1, 2]))
    assert e[2] == 0 and cos > 0.99
    e, _ = solvers.attribute_stepwise(counts, p, np.array([2, 1, 2]))
    assert e[0] > 0  # the global one is worth far more than it costs
    e, cos = solvers.attribute_bootstrap(counts, p, np.array([1, 1, 1]), seed=1, n=50)
    assert e[2] == 0 and abs(e[0] - 900) < 60 and cos > 0.99
    assert solvers.attribute_bootstrap(np.zeros(3), p, np.array([1, 1, 1]), 1)[1] == 0
    c, sig = mixed
    expo = X.fit(c, sig).select("sample", "sig", F.col("exposure").alias("amount"))
    for method in ("bt", "stepwise"):
        assert X.attribute(c, sig, expo, method=method).count() == 24
    with pytest.raises(ValueError, match="method"):
        X.attribute(c, sig, expo, method="other")


def test_extraction_entries(spark, mixed):
    c, _ = mixed
    sig, expo = X.unify_extract(c, [2], "repeated_nmf", n_run=2, n_iter=50, optimize=True)
    assert sig.count() == 24 and abs(expo.groupBy("sample").agg(F.sum("rel").alias("r")).agg(F.max("r")).first()[0] - 1) < 1e-9
    assert X.unify_extract(c, [2, 3], "bootstrap_nmf", n_bootstrap=2, n_run=2, n_iter=20).select("k").distinct().count() == 2
    for ranks, approach in (([2, 3], "repeated_nmf"), ([2], "magic")):
        with pytest.raises(ValueError):
            X.unify_extract(c, ranks, approach)
    totals = lambda d: sorted(map(tuple, d.groupBy("sample").agg(F.sum("n")).collect()))
    sparse = spark.createDataFrame([("a", "c1", 5), ("a", "c4", 7), ("b", "c2", 1), *[("z", f"c{i}", i) for i in range(1, 7)]], c.schema)
    dealt = [X.randomised(sparse, seed) for seed in range(12)]
    held = [sorted(r.n for r in d.where("sample = 'a'").collect()) for d in dealt]
    assert all(h == [0, 0, 0, 0, 5, 7] for h in held)  # counts and zeros of a sample stay
    assert {r.component for d in dealt for r in d.where("sample = 'b' AND n = 1").collect()} >= {"c1", "c3", "c5"}
    r = X.randomised(c)
    assert totals(r) == totals(c) and r.exceptAll(c).count() > 0 and r.exceptAll(X.randomised(c)).count() == 0
    tiny = c.unionByName(spark.createDataFrame([("s0", "rare", 1), ("none", "c0", 0)], c.schema))
    kept = X.worthwhile(tiny, 0.01, handle_hyper_mutation=False)
    assert kept.where("component = 'rare' OR sample = 'none'").count() == 0


def test_readers_and_writers(spark, tmp_path):
    x = tmp_path / "x.tsv"
    x.write_text("Sample_ID\tchrom\tstart\tend\treference\talt\tHugo_Symbol\nA\tchr1\t5\t5\tC\tT\tG1\n")
    assert RD.read_xena_variants(spark, str(x)).first().gene == "G1" and RD.read_xena_variants(spark, str(x), False).first().gene == "Unknown"
    r = tmp_path / "r.tsv"
    r.write_text("Sample\tChr1\tStart1\tEnd1\tChr2\tStart2\tEnd2\tStrand1\tStrand2\nA\tchr1\t5\t6\t1\t900\t901\t+\t+\n")
    row = RD.read_rearrangements(spark, str(r)).first()
    assert (row.chr1, row.start2, row.svclass) == ("1", 900, "deletion")
    (tmp_path / "Best_Signatures.txt").write_text("MutationType\tA\tB\nx\t1\t3\ny\t1\t1\n")
    (tmp_path / "Best_Activities.txt").write_text("Samples\tA\tB\ns1\t2\t8\ns2\t0\t9\n")
    sig, expo = RD.read_solution(spark, str(tmp_path))
    assert {(r.sig, r.component): r.weight for r in sig.collect()} == {("Sig1", "x"): 0.75, ("Sig1", "y"): 0.25, ("Sig2", "x"): 0.5, ("Sig2", "y"): 0.5}
    assert {(r.sample, r.sig): r.rel for r in expo.collect()}[("s1", "Sig1")] == 0.8
    RD.write_signature_tables(sig, expo, str(tmp_path / "out"), sig)
    assert sorted(os.listdir(tmp_path / "out")) == ["best_match", "dominant", "exposure_absolute", "exposure_relative", "signature", "similarity"]
    with pytest.raises(ValueError, match="vocabulary"):
        RD.reordered(spark.createDataFrame([("s", "x", 1)], "sample string, component string, n long"), ["y"])
    index = spark.createDataFrame([("Lung-A", "S1, S2", "WGS"), ("lung", "S3", "WES")], "cancer_type string, signatures string, seq_type string")
    assert [r.sig for r in RD.cancer_type_signatures(index, "LUNG", "WGS").orderBy("sig").collect()] == ["S1", "S2"]


def test_tables_odd(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", 5.0), ("b", 6.0), ("c", 5.0)], "g string, x double")
    got = {(r.g1, r.g2): r for r in B.adjusted_pairs(d, "x", "g", "t", [("b", "a")]).collect()}
    assert set(got) == {("a", "b")} and (got["a", "b"].n1, got["a", "b"].n2) == (1, 2)
    assert B.contingency_p(d.where("g = 'a'"), "g", "x") is None
    t = spark.createDataFrame([(i % 3, i % 3) for i in range(60)] + [(i % 3, i // 3 % 3) for i in range(9)], "a int, b int")
    assert B.contingency_p(t, "a", "b", draws=200) < 0.02
    flat = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(90)], "a int, b int")
    assert B.contingency_p(flat, "a", "b", draws=200) > 0.9
    with pytest.raises(ValueError, match="mode"):
        B.profile_split(spark.createDataFrame([("x",)], "component string"), "none")
    odd = {m: B.profile_split(spark.createDataFrame([(c,)], "component string"), m).first() for m, c in (("SBS", "T:A[C>T]G"), ("DBS", "AC>CA"), ("ID", "1:Del:C:3"), ("W", "CN[>8]"), ("CN", "S:LD:2+:LOH"))}
    assert {m: (r.base, r.context) for m, r in odd.items()} == {"SBS": ("C>T", "ACG"), "DBS": ("AC>NN", "CA"), "ID": ("1:Del:C", "3"), "W": ("CN", ">8"), "CN": ("S:LD", "2+:LOH")}
