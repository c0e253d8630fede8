import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import catalog as C
from locusframe.operators import classify as K
from locusframe.operators import intervals as I
from locusframe.operators import rearrangements as R
from locusframe.operators import segments as S
from locusframe.operators import stats as T
from locusframe.operators import tables as B
from locusframe.operators import variants as V
from locusframe.sources import readers
from locusframe.streaming.tally import incremental_tally


@pytest.fixture()
def segs(spark):
    rnd = random.Random(2)
    rows = []
    for s in "ab":
        for c in ("chr1", "chr2"):
            at = 1
            for _ in range(rnd.choice([1, 2, 25])):
                n = rnd.choice([5_000, 200_000, 3_000_000])
                rows.append((s, c, at, at + n, rnd.choice([1, 2, 2, 3]), rnd.choice([0, 1])))
                at += n + rnd.choice([1, 500])
    return spark.createDataFrame(rows, "sample string, chromosome string, start_pos long, end_pos long, seg_val int, minor_cn int")


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.sample, r.chromosome, r.start_pos)):
        out.setdefault((r.sample, r.chromosome), []).append(r)
    return out


def test_merge_adjacent_sequential(segs):
    want = []
    for (s, c), rows in grouped(segs).items():
        for r in rows:
            if want and want[-1][:2] == [s, c] and want[-1][4] == r.seg_val:
                want[-1][3] = r.end_pos
            else:
                want.append([s, c, r.start_pos, r.end_pos, r.seg_val])
    got = S.merge_adjacent(segs, order=()).select("sample", "chromosome", "start_pos", "end_pos", "seg_val")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert S.merge_adjacent(segs, order=(), max_gap=0).count() >= len(want)
    assert S.merge_adjacent(S.label_loh(segs), order=(), loh_min_frac=0.5).where("loh_frac > 1 OR loh_frac < 0").count() == 0


def test_oscillation_index(spark, segs):
    def plain(v):
        out, count = [0] * len(v), 0
        for j in range(2, len(v)):
            count = count + 1 if v[j] == v[j - 2] and v[j] != v[j - 1] else 0
            if count:
                out[j - count - 1 : j + 1] = [max(x, count) for x in out[j - count - 1 : j + 1]]
        return out

    got = grouped(K.oscillation_index(segs, order=()))
    for key, rows in grouped(segs).items():
        assert [r.n_oscillation for r in got[key]] == plain([r.seg_val for r in rows])
    known = [("s", "chr1", i, v) for i, v in enumerate((4, 1, 4, 6, 4))] + [("s", "chr2", i, v) for i, v in enumerate((2, 2, 3, 2))] + [("s", "chr3", 1, 5)]
    d = K.oscillation_index(spark.createDataFrame(known, "sample string, chromosome string, start_pos long, seg_val int"), order=())
    assert [r.n_oscillation for r in d.orderBy("chromosome", "start_pos").collect()] == [1, 1, 1, 1, 1, 0, 1, 1, 1, 0]


def test_oscillation_sequential(segs):
    want = []
    for (s, _), rows in grouped(segs).items():
        v = [r.seg_val for r in rows]
        if len(v) < 3:
            want.append((s, 0))
            continue
        o = [0, 0]
        for j in range(2, len(v)):
            o.append(o[-1] + 1 if v[j] == v[j - 2] and v[j] != v[j - 1] else 0)
        o = o[2:]
        want += [(s, o[i]) for i in range(len(o) - 1) if o[i + 1] == 0] + [(s, o[-1])] * (o[-1] > 0)
    assert sorted(map(tuple, K.feature_oscillation(segs, order=()).collect())) == sorted(want)


def test_class_labels_in_vocabulary(segs):
    d = K.label_40_48(S.label_loh(segs))
    assert {r.c for r in d.select(F.col("cn40").alias("c")).where("c IS NOT NULL").collect()} <= set(K.CN_40)
    t = K.label_t(I.self_flank(S.label_loh(segs)), order=(), with_loh=True)
    assert {r.t_standard for r in t.where("t_standard IS NOT NULL").collect()} <= set(K.vocabulary_t(True))
    assert t.where("t_complex IS NULL").count() == 0


def test_subset_keeps_null_apart(spark):
    d = spark.createDataFrame([("a", 1), ("a", None), ("b", 5)], "sample string, x int")
    kept, dropped = S.subset(d, "x > 2")
    assert kept.count() == 1 and dropped.count() == 2


def test_empty_inputs(spark, segs):
    e = segs.limit(0)
    for out in (S.merge_adjacent(e, ()), S.cn_summary(e), S.ploidy(e), S.chromothripsis(e, ()), K.feature_oscillation(e, ()), I.self_flank(e), K.label_t(e, ())):
        assert out.count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_binned_overlap_is_the_same(spark, how):
    rnd = random.Random(4)
    row = lambda: (rnd.choice("xy"), a := rnd.randrange(1, 2000), a + rnd.choice([0, 3, 700]))
    left = spark.createDataFrame([(i, *row()) for i in range(150)], "i long, c string, s long, e long")
    right = spark.createDataFrame([(i, *row()) for i in range(90)], "j long, rc string, rs long, re long")
    keys = (("c", "s", "e"), ("rc", "rs", "re"))
    a, b = (I.overlap_join(left, right, *keys, how, bin_size=100, small=x) for x in (True, False))
    assert sorted(map(repr, map(tuple, a.select(*b.columns).collect()))) == sorted(map(repr, map(tuple, b.collect())))
    with pytest.raises(ValueError, match="rename"):
        I.overlap_join(left, left, keys[0], keys[0])


@pytest.mark.parametrize(("xs", "xe", "ys", "ye", "n"), [(1, 5, 3, 20, 3), (3, 20, 1, 10, 8), (1, 10, 4, 10, 7), (2, 4, 2, 3, 2), (1, 6, 5, 22, 2), (1, 2, 3, 4, 0)])
def test_intersect_size(spark, xs, xe, ys, ye, n):
    assert spark.range(1).select(I.intersect_size(*map(F.lit, (xs, xe, ys, ye))).alias("n")).first().n == n


@pytest.mark.parametrize(("x", "up", "down", "n"), [("TC", "ACCAA", "TAGCGGC", 1), ("TC", "ACAAC", "AAGCGGC", 1), ("TATC", "ACCCA", "TATAGCGGC", 3), ("TATC", "ACCCATC", "AAGCGGC", 3), ("TAGCCTC", "ACCCA", "TAGCCTAGCGGC", 6), ("T", "A", "T", 0)])
def test_homology(spark, x, up, down, n):
    assert spark.range(1).select(V.homology(*map(F.lit, (x, up, down))).alias("n")).first().n == n


def test_capped_counts_are_the_uncapped(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("AC") for _ in range(rnd.randrange(n)))
    rows = [(text(9), text(30), text(30)) for _ in range(400)] + [("A", "A" * 30, "A" * 30), ("ACACACAC", "ACACACA", "CACACAC"), (None, "A", "A"), ("AC", None, None), ("", "A", "A")]
    u, x, y = map(F.col, "uxy")
    pairs = [(V.repeats(u, x), V.repeats(u, x, cap=5)), (V.repeats(u, y, False), V.repeats(u, y, False, 5)), (V.homology(u, x, y), V.homology(u, x, y, 5))]
    d = spark.createDataFrame(rows, "u string, x string, y string")
    wrong = [F.least(a, F.lit(5)) != b for a, b in pairs]
    assert d.where(wrong[0] | wrong[1] | wrong[2]).count() == 0


def test_repeats(spark):
    r = spark.range(1).select(V.repeats(F.lit("AC"), F.lit("ACACAG")).alias("a"), V.repeats(F.lit("T"), F.lit("GATT"), False).alias("b"), V.repeats(F.lit("AC"), F.lit("")).alias("c")).first()
    assert tuple(r) == (2, 2, 0)


def test_sbs_is_strand_symmetric(spark):
    d = spark.createDataFrame([("a", "C", "T", "AACGT"), ("b", "G", "A", "ACGTT")], "sample string, ref string, alt string, context string")
    assert len({r.sbs1536 for r in V.label_sbs(d).collect()}) == 1


def test_hyper_split_halves(spark):
    d = spark.createDataFrame([(f"s{i}", c, 10 + i) for i in range(9) for c in "xy"] + [("big", "x", 4000), ("big", "y", 1)], "sample string, component string, n long")
    out = C.hyper_split(d)
    assert out.where("sample LIKE 'big_[hyper]%' OR sample LIKE 'big%'").count() > 2
    back = {(r.sample, r.component): r.n for r in C.hyper_collapse(out).collect()}
    assert back == {(r.sample, r.component): pytest.approx(float(r.n)) for r in d.collect()}


def test_enrichment_p_values(spark):
    d = spark.createDataFrame([(g, g == "a", float(x)) for g in "ab" for x in range(10 if g == "a" else 14)], "g string, f boolean, x double")
    out = {(r.enrich_var, r.grp): r for r in T.group_enrichment(d, ["g"], ["x"], ["f"]).collect()}
    assert out[("f", "a")].p_value < 1e-5 and out[("x", "a")].statistic == pytest.approx(-1.3587, abs=1e-3)
    ref = T.group_enrichment(d, ["g"], ["x"], reference="a").collect()
    assert [r.grp for r in ref] == ["b"]


def test_rearrangements(spark):
    rows = [("s", "chr1", 1 + i * 5, 2 + i * 5, "chr1", 3 + i * 5, 4 + i * 5, "+", "+") for i in range(40)] + [("s", "chr1", 10**6 * (i + 2), 10**6 * (i + 2) + 1, "chr2", 10**7 * (i + 1), 10**7 * (i + 1) + 1, "-", "+") for i in range(30)]
    d = R.clean(spark.createDataFrame(rows, "Sample string, chr1 string, start1 long, end1 long, chr2 string, start2 long, end2 long, strand1 string, strand2 string"))
    out = R.label_rs(R.label_clustered(R.label_size(d), ["sample", "start1"]).drop("_"))
    got = {r.rs38 for r in out.collect()}
    assert got <= set(R.RS_38) and "clustered:del:<1Kb" in got and "non-clustered:trans" in got
    with pytest.raises(ValueError, match="svclass"):
        R.clean(d.drop("svclass", "strand1"))


def test_readers(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("Chromosome\tStart.bp\tEnd.bp\tmodal_cn\n1\t1\t90000\t2\n23\t5\t20\t30\nMT\t1\t2\t2\n2\t1\t5\tNA\n")
    cols = {"chromosome": "Chromosome", "start_pos": "Start.bp", "end_pos": "End.bp", "seg_val": "modal_cn"}
    kept, dropped = readers.read_segments(spark, str(tmp_path / "p1.txt"), cols)
    assert sorted((r.sample, r.chromosome, r.seg_val) for r in kept.collect()) == [("p1", "chr1", 2), ("p1", "chrX", 20)] and dropped.count() == 1
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\n1\t7\t.\tA\tAT\t.\tPASS\n2\t9\t.\tC\tT\t.\tlow\n")
    v = readers.read_vcf(spark, str(tmp_path / "a.vcf")).collect()
    assert [(r.sample, r.chrom, r.pos, r.variant_type, r.end_pos) for r in v] == [("a", "chr1", 7, "INS", 7)]
    assert readers.read_vcf(spark, str(tmp_path / "a.vcf"), keep_only_pass=False).count() == 2
    (tmp_path / "m.maf").write_text("#v\nHugo_Symbol\tTumor_Sample_Barcode\tChromosome\tStart_Position\tEnd_Position\tReference_Allele\tTumor_Seq_Allele2\n" + "G\ts\t1\t5\t5\tA\tC\n" * 2)
    assert readers.read_maf(spark, str(tmp_path / "m.maf")).count() == 1
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(950))
    (tmp_path / "c.fa").write_text(">chr1\n" + "\n".join(seq[i : i + 60] for i in range(0, 950, 60)))
    ref = readers.read_reference(spark, str(tmp_path / "c.fa"), chunk=100, overlap=20)
    at = spark.createDataFrame([("chr1", p) for p in (3, 100, 101, 199, 200, 555, 948)], "chrom string, pos long")
    got = {r.pos: r.context for r in readers.with_context(at, ref, 2, 100, 20).collect()}
    assert got == {p: seq[p - 3 : p + 2] for p in got}
    sig = tmp_path / "sig.tsv"
    sig.write_text("Type\tA\tB\nx\t1\t3\ny\t3\t1\n")
    assert {(r.sig, r.component): r.weight for r in readers.read_signatures(spark, str(sig)).collect()}[("A", "x")] == 0.25
    with pytest.raises(ValueError, match="missing"):
        readers.read_segments(spark, str(tmp_path / "p1.txt"), cols | {"minor_cn": "B"})


def test_sinks_and_resume(spark, tmp_path):
    c = spark.createDataFrame([("s1", "x", 2), ("s2", "y", 3)], "sample string, component string, n long")
    readers.write_catalog(c, str(tmp_path / "cat"), ["x", "y", "z"])
    back = spark.read.csv(str(tmp_path / "cat"), sep="\t", header=True)
    assert [tuple(r) for r in back.collect()] == [("x", "2", "0"), ("y", "0", "3"), ("z", "0", "0")]
    assert readers.pending(c, str(tmp_path / "done"), ["sample"]).count() == 2
    c.limit(1).write.parquet(str(tmp_path / "done"))
    assert readers.pending(c, str(tmp_path / "done"), ["sample"]).count() == 1
    readers.write_tables({"a": c}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/a")).count() == 2


def test_incremental_tally(spark, tmp_path):
    rows = [("a", "C", "T", "AACGT"), ("b", "G", "A", "ACGTT"), ("a", "C", "T", "AACGT")]
    schema = "sample string, ref string, alt string, context string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = incremental_tally(stream, V.label_sbs, "sbs6").writeStream.outputMode("complete").format("memory").queryName("tally").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.sample, r.n) for r in spark.sql("SELECT * FROM tally").collect()) == [("a", 2), ("b", 1)]


def test_wide_tables_to_long_and_back(spark):
    wide = spark.createDataFrame([("a", 2, None, 0), ("b", 0, 5, 1)], "sample string, `A[C>T]G` long, `x.y` long, z long")
    assert sorted(map(tuple, K.long(wide).collect())) == [("a", "A[C>T]G", 2), ("b", "x.y", 5), ("b", "z", 1)]
    assert K.long(wide, keep_zeros=True).count() == 6
    assert sorted(map(tuple, K.wide(K.long(wide), ["A[C>T]G", "x.y", "z"]).collect())) == [("a", 2, 0, 0), ("b", 0, 5, 1)]


def test_group_profile_counts_samples(spark):
    rows = [("s1", "chr1", 1, 50, 4, "g"), ("s1", "chr1", 51, 90, 1, "g"), ("s2", "chr1", 40, 60, 3, "g"), ("s3", "chr1", 1, 9, 2, None), (None, "chr1", 1, 99, 9, "g")]
    s = spark.createDataFrame(rows, "sample string, chromosome string, start_pos long, end_pos long, seg_val long, grp string")
    b = spark.createDataFrame([("chr1", 1, 49, "p1"), ("chr1", 50, 99, "q1"), ("chr2", 1, 9, "p1")], "chrom string, start_pos long, end_pos long, band string")
    got = {tuple(r) for r in B.group_profile(s, b, "grp").collect()}
    assert got == {("g", "chr1", "p1", 2, 0), ("g", "chr1", "q1", 2, 1), (None, "chr1", "p1", 0, 0)}
    assert {tuple(r) for r in B.group_profile(s, b, "grp", amp_over=3, del_under=1).collect()} == {("g", "chr1", "p1", 1, 0), ("g", "chr1", "q1", 1, 0), (None, "chr1", "p1", 0, 0)}
    assert B.group_profile(s.limit(0), b, "grp").count() == 0


def test_exposure_table(spark):
    e = spark.createDataFrame([("a", "1", 3.0), ("a", "2", 1.0), ("b", "1", 0.0), ("c", "1", 9.0)], "sample string, sig string, amount double")
    assert sorted(map(tuple, B.exposure_table(e).collect())) == [("a", "1", 3.0, 0.75, 4.0), ("a", "2", 1.0, 0.25, 4.0), ("b", "1", 0.0, None, 0.0), ("c", "1", 9.0, 1.0, 9.0)]
    assert {r.sample for r in B.exposure_table(e, min_total=5).collect()} == {"c"}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_places_in_groups_by_parts(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, 1.5, 2.5, float(rnd.randrange(9))])) for i in range(120)]
    d = spark.createDataFrame(rows, "grp string, id long, v double")
    want = set()
    for g in ("a", "b", None):
        mine = sorted((v, i) for x, i, v in rows if x == g and v is not None)
        want |= {(g, i, v, at + 1, len(mine)) for at, (v, i) in enumerate(mine)}
    got = [tuple(r) for r in B.group_distribution(d, "grp", "v", "id", block).collect()]
    assert len(got) == len(want) and set(got) == want
    assert B.group_distribution(d.limit(0), "grp", "v", "id", block).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_all_features_as_each_alone(spark, seed):
    rnd, rows = random.Random(seed), []
    for s in "abcd":
        for c in ("chr1", "chr2", "chrX", "chrUn"):
            at = 1
            for _ in range(rnd.choice([0, 1, 2, 3, 12])):
                n = rnd.choice([900, 4_000_000, 30_000_000])
                rows.append((s, c, at, at + n - 1, 2 if s == "d" else rnd.choice([1, 2, 2, 3])))
                at += n + rnd.choice([0, 500])
    d = spark.createDataFrame(rows, "sample string, chromosome string, start_pos long, end_pos long, seg_val long")
    sizes = spark.createDataFrame([("chr1", 240_000_000, 100_000_000, 105_000_000), ("chr2", 61_000_000, 20_000_000, 30_000_000), ("chrX", 150_000_000, 58_000_000, 62_000_000)], "chrom string, size long, cen_left long, cen_right long")
    alone = {
        "BP10MB": K.feature_breakpoints(d, sizes, ()), "BPArm": K.feature_bparm(d, sizes), "CN": K.feature_cn(d), "CNCP": K.feature_changepoint(d, ()), "OsCN": K.feature_oscillation(d, ()),
        "NC50": K.feature_nc50(d), "BoChr": K.feature_bochr(d), "SS": d.select("sample", F.log10(F.expr("end_pos - start_pos + 1")).alias("value")),
    }
    want = sorted((r.sample, f, round(float(r.value), 9)) for f, x in alone.items() for r in x.collect() if r.value is not None)
    got = K.features_w(d, sizes, ())
    assert sorted((r.sample, r.feature, round(r.value, 9)) for r in got.collect()) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 4  # segments and sizes, twice each
    assert K.features_w(d.limit(0), sizes, ()).count() == 0


def test_features_by_segment_are_compiled(spark):
    d = spark.createDataFrame([("s", "chr1", 1, 9, 3)], "sample string, chromosome string, start_pos long, end_pos long, seg_val int")
    sizes = spark.createDataFrame([("chr1", 100, 40, 50)], "chrom string, size long, cen_left long, cen_right long")
    plan = K._by_segment(d, sizes, ())._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
