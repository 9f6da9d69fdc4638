"""Literals and properties of the interval engine."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions import names as N
from segloom.operators import agreement as A
from segloom.operators import binarize as B
from segloom.operators import clustering as C
from segloom.operators import emissions as E
from segloom.operators import enrichment as R
from segloom.operators import genes as G
from segloom.operators import interpretation as P
from segloom.operators import intervals as I
from segloom.operators import matching as M
from segloom.operators import overlap as O
from segloom.operators import scoring as S

SEG = "chrom string, start long, end long, state string"


def segs(spark, rows):
    return spark.createDataFrame(rows, SEG)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def two(spark):
    ref = segs(spark, [("chr1", 0, 3000, "A"), ("chr1", 3000, 5000, "B"), ("chr1", 5000, 10000, "C")])
    work = segs(spark, [("chr1", 0, 1000, "1"), ("chr1", 1000, 5000, "2"), ("chr1", 5000, 10000, "3")])
    return work, ref


def test_overlap(two):
    got = rows(O.overlap_table(*two, width=1024), "state1", "state2", "bp")
    assert got == [("1", "A", 1000), ("2", "A", 2000), ("2", "B", 2000), ("3", "C", 5000)]


@pytest.mark.parametrize("width", [7, 64, 1 << 14])
def test_overlap_pairs_against_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    a, b = ([(f"chr{c}", int(s), int(s + n), str(i)) for i, (c, s, n) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 900, 60), rng.integers(0, 200, 60)))] for _ in range(2))
    want = sorted((x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1]))
    got = O.overlap_pairs(segs(spark, a), segs(spark, b), width)
    assert rows(got, "l_state", "r_state", "bp") == want


def test_self_agreement(two):
    work, _ = two
    ov, n = O.overlap_table(work, work), I.state_lengths(work)
    r = A.agreement_metrics(ov, n, n).first()
    assert (round(r.kappa, 9), round(r.jaccard, 9), round(r.cosine, 9), round(r.ami, 9)) == (1, 1, 1, 1)
    empty = ov.where("false")
    assert tuple(A.agreement_metrics(empty, n, n).first()) == (0, 0, 0, 0)


def test_renamed_partition_has_ami_one(spark, two):
    work, _ = two
    other = work.replace({"1": "2", "2": "3", "3": "1"}, subset="state")
    ov = O.overlap_table(work, other)
    assert A.ami(ov).first().ami == pytest.approx(1)
    assert A.kappa(ov).first().kappa < 0.1


def test_unmatched_lengths(spark):
    ov = spark.createDataFrame([("1", "A", 5000), ("2", "A", 2000), ("2", "B", 1000)], "state1 string, state2 string, bp long")
    l1 = spark.createDataFrame([("1", 5000), ("2", 3000)], "state string, bp long")
    l2 = spark.createDataFrame([("A", 9000), ("B", 3000)], "state string, bp long")
    got = {(r.state1, r.state2): r.jaccard for r in A.jaccard_matrix(ov, l1, l2).collect()}
    assert got == {("1", "A"): pytest.approx(5 / 9), ("1", "B"): 0, ("2", "A"): pytest.approx(0.2), ("2", "B"): pytest.approx(0.2)}


def test_merge_in_blocks(spark):
    rng = np.random.default_rng(1)
    raw = [("c1", int(s), int(s + n), "x") for s, n in zip(rng.integers(0, 3000, 200), rng.integers(0, 30, 200))]
    want, cur = [], None
    for _, s, e, _ in sorted(raw, key=lambda r: (r[1], r[2])):
        if cur and s <= cur[1]:
            cur[1] = max(cur[1], e)
        else:
            cur = [s, e]
            want.append(cur)
    for block in (10, 128, 1 << 20):
        assert rows(I.merge_intervals(segs(spark, raw), block=block), "start", "end") == sorted(map(tuple, want))


def test_empty_inputs(spark):
    none = segs(spark, [])
    assert I.merge_intervals(none).count() == 0
    assert I.region_stats(none).first().asDict() == {"n": 0, "mean_len": 0.0, "median_len": 0.0}
    assert O.overlap_table(none, none).count() == 0
    assert I.depth_sweep(none.withColumn("s", F.lit(1)), "s", 10).count() == 0
    assert I.total_bp(none).first().bp == 0


def test_bins_and_runs(spark):
    s = segs(spark, [("c", 0, 450, "A"), ("c", 450, 460, "B"), ("c", 460, 1000, "A")])
    lab = I.bin_labels(s, 100)
    assert rows(lab, "bin", "state") == [(b, "A") for b in range(10)]
    assert rows(I.runs(lab, 100), "start", "end") == [(0, 1000)]
    assert rows(I.transitions(lab), "from_state", "to_state", "n") == [("A", "A", 9)]


def test_depth_sweep(spark):
    s = spark.createDataFrame([("a", "c", 0, 100, "X"), ("b", "c", 50, 200, "X"), ("d", "c", 60, 80, "X")], "sample string, " + SEG)
    assert rows(I.depth_sweep(s, "sample", 10), "depth", "bins", "cum_bins") == [(1, 15, 15), (2, 3, 18), (3, 2, 20)]


def test_binarize_marks_the_last_bin(spark):
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, size long")
    p = spark.createDataFrame([("c", "m", 150, 250), ("c", "m", 5000, 6000), ("d", "m", 0, 10)], "chrom string, mark string, start long, end long")
    assert rows(B.binarize(p, sizes, 100), "bin") == [(1,), (2,), (9,)]
    coded = B.codes(B.binarize(p, sizes, 100), ["k", "m"])
    assert rows(B.patterns(coded), "code", "n", "n_marks") == [(2, 3, 1)]
    assert rows(B.coverage_by_depth(coded, 2), "depth", "bins", "share") == [(1, 3, 1.0), (2, 0, 0.0)]
    assert B.coverage_by_depth(coded.where("false"), 2).count() == 0


def test_enrichment(spark):
    s = segs(spark, [("c", 0, 100, "A"), ("c", 100, 200, "B"), ("c", 200, 300, "A"), ("c", 300, 400, "B"), ("c", 400, 500, "A")])
    ann = spark.createDataFrame([("c", 0, 50, "x"), ("c", 40, 100, "x"), ("c", 180, 260, "x")], "chrom string, start long, end long, label string")
    got = {r.state: r for r in R.enrichment(s, ann).collect()}
    assert got["A"].coverage == pytest.approx(160 / 300, abs=1e-6) and got["A"].sensitivity == pytest.approx(160 / 180, abs=1e-6)
    assert got["A"].sensitivity_50 == 1 and got["B"].sensitivity_50 == 0
    assert got["A"].coverage_50 == pytest.approx(2 / 3, abs=1e-6) and got["B"].coverage_50 == 0
    fam = R.family_enrichment(s, ann, spark.createDataFrame([("F", "A"), ("F", "B")], "family string, state string")).first()
    assert fam.state == "POOL:F" and fam.sensitivity == 1 and fam.sensitivity_50 == 1


def brute(gain):
    n, m = gain.shape
    return max(sum(gain[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else brute(gain.T)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for shape in [(1, 1), (3, 3), (5, 5), (3, 6), (6, 4), (6, 6)]:
        for _ in range(20):
            g = np.round(rng.random(shape), 2)
            got = M.assign(g)
            assert len(got) == min(shape) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            assert sum(g[i, j] for i, j in got) == pytest.approx(brute(g))
    assert M.assign(np.zeros((0, 3))) == []


def test_match_states_and_relabel(spark, two):
    work, ref = two
    ov = O.overlap_table(work, ref)
    m = M.match_states(ov, I.state_lengths(work), I.state_lengths(ref))
    assert rows(m, "work_state", "ref_state") == [("1", "A"), ("2", "B"), ("3", "C")]
    extra = work.unionByName(segs(spark, [("chr2", 0, 10, "4")]))
    m = M.match_states(O.overlap_table(extra, ref), I.state_lengths(extra), I.state_lengths(ref))
    left = {r.work_state: r.ref_state for r in m.collect()}
    assert left["4"] is None
    out = M.relabel(extra.replace({"4": "12_Zz"}, subset="state"), m)
    assert {r.state for r in out.select("state").distinct().collect()} == {"A", "B", "C", "Zz"}


def test_emission_scalars(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "state string, vec array<double>")
    got = {(r.state1, r.state2): r.cosine for r in E.cosine_matrix(v, v).collect()}
    assert got[("a", "a")] == 1 and got[("a", "b")] == 0 and got[("z", "z")] == 0
    assert E.augmented(v).where("state = 'a'").first().vec == [1.0, 0.0]  # a value over 1 in the table
    assert E.augmented(v.where("state <> 'b'")).where("state = 'z'").first().vec == [0.0, 0.0, 1.0]
    g = {r.state: r.g for r in v.select("state", E.gini(F.col("vec")).alias("g")).collect()}
    assert g["a"] == pytest.approx(0.5) and g["z"] is None


def test_kmeans_separates(spark):
    p = spark.createDataFrame([(0, 100), (1, 5), (62, 5), (63, 90)], "code long, n long")
    got = {r.code: r.label for r in C.kmeans_patterns(p, 6, 2, restarts=2).collect()}
    assert got[0] == got[1] == 0 and got[62] == got[63] == 1
    assert C.kmeans_patterns(p, 6, 0).count() == 0 and C.kmeans_patterns(p.where("false"), 6, 3).count() == 0
    assert len({r.label for r in C.kmeans_patterns(p, 6, 15, restarts=1).collect()}) == 4


def test_top_genes(spark):
    t = spark.createDataFrame([("G1.1", 5.0, 0), ("G2.1", 7.0, 1), ("G3", 5.0, 2), ("G4", 0.0, 3)], "gene_id string, tpm double, ord long")
    assert [r.gene_id for r in G.top_expressed(t, n=2).collect()] == ["G2.1", "G1.1"]
    known = spark.createDataFrame([("G3",), ("G1",)], "gene_id string")
    assert {r.gene_id for r in G.top_expressed(t, known).collect()} == {"G3", "G1.1"}
    model = spark.createDataFrame([("G2.9", "x"), ("q", "G3"), ("none", "none")], "gene_id string, gene_name string")
    assert {r.gene_id: r.tpm for r in G.lookup_tpm(model, t).collect()} == {"G2.9": 7.0, "q": 5.0, "none": 0.0}


def test_rules_of_interpretation(spark):
    em = {
        "1": {"H3K4me3": 0.9, "H3K9ac": 0.9}, "2": {"H3K4me3": 0.3}, "3": {"H3K27ac": 0.8, "H3K4me1": 0.8}, "4": {"H3K36me3": 0.9}, "5": {"H3K27me3": 0.9},
        "6": {"H3K9me3": 0.9}, "7": {"H3K9me3": 0.8, "H3K36me3": 0.8}, "8": {"H3K27me3": 0.8, "H3K27ac": 0.8}, "9": {},
    }
    marks = ["H3K4me3", "H3K9ac", "H3K27ac", "H3K4me1", "H3K36me3", "H3K27me3", "H3K9me3"]
    t = spark.createDataFrame([(s, m, float(v.get(m, 0.01))) for s, v in em.items() for m in marks], "state string, mark string, value double")
    got = {r.state: r.type for r in P.interpret(P.state_evidence(t)).collect()}
    assert got["3"] == "Enhancer" and got["4"] == "Transcribed" and got["5"] == "FacultativeHet" and got["6"] == "ConstitutiveHet"
    assert got["7"] == "K9K36" and got["8"] == "Bivalent" and got["9"] == "Quiescent" and got["1"] == "Promoter" and got["2"] == "PromoterFlanking"
    with pytest.raises(ValueError):
        P.check_types(spark.createDataFrame([("Odd",)], "type string"), spark.createDataFrame([("CTCF",)], "type string"))


def test_ranks(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0)], "method string, value double").withColumn("u", F.lit(1))
    assert {r.method: r.score for r in S.rank_scores(d, ["u"]).collect()} == {"d": 1.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "a": 0.0}
    flat = d.withColumn("value", F.lit(1.0))
    assert {r.score for r in S.rank_scores(flat, ["u"]).collect()} == {None}


def test_curves(spark):
    p = spark.createDataFrame([("m", 0.5, 1.0, 0.5), ("m", 0.0, 0.5, 1.0)], "method string, fpr double, tpr double, precision double")
    assert S.auc(p, ["method"]).first().auc == pytest.approx(0.875)
    assert S.average_precision(p, ["method"]).first().average_precision == pytest.approx(0.75)


def test_wilcoxon_and_spearman(spark):
    assert S.wilcoxon([1.0]) is None and S.wilcoxon([1, 2, 3, 4, 5]) == pytest.approx(2 / 32)
    assert S.wilcoxon([0.0, 1.0, -1.0]) == pytest.approx(1.0)
    assert S.spearman_p(0.9, 10) == pytest.approx(0.000386, abs=2e-5) and S.spearman_p(0.0, 10) == pytest.approx(1.0, abs=1e-6)
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double")
    assert S.spearman(d, "x", "y").first().rho == pytest.approx(1)


def test_names(spark):
    d = spark.createDataFrame([("12_TssA",), ("Quies",), ("background",), ("15_Quies2",), ("ZNF/Rpts",), ("9_Het",), ("EnhG1",)], "s string")
    got = {r.s: (r.n, r.q, r.b, r.p) for r in d.select("s", N.normalize_state(F.col("s")).alias("n"), N.is_quiescent(F.col("s")).alias("q"), N.is_background(F.col("s")).alias("b"), N.in_class(F.col("s"), "promoter").alias("p")).collect()}
    assert got["12_TssA"] == ("TssA", False, False, True) and got["Quies"][1] and got["background"][1] and got["15_Quies2"][1]
    assert not got["ZNF/Rpts"][1] and got["ZNF/Rpts"][2] and got["9_Het"][2] and not got["EnhG1"][2]
    e = spark.createDataFrame([("E10",), ("E2",), ("e1",)], "s string")
    assert [r.s for r in e.orderBy(N.natural_order(F.col("s"))).collect()] == ["e1", "E2", "E10"]
    assert sorted(["E10", "E2", "e1"], key=N.natural_key) == ["e1", "E2", "E10"]


def test_methods_and_labels(spark):
    m = spark.createDataFrame([("Omnicaller",), ("kmeans_macs2",), ("Joint Homer",), ("ref_15",), ("joint",), ("odd",)], "s string")
    assert {r.s: r.k for r in m.select("s", N.normalize_method(F.col("s"), {"omnicaller": "omni"}).alias("k")).collect()} == {
        "Omnicaller": "kmeans_omni", "kmeans_macs2": "kmeans_macs2", "Joint Homer": "joint_kmeans_homer", "ref_15": "chromhmm_default", "joint": "joint_chromhmm", "odd": None,
    }
    paths = {
        "d/omni/rep1/kmeans_states_15.bed": "kmeans_omni_rep1", "d/joint_kmeans/macs2/replicate2_15_dense.bed": "joint_kmeans_macs2_rep2", "x/ENCFF123ABC.bed": "ENCFF123ABC",
        "d/rep2/chromhmm_default_result/x.bed": "chromhmm_default_rep2", "a/foo_matched.bed": "foo",
    }
    p = spark.createDataFrame([(k,) for k in paths], "s string").select("s", N.segmentation_label(F.col("s")).alias("k"))
    assert {r.s: r.k for r in p.collect()} == paths
    q = spark.createDataFrame([("ENCFF1", "kmeans_omni"), ("ENCFF1", "a_rep1"), ("a_rep1", "a_rep2"), ("a_rep1", "b_rep2"), ("a", "b")], "a string, b string")
    assert [r.k for r in q.select(N.should_compare(F.col("a"), F.col("b")).alias("k")).collect()] == [True, False, True, False, False]
    c = spark.createDataFrame([("255,0,10",), ("0,0,0",), ("x",)], "s string")
    assert [r.k for r in c.select(N.rgb_hex(F.col("s")).alias("k")).collect()] == ["#FF000A", None, None]


def test_gates(spark):
    d = spark.createDataFrame([("d", "a", 100, 20), ("d", "b", 10, 20), ("d", "c", 90, 3)], "dataset string, segmentation string, covered long, n_states long")
    bad = S.unusable(d)
    assert rows(bad, "segmentation") == [("b",), ("c",)]
    pairs = spark.createDataFrame([("d", "a/b"), ("d", "a/a")], "dataset string, segmentation string")
    assert rows(S.without_unusable(pairs, bad), "segmentation") == [("a/a",)]
    u = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 3.0), ("n", 1, 5.0)], "method string, unit int, value double")
    assert rows(S.common_units(u, ["unit"]), "method", "mean", "n") == [("m", 1.0, 1), ("n", 5.0, 1)]
    one = S.stability(u, ["method"]).where("method = 'n'").first()
    assert one.cv is None and one.var is None
    assert math.isclose(S.stability(u, ["method"]).where("method = 'm'").first().cv, math.sqrt(2) / 2)
