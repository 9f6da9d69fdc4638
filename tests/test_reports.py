"""Report operators on small tables."""

import pytest
from pyspark.sql import functions as F

from segloom.operators import reports as T
from segloom.operators import scoring as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pairs(spark):
    labels = spark.createDataFrame([("ENCFF1",), ("kmeans_omni",), ("m_rep1",), ("m_rep2",), ("n_rep1",)], "label string")
    assert rows(T.eligible_pairs(labels), "a", "b") == [("ENCFF1", "kmeans_omni"), ("m_rep1", "m_rep2")]
    cat = spark.createDataFrame([("d", "omni", "kmeans_omni", "p"), ("d", "omni", "joint_kmeans_omni", "q")], "dataset string, caller string, method string, path string")
    assert rows(T.individual_joint_pairs(cat), "path", "joint_path") == [("p", "q")]
    reps = spark.createDataFrame([("d", "m", "rep1", "x"), ("d", "m", "rep2", "y"), ("d", "n", "rep1", "z")], "dataset string, method string, rep string, path string")
    assert rows(T.replicate_pairs(reps), "path1", "path2") == [("x", "y")]


def test_compare_pairs(spark):
    s = spark.createDataFrame([("a", "c", 0, 100, "X"), ("a", "c", 100, 200, "Y"), ("b", "c", 0, 150, "X"), ("b", "c", 150, 200, "Y"), ("e", "d", 0, 10, "X")], "id string, chrom string, start long, end long, state string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "e")], "a string, b string")
    got = {(r.a, r.b): r for r in T.compare_pairs(s, pairs).collect()}
    assert (got[("a", "a")].kappa, got[("a", "a")].mean_jaccard, got[("a", "a")].overlap_fraction) == (1, 1, 1)
    assert got[("a", "b")].overlap_fraction == 0.75 and got[("a", "b")].mean_jaccard == pytest.approx((100 / 150 + 50 / 100) / 2)
    assert got[("a", "b")].kappa == pytest.approx((0.75 - 0.5) / 0.5)
    assert (got[("a", "e")].kappa, got[("a", "e")].overlap_fraction) == (0, 0)


def test_lookups(spark):
    table = spark.createDataFrame([("1.0", 5), ("E2", 6)], "name string, v int")
    assert rows(T.lookup_rows(spark.createDataFrame([("1",), ("E2",), ("9",)], "state string"), table).na.fill(0), "state", "v") == [("1", 5), ("9", 0), ("E2", 6)]
    t = spark.createDataFrame([("TssA", "x.hg38", 1, 1.0), ("tss", "x.hg38", 2, 2.0), ("TssA", "y", 3, 3.0)], "state string, label string, ord int, v double")
    assert T.tolerant_lookup(t, "Tss", "x").first().v == 2.0 and T.tolerant_lookup(t, "TssA", "y").first().v == 3.0
    assert T.tolerant_lookup(t, "Tx", "x").count() == 0


def test_orders(spark):
    m = spark.createDataFrame([("a:1", "b:1", 0.5), ("b:1", "a:1", 0.7)], "a string, b string, value double")
    order = spark.createDataFrame([("a:1", 0), ("b:1", 1)], "label string, ord int")
    assert rows(T.upper_pairs(("kappa", m), ("ami", m.where("false")), order=order), "dataset_a", "dataset_b", "kappa", "ami") == [("a", "b", 0.5, None)]
    items = spark.createDataFrame([("x", "g", 0), ("y", "h", 1), ("z", "g", 2)], "n string, g string, ord int")
    assert [r.n for r in T.grouped_order(items, "g").collect()] == ["x", "z", "y"]
    known = spark.createDataFrame([("B", 0)], "state string, ord int")
    got = {r.state: r.ord for r in T.canonical_order(spark.createDataFrame([("A2",), ("B",), ("A1",)], "state string"), known).collect()}
    assert got["B"] < got["A1"] < got["A2"]


def test_gates_and_grids(spark):
    p = spark.createDataFrame([("m", "c", 0, 10), ("m", "c", 5, 20)], "mark string, chrom string, start long, end long")
    f = T.footprint(p, ["mark"])
    assert rows(f, "n", "last", "bp") == [(2, 20, 20)]
    T.check_complete(f, 21)
    with pytest.raises(ValueError):
        T.check_complete(f, 100)
    sizes = spark.createDataFrame([("c", 30, 1), ("d", 25, 2)], "chrom string, size long, ord int")
    assert rows(T.offsets(sizes, 10), "chrom", "n_bins", "first_bin") == [("c", 3, 0), ("d", 3, 3)]
    lab = spark.createDataFrame([("c", 1, "A")], "chrom string, bin long, state string")
    assert rows(T.grid_labels(lab, sizes, 10), "chrom", "bin", "state") == [("c", 0, "0"), ("c", 1, "A"), ("c", 2, "0"), ("d", 0, "0"), ("d", 1, "0")]
    d = spark.createDataFrame([("x", "ref", 1.0), ("ref", "x_rep1", 2.0), ("x", "y", 3.0)], "seg1 string, seg2 string, v double")
    assert rows(T.versus_reference(d, "ref"), "method", "v") == [("x", 1.0)]


def test_peaks_and_scores(spark):
    stats = spark.createDataFrame([("m", "k", "", 0, 0.0, 0.0), ("m", "k", "rep1", 4, 10.0, 9.0), ("m", "k", "rep2", 6, 20.0, 11.0)], "method string, mark string, rep string, n long, mean_len double, median_len double")
    jac = spark.createDataFrame([("m", "k", 0.4)], "method string, mark string, jaccard double")
    assert rows(T.peak_table(stats, jac), "n", "mean_len", "median_len", "jaccard") == [(5.0, 15.0, 10.0, 0.4)]
    ov = spark.createDataFrame([("1", "A", 60), ("1", "B", 20), ("2", "B", 20)], "state1 string, state2 string, bp long")
    mp = spark.createDataFrame([("1", "A", 0.5), ("2", "B", 1.0)], "work_state string, ref_state string, emission double")
    r = T.scorecard(ov, mp, spark.createDataFrame([("x", 0.5), ("y", None)], "label string, f1 double"), F.col("state2") == "A").first()
    assert (r.accuracy, r.balanced, r.regulatory, r.background, r.emission, r.mean_f1) == (0.8, 0.75, 1.0, 0.5, 0.75, None)
    s = spark.createDataFrame([("a", "x", None, 2.0), ("a", "y", 0.3, 1.0), ("b", "x", None, 1.0)], "u string, method string, given double, value double")
    got = {(r.u, r.method): r.score for r in S.score_evidence(s, ["u"]).collect()}
    assert got == {("a", "x"): None, ("a", "y"): 0.3, ("b", "x"): None}
    a = spark.createDataFrame([("m", "x", 1, 0.5), ("m", "y", 2, 0.9), ("m", "z", 3, 0.9)], "method string, axis string, ord int, score double")
    assert rows(S.best_and_worst(a), "best", "worst") == [("y", "x")]
    with pytest.raises(ValueError):
        S.check_axes(a, ["x", "y"])
