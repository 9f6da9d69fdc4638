"""Round trips of readers and writers on temporary files."""

import gzip

from pyspark.sql import functions as F

from segloom.operators import binarize as B
from segloom.sources import readers as R
from segloom.sources import writers as W


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bed_readers(spark, tmp_path):
    p = put(tmp_path / "a.bed", "track x\n#c\nchr1\t0\t100\tA\t0\t.\t0\t100\t1,2,3\nchr1\t100\n\nchr2\t5\t9\nbrowser y\n")
    got = [tuple(r)[:5] for r in R.read_bed(spark, p).orderBy("ord").collect()]
    assert got == [("chr1", 0, 100, "A", "1,2,3"), ("chr2", 5, 9, ".", "0,0,0")]
    q = put(tmp_path / "b.bed", "chr1\t0\tx\tA # note\nchr1\t\t5\tB\n\t3\t7\tC\n")
    assert [tuple(r)[:5] for r in R.read_segmentation(spark, q).orderBy("ord").collect()] == [("chr1", 0, 0, "A ", "0,0,0"), ("chrUnk", 3, 7, "C", "0,0,0")]
    z = tmp_path / "c.bed.gz"
    z.write_bytes(gzip.compress(b"chr1\t1\t2\nchr1\tbad\t3\n"))
    assert [tuple(r) for r in R.read_regions(spark, str(z)).collect()] == [("chr1", 1, 2)]


def test_chrom_sizes(spark, tmp_path):
    p = put(tmp_path / "s", "# c\nchr1 2000a\nchr3_random 5\n  chr2\t300  \n")
    assert [(r.chrom, r.size) for r in R.read_chrom_sizes(spark, p).orderBy("ord").collect()] == [("chr1", 2000), ("chr2", 300)]
    assert R.chrom_names(spark, p) == ["chr1", "chr2"] and R.chrom_names(spark, None)[-1] == "chrY"


def test_binary_round_trip(spark, tmp_path):
    bits = spark.createDataFrame([("chr1", 0, "A"), ("chr1", 2, "B"), ("chr2", 1, "A")], "chrom string, bin long, mark string")
    bins = spark.createDataFrame([("chr1", 3), ("chr2", 2)], "chrom string, n_bins long")
    W.write_binary(bits, bins, ["A", "B"], "cell", str(tmp_path / "bin"))
    got = R.read_binary(spark, str(tmp_path / "bin" / "*" / "*.gz"))
    assert got.count() == 10 and {r.cell for r in got.collect()} == {"cell"}
    ones = {(r.chrom, r.bin, r.mark) for r in got.where("v = 1").collect()}
    assert ones == {("chr1", 0, "A"), ("chr1", 2, "B"), ("chr2", 1, "A")}
    assert B.codes(got.where("v = 1"), ["A", "B"]).count() == 3


def test_binary_matrices_are_followed_line_by_line(spark, tmp_path):
    n = 3000
    body = "".join(f"{k % 2}\t{int(k % 7 == 0)}\r\n" for k in range(n))
    put(tmp_path / "p.txt", f"cell\tchr1\r\nA\tB\r\n{body}\n\n")
    (tmp_path / "z.gz").write_bytes(gzip.compress(f"cell\tchr2\nA\tB\n{body}".encode()))
    put(tmp_path / "e.txt", "")
    want = {(c, k, m) for c in ("chr1", "chr2") for k in range(n) for m, one in (("A", k % 2 == 1), ("B", k % 7 == 0)) if one}
    paths = [str(tmp_path / x) for x in ("p.txt", "z.gz", "e.txt")]
    for size in ("128m", "4k", "100"):  # plain files in one part and in many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = R.read_binary(spark, paths)
            assert "wholetext" not in got._jdf.queryExecution().toString().lower()
            rows = got.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == 4 * n and {(r.chrom, r.bin, r.mark) for r in rows if r.v == 1} == want
    empty = spark.createDataFrame([("chr1", 0), ("chr2", 70000)], "chrom string, n_bins long")
    W.write_binary(spark.createDataFrame([("chr2", 69999, "A")], "chrom string, bin long, mark string"), empty, ["A"], "cell", str(tmp_path / "bin"))
    again = R.read_binary(spark, str(tmp_path / "bin" / "*" / "*.gz"))
    assert again.count() == 70000 and [(r.chrom, r.bin) for r in again.where("v = 1").collect()] == [("chr2", 69999)]


def test_genes_and_expression(spark, tmp_path):
    g = put(tmp_path / "g.gtf", '#x\nchr1\th\tgene\t11\t20\t.\t-\t.\tgene_id "G1.2"; gene_name "ABC";\nchr1\th\texon\t11\t20\t.\t-\t.\tgene_id "G1.2";\n')
    r = R.read_genes(spark, g).first()
    assert (r.start, r.end, r.strand, r.gene_id, r.gene_name) == (10, 20, "-", "G1.2", "ABC")
    assert {x.gene_id for x in R.gene_ids(R.read_genes(spark, g)).collect()} == {"G1.2", "G1", "ABC"}
    t = put(tmp_path / "t.tsv", "gene_id\tTPM\nG1\t5\nG2\tN/A\nG1\t7\n")
    assert [(x.gene_id, x.tpm) for x in R.read_tpms(spark, t).collect()] == [("G1", 7.0)]


def test_tables(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "x\t a \tb\n r1\t1\t2\nr2\t\t4\n")
    got = {(r.state, r.mark): r.value for r in R.read_matrix(spark, p).collect()}
    assert got == {("r1", "a"): 1.0, ("r1", "b"): 2.0, ("r2", "a"): None, ("r2", "b"): 4.0}
    assert R.read_matrix(spark, str(tmp_path / "none.tsv")) is None
    assert R.read_table(spark, str(tmp_path / "none.tsv"), "a string,b double").count() == 0
    c = put(tmp_path / "c.tsv", "seg\tkappa\treplicate\nx\t0.5\t\ny\t0.4\trep1\n")
    assert [r.seg for r in R.read_comparisons(spark, c, "seg string,kappa double").collect()] == ["x"]
    d = put(tmp_path / "t.csv", '# o\nState Type;Short Name;Description\nCTCF;CTCF;"two\n lines"\n')
    assert tuple(R.read_types(spark, d).first()) == ("CTCF", "CTCF", "two lines")


def test_config(spark):
    cfg = {"outliers": ["d2"], "datasets": {"d1": {"cell": "K", "bams": {"A1": {"mark": "m", "rep": 1, "control": "C"}, "A2": "m"}}, "d2": {}}}
    sets, files = R.datasets(spark, cfg)
    assert {r.dataset: r.outlier for r in sets.collect()} == {"d1": False, "d2": True}
    assert [r.accession for r in R.accessions(files, "d1", "m", "1").collect()] == ["A1"]
    assert [r.accession for r in R.accessions(files, "d1", "m", "2").collect()] == ["A2"]
    assert [r.control for r in R.controls(files, "d1").collect()] == ["C"]


def test_writers_and_manifest(spark, tmp_path):
    s = spark.createDataFrame([("chr10", 0, 5, "B"), ("chr2", 3, 9, "A"), ("chr2", 0, 3, "A")], "chrom string, start long, end long, state string")
    W.write_bed(s, str(tmp_path / "bed"))
    text = [r.value for r in spark.read.text(str(tmp_path / "bed")).collect()]
    assert sorted(text)[0] == "chr10\t0\t5\tB\t0\t.\t0\t5\t0,0,0" and len(text) == 3
    calls = []

    def compute():
        calls.append(1)
        return s

    out = str(tmp_path / "kept")
    stamp = W.signature(spark, [str(tmp_path / "bed" / "*")], "1")
    for k in range(2):
        assert W.kept(spark, out, stamp, compute).count() == 3
    assert len(calls) == 1
    W.kept(spark, out, "other", compute)
    W.kept(spark, out, "other", compute, valid=lambda d: False)
    assert len(calls) == 3
    joined = W.joint_input(s.withColumn("mark", F.lit("m")), s.where("chrom = 'chr2'").withColumn("mark", F.lit("m")))
    assert {r.chrom for r in joined.collect()} == {"chr2"}
