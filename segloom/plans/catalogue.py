"""Registered queries of files, names, catalogues and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import agreement as A
from ..operators import emissions as E
from ..operators import enrichment as R
from ..operators import genes as G
from ..operators import interpretation as P
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import reports as T
from ..operators import scoring as S
from ..sources import readers, writers
from ..sources.folder import shared_folder
from . import queries as Q
from . import views as V
from .queries import BIN, WIDTH, pair, query, rounded, sides


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a small table."""
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _file(spark: SparkSession, name: str, lines: DataFrame, head: list[str] = (), gzip: bool = False) -> str:
    """A folder of one text file: head lines, then lines (ord, value) in order."""
    path = shared_folder(spark, name)
    top = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "ord long, value string") if head else None
    rows = lines.select(F.col("ord").cast("long").alias("ord"), "value")
    full = rows if top is None else top.unionByName(rows)
    full.coalesce(1).sortWithinPartitions("ord").select("value").write.option("compression", "gzip" if gzip else "none").text(path)
    return path


def _tabbed(*columns) -> F.Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))


def _one_side(spark, sf) -> DataFrame:
    s = sides(spark, sf)[0]
    return s.withColumn("ord", F.xxhash64("chrom", "start"))


_ONE = 'SELECT chrom, start, "end", state FROM seg WHERE side = 0'


# --- readers ---------------------------------------------------------------------------------------------------------------------


@query(V.with_views("seg", {}, f"""SELECT chrom, start, "end", CASE WHEN start % 5 = 0 THEN '.' ELSE state END AS state, '0,0,0' AS color, "end" - start AS length FROM ({_ONE})"""))
def segmentation_read(spark, sf):
    name = F.when(F.col("start") % 5 == 0, "").otherwise(F.concat("state", F.when(F.col("start") % 3 == 0, "#note").otherwise("")))
    path = _file(spark, "bed4", _one_side(spark, sf).select("ord", _tabbed("chrom", "start", "end", name).alias("value")), ["track name=x", "browser position chr1", "# comment"])
    return readers.read_segmentation(spark, path).select("chrom", "start", "end", "state", "color", "length")


@query(V.with_views("seg", {}, f"""SELECT chrom, start, "end", state, CASE WHEN start % 2 = 0 THEN '255,0,0' ELSE '128,128,128' END AS color, 's1' AS sample FROM ({_ONE}) WHERE start % 5 <> 0"""))
def segment_frame_read(spark, sf):
    name = F.when(F.col("start") % 5 == 0, "").otherwise(F.col("state"))
    color = F.when(F.col("start") % 2 == 0, "255,0,0").otherwise("")
    line = _tabbed("chrom", "start", "end", name, F.lit("0"), F.lit("."), "start", "end", color)
    path = _file(spark, "bed9", _one_side(spark, sf).select("ord", line.alias("value")), ["track name=x"], gzip=True)
    return readers.read_segment_frame(spark, path, "s1").select("chrom", "start", "end", "state", "color", "sample")


@query(V.with_views("ann", {}, """SELECT chrom, start, "end" FROM ann WHERE start % 7 <> 0"""))
def regions_read(spark, sf):
    start = F.when(F.col("start") % 7 == 0, "12x").otherwise(F.col("start").cast("string"))
    path = _file(spark, "regions", V.ann(spark, sf).select(F.col("start").alias("ord"), _tabbed("chrom", start, "end").alias("value")), ["#chrom\tstart\tend", "browser x", "chr1\t5"])
    return readers.read_regions(spark, path)


@query("SELECT CAST(3 AS BIGINT) AS n")
def header_lines(spark, sf):
    lines = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("ord"), F.when(F.col("r_regionkey") == 2, "track late").otherwise("chr1\t1\t2").alias("value"))
    return readers.header_lines(spark, _file(spark, "head", lines, ["track a", "browser b", "track c"]))


@query("""SELECT 'chr' || n_nationkey AS chrom, CAST((n_nationkey + 1) * 1000 AS BIGINT) AS size, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS ord FROM nation WHERE n_nationkey % 5 <> 0""")
def chrom_sizes_read(spark, sf):
    n = F.col("n_nationkey")
    name = F.concat(F.lit("chr"), n.cast("string"), F.when(n % 5 == 0, "_random").otherwise(""))
    size = F.concat(((n + 1) * 1000).cast("string"), F.when(n % 2 == 0, "bp").otherwise(""))
    lines = V.table(spark, sf, "nation").select(n.alias("ord"), F.concat_ws(" \t ", name, size).alias("value"))
    return readers.read_chrom_sizes(spark, _file(spark, "sizes", lines, ["# sizes", "", "chrBroken"]))


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) AS place, 'chr' || n_nationkey AS chrom FROM nation WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT -row_number() OVER (), c FROM (SELECT unnest(['chr1', 'chr2', 'chr3']) AS c)""")
def chrom_names_read(spark, sf):
    n = F.col("n_nationkey")
    lines = V.table(spark, sf, "nation").select(n.alias("ord"), _tabbed(F.concat(F.lit("chr"), n.cast("string"), F.when(n % 5 == 0, "_x").otherwise("")), (n + 1).cast("string")).alias("value"))
    known, plain = readers.chrom_names(spark, _file(spark, "names", lines)), readers.chrom_names(spark, None)[:3]
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(known)] + [(-1 - k, c) for k, c in enumerate(plain)], "place long, chrom string")


@query("""WITH q AS (SELECT 'G' || (p_partkey // 2) AS gene_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS tpm, p_partkey FROM part)
    SELECT gene_id, CAST(arg_max(tpm, p_partkey) AS DOUBLE) AS tpm FROM q WHERE tpm IS NOT NULL GROUP BY 1""")
def tpm_read(spark, sf):
    key = F.col("p_partkey")
    tpm = F.when(key % 9 == 0, "N/A").otherwise(F.col("p_size").cast("string"))
    lines = V.table(spark, sf, "part").select(key.alias("ord"), _tabbed(F.concat(F.lit("G"), F.expr("p_partkey div 2").cast("string")), F.lit("t"), tpm).alias("value"))
    return readers.read_tpms(spark, _file(spark, "tpm", lines, ["gene_id\ttranscript_ids\tTPM"])).select("gene_id", "tpm")


def _gtf(spark, sf) -> str:
    g = V.genes(spark, sf)
    attr = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; gene_type "x"; gene_name "N'), F.col("ord").cast("string"), F.lit('.1";'))
    kind = F.when(F.col("ord") % 4 == 0, "transcript").otherwise("gene")
    lines = g.select("ord", _tabbed("chrom", F.lit("src"), kind, (F.col("start") + 1).cast("string"), "end", F.lit("."), "strand", F.lit("."), attr).alias("value"))
    return _file(spark, "gtf", lines, ["##gtf", "chr1\tshort"], gzip=True)


@query(V.with_views("genes", {}, """SELECT chrom, start, "end", strand, gene_id, 'N' || ord || '.1' AS gene_name FROM genes WHERE ord % 4 <> 0"""))
def gene_models_read(spark, sf):
    return readers.read_genes(spark, _gtf(spark, sf)).drop("ord")


@query(V.with_views("genes", {}, """SELECT DISTINCT unnest([gene_id, base_id, 'N' || ord || '.1', 'N' || ord]) AS gene_id FROM genes WHERE ord % 4 <> 0"""))
def gene_ids_read(spark, sf):
    return readers.gene_ids(readers.read_genes(spark, _gtf(spark, sf)))


@query(V.with_views("emis", {}, "SELECT state, mark, value FROM emis"))
def emission_archive(spark, sf):
    path = f"{shared_folder(spark, 'npz')}/emissions.npz"
    writers.write_emissions_npz(V.emis(spark, sf), path)
    return readers.read_emissions_npz(spark, path)


_TYPES = [("Promoter", "Pr", "Active; start"), ("Enhancer", "En", "Two lines here"), ("Quiescent", "Q", "Nothing")]


@query(_values("type, short, description", _TYPES))
def types_read(spark, sf):
    path = f"{shared_folder(spark, 'types')}"
    text = "﻿ type ; short; description\n# comment\n" + "\n".join(f'{a};{b} ;"{c.replace("lines ", "lines" + chr(10) + "  ")}"' for a, b, c in _TYPES)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return readers.read_types(spark, path)


_CONFIG = {
    "outliers": ["K2"],
    "datasets": {
        "K1": {"cell": "k562", "ref_chromhmm": "ENCFF1", "rnaseq": "ENCFF2", "replicates": True, "bams": {"A1": {"mark": "H3K4me3", "rep": 1, "control": "C1"}, "A2": {"mark": "H3K4me3", "rep": 2, "control": "C1"}, "A3": "H3K27ac"}},
        "K2": {"cell": "hepg2", "bams": {"B1": {"mark": "H3K4me3"}}},
    },
}


@query(_values("dataset, cell, reference, rnaseq, atac, replicates, outlier", [("K1", "k562", "ENCFF1", "ENCFF2", None, True, False), ("K2", "hepg2", None, None, None, False, True)]))
def data_sets(spark, sf):
    return readers.datasets(spark, _CONFIG)[0]


@query(_values("which, accession", [("all", "A1"), ("all", "A2"), ("mark", "A3"), ("rep", "A1"), ("untagged", "B1"), ("control", "C1")]))
def accessions(spark, sf):
    files = readers.datasets(spark, _CONFIG)[1]
    named = lambda d, n: d.select(F.lit(n).alias("which"), F.col(d.columns[0]).alias("accession"))
    parts = [named(readers.accessions(files, "K1", "H3K4me3"), "all"), named(readers.accessions(files, "K1", "H3K27ac"), "mark"), named(readers.accessions(files, "K1", "H3K4me3", "1"), "rep"),
             named(readers.accessions(files, "K2", "H3K4me3", "1"), "untagged"), named(readers.controls(files, "K1"), "control")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_values("cell, mark, file, control", [("K1", "H3K4me3", "A1.bam", "C1.bam"), ("K1", "H3K4me3", "A2.bam", "C1.bam"), ("K1", "H3K27ac", "A3.bam", ""), ("K2", "H3K4me3", "B1.bam", "")]))
def cell_marks(spark, sf):
    return writers.cell_mark_table(readers.datasets(spark, _CONFIG)[1])


@query(V.with_views("seg", {}, f"SELECT * FROM ({_ONE}) WHERE chrom = 'chr3'"))
def one_chromosome(spark, sf):
    path = shared_folder(spark, "bed")
    writers.write_bed(sides(spark, sf)[0], path)
    return readers.on_chromosome(readers.read_bed(spark, path), "chr3").select("chrom", "start", "end", "state")


@query("""SELECT 'f' || n_regionkey AS file, n_name AS name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS ord FROM nation""")
def files_in_order(spark, sf):
    """Lines of several gzip files of one glob, in the order of file names."""
    folder = shared_folder(spark, "many")
    n = V.table(spark, sf, "nation")
    for k in range(5):
        n.where(F.col("n_regionkey") == k).coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.option("compression", "gzip").text(f"{folder}/f{k}")
    rows = readers.lines(spark, f"{folder}/*/*.gz")
    numbered = rows.select(F.regexp_extract("file", "(f[0-9])/[^/]*$", 1).alias("file"), F.col("value").alias("name"), "ord")
    return S.in_sequence(numbered, "ord")


@query(V.with_views("ann", {}, "SELECT chrom, start, \"end\", label AS mark, CAST(start % 17 AS DOUBLE) / 2 AS value FROM ann WHERE label = 'O'"))
def signal_track(spark, sf):
    a = V.ann(spark, sf).where("label = 'O'")
    line = F.concat_ws(" ", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), ((F.col("start") % 17).cast("double") / 2).cast("string"))
    return readers.read_bedgraph(spark, _file(spark, "track", a.select(F.col("start").alias("ord"), line.alias("value")), ["track type=bedGraph", "# x"]), "O")


# --- writers ---------------------------------------------------------------------------------------------------------------------


@query(Q.ORACLE["mark_runs"])
def mark_beds(spark, sf):
    path = shared_folder(spark, "marks")
    writers.write_mark_beds(Q.mark_runs(spark, sf), path)
    f = F.split("value", "\t")
    return spark.read.text(path).select("mark", f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


@query(V.with_views("seg", Q._OV, """SELECT l1.state AS state1, l2.state AS state2, round(coalesce(ov.bp, 0) / (l1.bp + l2.bp - coalesce(ov.bp, 0)), 4) AS jaccard
    FROM l1 CROSS JOIN l2 LEFT JOIN ov ON state1 = l1.state AND state2 = l2.state"""))
def matching_tables(spark, sf):
    ov, l1, l2 = pair(spark, sf)
    path, states = shared_folder(spark, "match"), sorted(r.state for r in l2.collect())
    writers.write_matching(M.match_states(ov, l1, l2), A.jaccard_matrix(ov, l1, l2), states, path)
    return readers.read_matrix(spark, f"{path}/jaccard", "state1", "state2").withColumnRenamed("value", "jaccard")


@query(V.with_views("seg ann", Q._enrich_sql(_ONE), "SELECT state, label, coverage AS value FROM out"))
def enrichment_tables(spark, sf):
    path = shared_folder(spark, "enrich")
    writers.write_enrichment(R.enrichment(sides(spark, sf)[0], V.ann(spark, sf), WIDTH), path, ["F", "O", "P"])
    return readers.read_matrix(spark, f"{path}/coverage", "state", "label")


@query(V.with_views("seg", {}, """SELECT state, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS total_bp, round(avg("end" - start), 1) AS mean_len, round(median("end" - start), 1) AS median_len FROM seg GROUP BY 1"""))
def report_table(spark, sf):
    path = shared_folder(spark, "report")
    writers.write_table(I.state_report(V.seg(spark, sf)), path, 1, [N.natural_order(F.col("state"))])
    return readers.read_table(spark, path, "state string,n bigint,total_bp bigint,mean_len double,median_len double")


@query(V.with_views("seg", Q._TR | {"a": "SELECT from_state, to_state, sum(n) AS n FROM tr GROUP BY 1, 2", "s": "SELECT DISTINCT state FROM seg"}, """SELECT f.state AS from_state, t.state AS to_state,
    round(coalesce(n / sum(n) OVER (PARTITION BY f.state), 0), 6) AS value FROM s f CROSS JOIN s t LEFT JOIN a ON from_state = f.state AND to_state = t.state"""))
def transition_table(spark, sf):
    s = V.seg(spark, sf)
    moves = I.transitions(I.bin_labels(s, BIN, ["side"]), ["side"])
    total = moves.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))
    path, states = shared_folder(spark, "moves"), sorted(r.state for r in s.select("state").distinct().collect())
    writers.write_transitions(total, I.transition_entropy(total, I.state_lengths(s)).select("state", "entropy"), states, path)
    return readers.read_matrix(spark, f"{path}/transitions", "from_state", "to_state")


@query(Q.ORACLE["symmetric_matrix"])
def metric_matrix(spark, sf):
    labels = V.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()
    path = shared_folder(spark, "metric")
    writers.write_metrics(A.symmetric_matrix(Q._values(spark, sf), labels), sorted(r.label for r in labels.collect()), path)
    return readers.read_matrix(spark, path, "a", "b")


@query(V.with_views("seg", Q._OV, """SELECT round(CAST(sum(CASE WHEN state1 = state2 THEN bp ELSE 0 END) AS DOUBLE) / (SELECT sum(bp) FROM l1), 6) AS similarity FROM ov"""))
def pair_report(spark, sf):
    ov, l1, l2 = pair(spark, sf)
    same = l1.select(F.col("state").alias("work_state"), F.col("state").alias("ref_state"))
    path = shared_folder(spark, "pair")
    writers.write_pair_report(ov, same, l1, A.jaccard_matrix(ov, l1, l2), sorted(r.state for r in l2.collect()), path)
    return readers.read_table(spark, f"{path}/similarity", "similarity double")


@query(V.with_views("peaks", Q._BIT, "SELECT DISTINCT chrom, bin, mark FROM bits WHERE mark IN ('AF', 'RF') AND chrom <> 'chr0'"))
def joint_input(spark, sf):
    bits = Q._bits(spark, sf).withColumn("v", F.lit(1).cast("tinyint"))
    rep = lambda n, marks, chrom: bits.where(F.col("mark").isin(marks) & (F.col("chrom") != chrom)).withColumn("cell", F.lit(n))
    both = writers.joint_input(rep("rep1", ["AF", "RF", "NO"], "none"), rep("rep2", ["AF", "RF", "AO"], "chr0"))
    return both.groupBy("chrom", "bin", "mark").agg(F.count("*").alias("n")).where("n = 2").drop("n")


@query(V.with_views("peaks", Q._BIT, "SELECT label, count(*) AS n FROM (SELECT CASE WHEN chrom = 'chr1' THEN 't5' ELSE 't9' END AS label FROM bits WHERE chrom IN ('chr1', 'chr2')) GROUP BY 1"))
def sweep_input(spark, sf):
    bits = Q._bits(spark, sf)
    rows = writers.sweep_input({"t5": bits.where("chrom = 'chr1'"), "t9": bits.where("chrom = 'chr2'")})
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS k, CAST(1 AS INTEGER) AS computed FROM region")
def kept_table(spark, sf):
    """A table that is computed once, though it is asked for twice."""
    path, made = shared_folder(spark, "kept"), []
    stamp = writers.signature(spark, [f"{sf}/region.parquet"], "1")

    def compute() -> DataFrame:
        made.append(1)
        return V.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))

    for _ in range(2):
        table = writers.kept(spark, path, stamp, compute)
    return table.withColumn("computed", F.lit(len(made)))


# --- names -----------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, n, n IN ('Tss', 'TssA', 'TssAFlnk') AS promoter_core, n IN ('Tx', 'TxA', 'TxWk', 'TxFlnk') AS transcribed, n IN ('TssBiv', 'BivFlnk', 'EnhBiv', 'Biv') AS bivalent
    FROM (SELECT p_partkey, ['Tss', 'TssA', 'TxWk', 'Biv', 'Quies', 'tss'][1 + p_size % 6] AS n FROM part)""")
def state_classes(spark, sf):
    bare = F.element_at(F.array(*map(F.lit, ["Tss", "TssA", "TxWk", "Biv", "Quies", "tss"])), (1 + F.col("p_size") % 6).cast("int"))
    full = F.concat(F.col("p_size").cast("string"), F.lit("_"), bare)
    return V.table(spark, sf, "part").select("p_partkey", bare.alias("n"), *(N.in_class(full, c).alias(c) for c in ("promoter_core", "transcribed", "bivalent")))


_METHODS = [("Kmeans Homer", "kmeans_homer", "homer", False), ("joint macs2", "joint_kmeans_macs2", "macs2", True), ("individual", "chromhmm_default", "chromhmm", False), ("omni_kmeans", "kmeans_omni", "omni", False), ("something", None, "chromhmm", False)]


@query(_values("name, key, caller, joint", _METHODS))
def method_names(spark, sf):
    rows = spark.createDataFrame([(m[0],) for m in _METHODS], "name string")
    return rows.select("name", N.normalize_method(F.col("name")).alias("key"), N.caller_of(F.col("name")).alias("caller"), N.is_joint(F.col("name")).alias("joint"))


_PATHS = [("out/kmeans/homer/rep1/kmeans_states.bed", "kmeans_homer_rep1", 100), ("x/joint_chromhmm/cell.bed", "joint_chromhmm", 200), ("refs/ENCFF123.bed", "ENCFF123", 200), ("a/chromhmm_default_result/s.bed", "chromhmm_default", 200), ("x/other_matched.bed", "other", 200)]


@query(_values("path, label, bin", _PATHS))
def path_labels(spark, sf):
    rows = spark.createDataFrame([(p[0],) for p in _PATHS], "path string")
    label = N.segmentation_label(F.col("path"))
    return rows.select("path", label.alias("label"), N.bin_size(label).alias("bin"))


@query(_values("rgb, hex", [("255,0,10", "#FF000A"), ("0,0,0", None), ("1,2", None), ("300,1,1", None), ("16, 17,18", "#101112")]))
def colours(spark, sf):
    return spark.createDataFrame([("255,0,10",), ("0,0,0",), ("1,2",), ("300,1,1",), ("16, 17,18",)], "rgb string").select("rgb", N.rgb_hex(F.col("rgb")).alias("hex"))


@query(_values("text, work, ref", [("a=b;c=d", "a", "b"), ("a=b;c=d", "c", "d")]))
def mapping_texts(spark, sf):
    rows = spark.createDataFrame([("a=b;c=d",), ("",), (None,)], "text string")
    return rows.select("text", F.explode(N.parse_mapping(F.col("text"))).alias("work", "ref"))


@query(_values("value, flag", [("yes", True), ("FALSE", False), (None, True), ("0", False), ("", False)]))
def flags(spark, sf):
    return spark.createDataFrame([("yes",), ("FALSE",), (None,), ("0",), ("",)], "value string").select("value", N.flag(F.col("value")).alias("flag"))


@query("""SELECT a.n_name AS a, b.n_name AS b, lower(split_part(replace(a.n_name, ' ', '_'), '_', 1)) = lower(split_part(replace(b.n_name, ' ', '_'), '_', 1)) AS same FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def same_biosamples(spark, sf):
    names = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    one, two = names.toDF("i", "a"), names.toDF("j", "b")
    cut = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    return one.join(F.broadcast(two), F.col("i") < F.col("j")).select("a", "b", T.same_biosample(cut("a"), cut("b")).alias("same"))


@query("""SELECT n_name AS name, n_regionkey AS grp, row_number() OVER (ORDER BY g, n_nationkey) AS place FROM (SELECT *, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS g FROM nation)""")
def grouped_items(spark, sf):
    items = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("ord"))
    ordered = T.grouped_order(items, "grp").withColumn("__p", F.struct(F.min("ord").over(Q.Window.partitionBy("grp")), "ord"))
    return S.in_sequence(ordered, "__p", "place").select("name", "grp", "place")


# --- catalogues and reports ------------------------------------------------------------------------------------------------------

_LABELS = ["ENCFF1", "kmeans_homer", "kmeans_homer_rep1", "kmeans_homer_rep2", "joint_chromhmm", "kmeans_omni_rep1"]


@query(f"""WITH l AS (SELECT unnest({_LABELS}) AS n) SELECT x.n AS a, y.n AS b FROM l x JOIN l y ON x.n < y.n
    WHERE CASE WHEN starts_with(x.n, 'ENCFF') THEN NOT regexp_matches(y.n, '_rep[12]$') WHEN starts_with(y.n, 'ENCFF') THEN NOT regexp_matches(x.n, '_rep[12]$')
    ELSE regexp_matches(x.n, '_rep[12]$') AND regexp_matches(y.n, '_rep[12]$') AND regexp_replace(x.n, '_rep[12]$', '') = regexp_replace(y.n, '_rep[12]$', '') END""")
def eligible_pairs(spark, sf):
    return T.eligible_pairs(spark.createDataFrame([(x,) for x in _LABELS], "label string"))


_CATALOGUE = [(f"d{d}", c, f"{j}kmeans_{c}", r, f"p{d}{c}{j}{r}") for d in (1, 2) for c in ("homer", "omni") for j in ("", "joint_") for r in ("rep1", "rep2") if not (d == 2 and j and c == "omni")]
_CAT = {"c": _values("dataset, caller, method, rep, path", _CATALOGUE)}


def _catalogue(spark) -> DataFrame:
    return spark.createDataFrame(_CATALOGUE, "dataset string, caller string, method string, rep string, path string")


@query(V.with_views("", _CAT, "SELECT a.dataset, a.caller, a.method, a.path, b.path AS joint_path FROM c a JOIN c b ON a.dataset = b.dataset AND a.caller = b.caller WHERE a.rep = 'rep1' AND b.rep = 'rep1' AND a.method NOT LIKE 'joint%' AND b.method LIKE 'joint%'"))
def joint_pairs(spark, sf):
    return T.individual_joint_pairs(_catalogue(spark).where("rep = 'rep1'").drop("rep")).select("dataset", "caller", "method", "path", "joint_path")


@query(V.with_views("", _CAT, "SELECT a.dataset, a.method, a.path AS path1, b.path AS path2 FROM c a JOIN c b ON a.dataset = b.dataset AND a.method = b.method WHERE a.rep = 'rep1' AND b.rep = 'rep2'"))
def replicate_pairs(spark, sf):
    return T.replicate_pairs(_catalogue(spark).drop("caller")).select("dataset", "method", "path1", "path2")


@query("""WITH m AS (SELECT l_returnflag || ':x' AS f, l_linestatus || ':y' AS s, round(avg(CAST(l_discount AS DOUBLE)), 6) AS kappa, round(avg(CAST(l_tax AS DOUBLE)), 6) AS ami, count(*) FILTER (l_linenumber = 99) AS none FROM lineitem GROUP BY 1, 2),
    o AS (SELECT n, row_number() OVER (ORDER BY n) AS ord FROM (SELECT DISTINCT f AS n FROM m UNION SELECT DISTINCT s FROM m)),
    p AS (SELECT f AS a, s AS b, kappa, ami FROM m UNION ALL SELECT s, f, kappa, ami FROM m)
    SELECT 'all' AS method, a, b, kappa, ami, split_part(a, ':', 1) AS dataset_a, split_part(b, ':', 1) AS dataset_b FROM p JOIN o x ON x.n = a JOIN o y ON y.n = b WHERE x.ord < y.ord""")
def inter_dataset(spark, sf):
    m = V.table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", F.lit(":x")).alias("f"), F.concat("l_linestatus", F.lit(":y")).alias("s")).agg(
        F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("kappa"), F.round(F.avg(F.col("l_tax").cast("double")), 6).alias("ami"))
    both = lambda c: m.select(F.col("f").alias("a"), F.col("s").alias("b"), F.col(c).alias("value")).unionByName(m.select(F.col("s").alias("a"), F.col("f").alias("b"), F.col(c).alias("value")))
    names = m.select(F.col("f").alias("label")).unionByName(m.select(F.col("s").alias("label"))).distinct()
    order = S.in_sequence(names, "label", "ord")
    rows = T.upper_pairs(("kappa", both("kappa")), ("ami", both("ami")), order=order).withColumn("method", F.lit("all"))
    path = shared_folder(spark, "inter")
    writers.write_inter_dataset(rows.select("method", "dataset_a", "dataset_b", "a", "b", "kappa", "ami"), path)
    return readers.read_table(spark, path, "method string,a string,b string,kappa double,ami double,dataset_a string,dataset_b string")


@query(V.with_views("emis", {}, """SELECT w.state, mark, value FROM (SELECT state || '.0' AS state, state AS own FROM emis GROUP BY ALL UNION ALL SELECT 'missing', NULL) w LEFT JOIN emis e ON e.state = w.own"""))
def emission_rows(spark, sf):
    e = V.emis(spark, sf)
    wanted = e.select(F.concat("state", F.lit(".0")).alias("state")).distinct().unionByName(spark.createDataFrame([("missing",)], "state string"))
    found = T.lookup_rows(wanted, E.vectors(e).withColumnRenamed("state", "name"))
    each = found.select("state", F.posexplode_outer("vec").alias("j", "value"))
    return each.select("state", F.when(F.col("j").isNotNull(), F.concat(F.lit("m"), F.col("j").cast("string"))).alias("mark"), "value")


@query("""SELECT l_returnflag AS method, count(*) AS n_segments, round(avg(CAST(l_tax AS DOUBLE)), 6) AS entropy FROM lineitem GROUP BY 1""")
def comparison_table(spark, sf):
    t = V.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "method")
    methods = S.in_order(t.select("method").distinct(), "method", ["R", "N"]).unionByName(spark.createDataFrame([("R_dense", 9)], "method string, ord int"))
    n, h = t.groupBy("method").agg(F.count("*").alias("n_segments")), t.groupBy("method").agg(F.round(F.avg(F.col("l_tax").cast("double")), 6).alias("entropy"))
    return T.comparison_table(methods, n, h).select("method", "n_segments", "entropy")


@query(V.with_views("seg", Q._OV | {"r": "SELECT state2, state2 IN ('click', 'view') AS reg, CAST(sum(CASE WHEN state1 = state2 THEN bp ELSE 0 END) AS DOUBLE) AS hit, CAST(sum(bp) AS DOUBLE) AS bp FROM ov GROUP BY 1"},
    """SELECT round(sum(hit) / sum(bp), 6) AS accuracy, round(avg(hit / bp), 6) AS balanced, round(sum(hit) FILTER (reg) / sum(bp) FILTER (reg), 6) AS regulatory, round(sum(hit) FILTER (NOT reg) / sum(bp) FILTER (NOT reg), 6) AS background,
    CAST(0.5 AS DOUBLE) AS emission, CAST(0.25 AS DOUBLE) AS mean_f1 FROM r"""))
def scorecard(spark, sf):
    ov, l1, _ = pair(spark, sf)
    same = l1.select(F.col("state").alias("work_state"), F.col("state").alias("ref_state"), F.lit(0.5).alias("emission"))
    f1 = spark.createDataFrame([("a", 0.2), ("b", 0.3)], "label string, f1 double")
    return rounded(T.scorecard(ov, same, f1, F.col("state2").isin("click", "view")))


@query(V.with_views("emis", Q._SC | {"ag": "SELECT * FROM sc UNION ALL SELECT state, 'zz', 1 - max(value) FROM sc GROUP BY 1", "c": Q._COS.format("ag"),
    "s": "SELECT DISTINCT state FROM emis UNION ALL SELECT 'other'"}, """SELECT x.state AS state1, y.state AS state2, round(coalesce(cosine, (SELECT avg(cosine) FROM c)), 4) AS cosine FROM s x CROSS JOIN s y LEFT JOIN c ON c.state1 = x.state AND c.state2 = y.state"""))
def emission_grid(spark, sf):
    e = V.emis(spark, sf)
    states = e.select("state").distinct().unionByName(spark.createDataFrame([("other",)], "state string"))
    return rounded(E.similarity_for(e, e, states, states, (False, False)), 4)


_TWO = {"two": "SELECT state, mark, value * (1 + CAST(substr(mark, 2) AS INTEGER)) AS value FROM emis WHERE mark <> 'm5'"}


@query(V.with_views("emis", _TWO | {"c": "SELECT state, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS cosine FROM emis a JOIN two b USING (state, mark) GROUP BY 1"},
    "SELECT round(avg(cosine), 5) AS cosine, count(*) AS n_states FROM c"))
def same_state_cosine(spark, sf):
    e = V.emis(spark, sf)
    two = e.where("mark <> 'm5'").withColumn("value", F.col("value") * (1 + F.substring("mark", 2, 9).cast("int")))
    return rounded(E.same_state_cosine(e, two), 5)


@query(V.with_views("seg", {"k": "SELECT side, chrom, start, state, row_number() OVER (PARTITION BY side ORDER BY chrom, start) AS i FROM seg", "p": """SELECT a.state, b.state AS ref, count(*) AS n FROM k a JOIN k b ON a.i = b.i
    WHERE a.side = 1 AND b.side = 0 AND a.i <= 1000 GROUP BY 1, 2""", "m": "SELECT state, arg_max(ref, (n, ref)) AS ref FROM p GROUP BY 1"}, """SELECT ref AS state, 'm' AS mark, round(avg(CAST(length(state) AS DOUBLE)), 6) AS value FROM m GROUP BY 1"""))
def zipped_emissions(spark, sf):
    place = F.struct("chrom", "start")
    one, two = (s.withColumn("ord", place) for s in sides(spark, sf))
    values = V.seg(spark, sf).select("state").distinct().select("state", F.lit("m").alias("mark"), F.length("state").cast("double").alias("value"))
    return rounded(T.zipped_emissions(one, two, values))


@query("""WITH s AS (SELECT l_returnflag AS method, l_linestatus AS mark, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'rep1' ELSE 'rep2' END AS rep, count(*) FILTER (l_suppkey % 2 = 0 OR l_linenumber % 3 <> 0) AS n, avg(CAST(l_quantity AS DOUBLE)) AS mean_len FROM lineitem GROUP BY 1, 2, 3)
    SELECT method, mark, round(coalesce(max(n) FILTER (rep = '' AND n > 0), avg(n) FILTER (rep <> '' AND n > 0), 0.0), 6) AS n, round(coalesce(max(mean_len) FILTER (rep = '' AND n > 0), avg(mean_len) FILTER (rep <> '' AND n > 0), 0.0), 6) AS mean_len,
    round(coalesce(max(mean_len) FILTER (rep = '' AND n > 0), avg(mean_len) FILTER (rep <> '' AND n > 0), 0.0), 6) AS median_len, CASE WHEN method = 'A' THEN CAST(0.5 AS DOUBLE) END AS jaccard FROM s GROUP BY 1, 2""")
def peak_table(spark, sf):
    rep = F.expr("case l_linenumber % 3 when 0 then '' when 1 then 'rep1' else 'rep2' end")
    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("mark"), rep.alias("rep"))
    stats = t.agg(F.count(F.when((F.col("l_suppkey") % 2 == 0) | (F.col("l_linenumber") % 3 != 0), 1)).alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("mean_len")).withColumn("median_len", F.col("mean_len"))
    jac = stats.where("method = 'A'").select("method", "mark").distinct().withColumn("jaccard", F.lit(0.5))
    return rounded(T.peak_table(stats, jac))


@query(V.with_views("seg", {}, """SELECT side, state, round(sum("end" - start) / sum(sum("end" - start)) OVER (PARTITION BY side), 6) AS share FROM seg GROUP BY 1, 2"""))
def coverage_share(spark, sf):
    return rounded(T.coverage_share(V.seg(spark, sf), ["side"]))


_VS = [("ENCFF1", "kmeans_homer", "E1", 0.5), ("kmeans_omni", "ENCFF1", "E1", 0.25), ("ENCFF1", "kmeans_homer_rep1", "E1", 0.1), ("kmeans_homer", "kmeans_omni", "E2", 0.9)]


@query(_values("seg1, seg2, state, kappa, method", [(*_VS[0], "kmeans_homer"), (*_VS[1], "kmeans_omni")]))
def versus_reference(spark, sf):
    return T.versus_reference(spark.createDataFrame(_VS, "seg1 string, seg2 string, state string, kappa double"), "ENCFF1")


@query(V.with_views("seg ann", Q._enrich_sql(_ONE) | {"z": 'SELECT state, sum("end" - start) AS sbp FROM s GROUP BY 1', "w": 'SELECT label, median(coverage / fold) FILTER (fold > 0) * 12000000 AS lbp FROM out GROUP BY 1',
    "b": "SELECT label, sum(coverage * sbp) AS shared, sum(sbp) AS bp FROM out JOIN z USING (state) WHERE state IN ('click', 'view') GROUP BY 1"},
    "SELECT label, round(least(shared / lbp, 1), 5) AS sensitivity, round(shared / bp, 5) AS precision, round(2 * least(shared / lbp, 1) * (shared / bp) / (least(shared / lbp, 1) + shared / bp), 5) AS f1 FROM b JOIN w USING (label) WHERE label LIKE 'O%'"))
def recovered_family(spark, sf):
    seg = sides(spark, sf)[0]
    return rounded(R.recovered(R.enrichment(seg, V.ann(spark, sf), WIDTH), I.state_report(seg).select("state", "total_bp"), ["click", "view"], "O", 12_000_000), 5)


_TOL = [("12_TssA", "tss.x", 1, 0.1), ("tssa", "tss", 2, 0.2), ("TssAFlnk", "tss", 3, 0.3), ("TssA", "enh", 4, 0.4)]


@query(_values("asked, state, label, ord, value", [("TssA", "tssa", "tss", 2, 0.2), ("tssaflnk", "TssAFlnk", "tss", 3, 0.3), ("12_TssA", "12_TssA", "tss.x", 1, 0.1)]))
def tolerant_lookup(spark, sf):
    table = spark.createDataFrame(_TOL, "state string, label string, ord int, value double")
    parts = [T.tolerant_lookup(table, s, "tss").withColumn("asked", F.lit(s)) for s in ("TssA", "tssaflnk", "12_TssA")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asked", "state", "label", "ord", "value")


@query(V.with_views("evidence", Q._RK, """SELECT method, axis, cell, value, round(CASE WHEN axis = 'tax' THEN CASE WHEN method = 'AF' THEN 0.5 END ELSE score END, 6) AS score FROM sc JOIN evidence USING (method, axis, cell)"""))
def scored_evidence(spark, sf):
    given = F.when((F.col("axis") == "tax") & (F.col("method") == "AF"), 0.5)
    return rounded(S.score_evidence(V.evidence(spark, sf).withColumn("given", given), ["axis", "cell"]).drop("given"))


_AX = [("a", "x", 1, 0.5), ("a", "y", 2, 0.9), ("a", "z", 3, 0.9), ("b", "x", 1, 0.1), ("b", "y", 2, 0.1)]


@query(_values("method, best, worst", [("a", "y", "x"), ("b", "x", "x")]))
def best_and_worst(spark, sf):
    return S.best_and_worst(spark.createDataFrame(_AX, "method string, axis string, ord int, score double"))


@query(_values("state, ord", [("Tss", 1), ("E12", 1000012), ("E2", 1000002), ("other", 1999999)]))
def canonical_order(spark, sf):
    states = spark.createDataFrame([("Tss",), ("E12",), ("E2",), ("other",)], "state string")
    return T.canonical_order(states, spark.createDataFrame([("Tss", 1)], "state string, ord int"))


@query(V.with_views("evidence", Q._RK | {"t": "SELECT method, avg(score) FILTER (axis = 'discount') AS d, avg(score) FILTER (axis = 'tax') AS t, avg(score) FILTER (axis = 'quantity') AS q FROM sc GROUP BY 1"},
    "SELECT CASE WHEN method = 'AF' THEN 'joint_AF' ELSE method END AS method, round(CASE WHEN method <> 'AF' THEN q END, 6) AS quantity, round((d + t) / 2, 6) AS rates FROM t"))
def blanked_axes(spark, sf):
    t = S.axis_table(S.rank_scores(V.evidence(spark, sf), ["axis", "cell"]), list(V.AXES))
    named = S.fold_axes(t, "rates", ["discount", "tax"]).withColumn("method", F.when(F.col("method") == "AF", "joint_AF").otherwise(F.col("method")))
    return rounded(S.blank_joint(named, ["quantity"])).select("method", "quantity", "rates")


@query(V.with_views("evidence", {}, "SELECT method, axis, cell, round(CASE WHEN axis = 'tax' THEN 1 - value ELSE value END, 6) AS value FROM evidence"))
def flipped_axes(spark, sf):
    e = V.evidence(spark, sf)
    S.check_axes(e, list(V.AXES))
    return rounded(S.flip(e, ["tax"]))


@query("""SELECT event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5('42:' || event_id), 1, 15) AS BIGINT), event_id) AS r FROM events) WHERE r <= 20""")
def thinned_points(spark, sf):
    return S.thin(V.table(spark, sf, "events").select(F.col("event_type").alias("state"), "event_id"), ["state"], ["event_id"], 20)


@query(V.with_views("", Q._PT, """SELECT method, threshold, f1, row_number() OVER (PARTITION BY method ORDER BY threshold DESC) AS step,
    CASE WHEN threshold = max(threshold) OVER (PARTITION BY method) THEN 'first' WHEN threshold = min(threshold) OVER (PARTITION BY method) THEN 'last' END AS edge FROM p"""))
def sweep_order(spark, sf):
    return S.sweep_order(Q._points(spark, sf).select("method", "threshold", "f1"), ["method"], -1)


@query(V.with_views("evidence", {}, "SELECT method, axis, cell, value, round(value / max(value) OVER (PARTITION BY axis, cell), 6) AS share FROM evidence"))
def group_share(spark, sf):
    return rounded(S.group_share(V.evidence(spark, sf), ["axis", "cell"], "value", "max"))


# --- drivers ---------------------------------------------------------------------------------------------------------------------


@query(V.with_views("seg ann", Q._enrich_sql(_ONE) | {k: v.replace("FROM seg", "FROM (SELECT * FROM seg WHERE side = 0)") for k, v in Q._TR.items()} | {
    "en": "SELECT from_state AS state, sum(-p * log2(p)) AS e FROM (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr) GROUP BY 1"}, """
    SELECT 'report' AS part, state, '' AS key, CAST(sum("end" - start) AS DOUBLE) AS value FROM s GROUP BY 2 UNION ALL SELECT 'composition', state, '', round(sum("end" - start) / (SELECT sum("end" - start) FROM s), 6) FROM s GROUP BY 2
    UNION ALL SELECT DISTINCT 'entropy', s.state, '', round(coalesce(e, 0.0), 6) FROM s LEFT JOIN en USING (state) UNION ALL SELECT 'transitions', from_state, to_state, CAST(n AS DOUBLE) FROM tr UNION ALL SELECT 'enrichment', state, label, fold FROM out"""))
def evidence_tables(spark, sf):
    got = T.evidence_of(sides(spark, sf)[0], BIN, annotations=V.ann(spark, sf), width=WIDTH)
    cut = {"report": ("state", F.lit(""), "total_bp"), "composition": ("state", F.lit(""), "share"), "entropy": ("state", F.lit(""), "entropy"), "transitions": ("from_state", F.col("to_state"), "n"), "enrichment": ("state", F.col("label"), "fold")}
    parts = [got[k].select(F.lit(k).alias("part"), F.col(s).alias("state"), key.alias("key"), F.col(v).cast("double").alias("value")) for k, (s, key, v) in cut.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query(Q.ORACLE["match_states"])
def match_all_pairs(spark, sf):
    """Each chromosome is a pair of files; their sums are those of the whole."""
    s = V.seg(spark, sf)
    return rounded(M.match_all(s.select(F.col("chrom").alias("pair"), F.when(F.col("side") == 0, "work").otherwise("ref").alias("side"), "chrom", "start", "end", "state"), None, WIDTH))


@query(_values("dataset, path", [("a", "o"), ("b", "b1"), ("c", "s1"), ("d", None)]))
def picked_emissions(spark, sf):
    rows = [("a", "override", "o"), ("a", "binarized", "b0"), ("b", "signal", "s0"), ("b", "binarized", "b1"), ("c", "signal", "s1"), ("d", "none", None)]
    return M.pick_emissions(spark.createDataFrame(rows, "dataset string, kind string, path string"))


@query(V.with_views("seg", Q._CP | Q._CONF | {"ct": "SELECT sum(n) AS t FROM cf", "cm": """SELECT sum(CAST(a.m AS DOUBLE) * b.m) AS mm FROM (SELECT state1 AS s, sum(n) AS m FROM cf GROUP BY 1) a JOIN (SELECT state2 AS s, sum(n) AS m FROM cf GROUP BY 1) b USING (s)""",
    "cs": "SELECT sum(n) FILTER (state1 = state2) AS same FROM cf", "ln": 'SELECT id, state, CAST(sum("end" - start) AS DOUBLE) AS bp FROM sg GROUP BY 1, 2'}, """SELECT 's0' AS a, 's1' AS b, round(t.same / g, 6) AS overlap_fraction,
    round((t.same / t.t - c.mm / (t.t * t.t)) / (1 - c.mm / (t.t * t.t)), 6) AS kappa, round(mj, 6) AS mean_jaccard, CAST(ct.t AS BIGINT) AS n_bins,
    round((cs.same / ct.t - cm.mm / (CAST(ct.t AS DOUBLE) * ct.t)) / (1 - cm.mm / (CAST(ct.t AS DOUBLE) * ct.t)), 6) AS bin_kappa,
    (SELECT round(sum(x.bp * y.bp) / sqrt((SELECT sum(bp * bp) FROM ln WHERE id = 's0') * (SELECT sum(bp * bp) FROM ln WHERE id = 's1')), 6) FROM ln x JOIN ln y USING (state) WHERE x.id = 's0' AND y.id = 's1') AS composition_cosine,
    CAST(1.0 AS DOUBLE) AS emission_cosine FROM t, c, j, ct, cm, cs"""))
def compare_labellings(spark, sf):
    s = V.seg(spark, sf).withColumn("id", F.concat(F.lit("s"), F.col("side").cast("string"))).drop("side")
    e = V.emis(spark, sf)
    both = e.withColumn("id", F.lit("s0")).unionByName(e.withColumn("id", F.lit("s1")))
    bins = spark.createDataFrame([("s0", BIN), ("s1", 2 * BIN)], "id string, bin_size int")
    return rounded(T.compare_labellings(s, spark.createDataFrame([("s0", "s1")], "a string, b string"), bins, both, WIDTH))


_REC = {"em": "SELECT 'd' || d AS dataset, 'm' AS method, 'bin' AS kind, state, mark, abs(value) + d * CAST(substr(mark, 2) AS INTEGER) AS value FROM emis, range(1, 3) r(d)",
    "cs": """SELECT dataset, a.state AS s1, b.state AS s2, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS c FROM em a JOIN em b USING (dataset, mark) WHERE a.state < b.state GROUP BY 1, 2, 3""",
    "gi": """SELECT dataset, state, 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1.0) / count(*) AS g FROM (SELECT *, row_number() OVER (PARTITION BY dataset, state ORDER BY value) AS i FROM em) GROUP BY 1, 2""",
    "re": """SELECT dataset, (SELECT count(DISTINCT state) FROM em) AS n_states, g.gini, avg(c) AS mean, stddev_pop(c) AS std FROM cs JOIN (SELECT dataset, avg(g) AS gini FROM gi GROUP BY 1) g USING (dataset) GROUP BY 1, 3"""}


def _records(spark, sf) -> DataFrame:
    e = V.emis(spark, sf)
    scaled = lambda d: e.select(F.lit(f"d{d}").alias("dataset"), F.lit("m").alias("method"), F.lit("bin").alias("kind"), "state", "mark", (F.abs("value") + d * F.substring("mark", 2, 9).cast("int")).alias("value"))
    return T.emission_records(scaled(1).unionByName(scaled(2)))


@query(V.with_views("emis", _REC, "SELECT dataset, 'm' AS method, 'bin' AS kind, n_states, round(gini, 5) AS gini, round(mean, 5) AS mean, round(std, 5) AS std FROM re"))
def emission_records(spark, sf):
    return rounded(_records(spark, sf), 5)


@query(V.with_views("emis", _REC, "SELECT 'm' AS method, 'bin' AS kind, round(avg(mean), 5) AS mean, round(stddev_samp(mean), 5) AS std, count(*) AS n FROM re"))
def records_by_method(spark, sf):
    return rounded(T.records_by_method(_records(spark, sf)), 5)


_GRID = Q._BINS | {"l2": """SELECT side, chrom, bin, max_by(state, (start, "end", state)) AS state FROM (SELECT *, unnest(range(start // 600, "end" // 600)) AS bin FROM seg WHERE "end" // 600 > start // 600) GROUP BY 1, 2, 3""",
    "g": "SELECT 's' || side AS sample, 300 AS point, chrom, bin, state FROM lab UNION ALL SELECT 's' || side, 600, chrom, bin, state FROM l2",
    "c": """SELECT a.sample AS sample1, a.point AS point1, b.sample AS sample2, b.point AS point2, a.state AS x, b.state AS y, count(*) AS n FROM g a JOIN g b ON a.chrom = b.chrom AND a.bin = b.bin
        AND (a.sample = b.sample AND a.point < b.point OR a.sample < b.sample AND a.point = b.point) GROUP BY ALL""",
    "p": "SELECT *, n / sum(n) OVER k AS p, sum(n) OVER kx / sum(n) OVER k AS p1, sum(n) OVER ky / sum(n) OVER k AS p2 FROM c WINDOW k AS (PARTITION BY sample1, point1, sample2, point2), kx AS (PARTITION BY sample1, point1, sample2, point2, x), ky AS (PARTITION BY sample1, point1, sample2, point2, y)"}


@query(V.with_views("seg", _GRID, "SELECT sample1, point1, sample2, point2, round(2 * sum(p * ln(p / (p1 * p2))) / (-sum(p * ln(p1)) - sum(p * ln(p2))), 6) AS ami FROM p GROUP BY 1, 2, 3, 4"))
def grid_agreement(spark, sf):
    s = V.seg(spark, sf)
    at = lambda b: I.bin_labels(s, b, ["side"]).select(F.concat(F.lit("s"), F.col("side").cast("string")).alias("sample"), F.lit(b).alias("point"), "chrom", "bin", "state")
    return rounded(T.grid_agreement(at(300).unionByName(at(600))))


@query(V.with_views("emis", Q._INT | {"o": "SELECT state, list_sort([s1, s2, s3, s4, s5]) AS l FROM sc"}, "SELECT state, round(l[5] - l[4], 4) AS margin FROM o"))
def interpretation_margin(spark, sf):
    return rounded(P.interpret(P.state_evidence(Q._chrom_emis(spark, sf))).select("state", "margin"), 4)


@query("""WITH r AS (SELECT 'm' || s_nationkey AS method, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT method, CAST(k AS VARCHAR) AS k, 'T' || (s_suppkey % 7) AS value FROM r""")
def type_matrix(spark, sf):
    t = V.table(spark, sf, "supplier").select(F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("method"), F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("state"), F.concat(F.lit("T"), (F.col("s_suppkey") % 7).cast("string")).alias("short"))
    wide = P.type_matrix(t)
    return wide.unpivot(["method"], [c for c in wide.columns if c != "method"], "k", "value").where("value is not null")


@query(V.with_views("ann genes", {}, """SELECT chrom, start, "end", label FROM ann UNION ALL SELECT chrom, start, "end", 'ATAC' FROM ann WHERE label = 'P' AND start % 2 = 0
    UNION ALL SELECT chrom, CASE WHEN strand = '+' THEN start ELSE "end" - 1 END, CASE WHEN strand = '+' THEN start + 1 ELSE "end" END, 'expressed' FROM genes WHERE tpm > 50"""))
def data_set_annotations(spark, sf):
    a = V.ann(spark, sf)
    atac = a.where("label = 'P'").select(F.when(F.col("start") % 2 == 0, "K1").otherwise("K2").alias("dataset"), "chrom", "start", "end")
    top = G.tss(V.genes(spark, sf).where("tpm > 50")).select("chrom", "start", "end", F.lit("expressed").alias("label"))
    return T.data_set_annotations(a, atac, top, "K1")
