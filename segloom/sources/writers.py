"""Writers: text forms of the engine's tables, and a manifest for results that need not be computed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import natural_key, natural_order
from ..operators.intervals import BINS, guarded_sequence


def write_bed(rows: DataFrame, path: str, order: DataFrame | None = None) -> None:
    """Nine-column BED in the order of chromosomes (chrom, ord; else natural) and positions, range-partitioned."""
    if order is not None:
        rows = rows.join(F.broadcast(order.select("chrom", F.col("ord").alias("__o"))), "chrom", "left")
    else:
        rows = rows.withColumn("__o", natural_order(F.col("chrom")))
    color = F.col("color") if "color" in rows.columns else F.lit("0,0,0")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "state", F.lit("0"), F.lit("."), F.col("start").cast("string"), F.col("end").cast("string"), color)
    rows.orderBy("__o", "start", "end").select(line.alias("value")).write.mode("overwrite").text(path)


def write_binary(bits: DataFrame, bins: DataFrame, marks: list[str], cell: str, path: str) -> None:
    """Gzipped binary matrices, a folder a chromosome, with their two header lines. bits: chrom, bin, mark; bins: chrom, n_bins."""
    ones = bits.groupBy("chrom", "bin").agg(F.collect_set("mark").alias("m"))
    n = F.col("n_bins").cast("long")
    blocks = bins.select("chrom", n.alias("n_bins"), F.explode(guarded_sequence(F.lit(0).cast("long"), F.expr(f"(cast(n_bins as long) - 1) div {BINS}"))).alias("b")).where("n_bins > 0").repartition("chrom", "b")
    grid = blocks.select("chrom", F.explode(guarded_sequence(F.col("b") * BINS, F.least((F.col("b") + 1) * BINS, n) - 1)).alias("bin")).join(ones, ["chrom", "bin"], "left")
    has = [F.when(F.array_contains("m", m), "1").otherwise("0") for m in marks]
    body = grid.select("chrom", (F.col("bin") + 2).alias("ord"), F.concat_ws("\t", *has).alias("value"))
    head = bins.select("chrom", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.concat_ws("\t", F.lit(cell), "chrom").alias("value")), F.struct(F.lit(1).cast("long").alias("ord"), F.lit("\t".join(marks)).alias("value")))).alias("x")).select("chrom", "x.*")
    full = head.unionByName(body).repartition("chrom").sortWithinPartitions("chrom", "ord")
    full.select("chrom", "value").write.mode("overwrite").partitionBy("chrom").option("compression", "gzip").text(path)


def write_mark_beds(runs: DataFrame, path: str) -> None:
    """BED of merged runs, a folder a mark."""
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    ordered = runs.repartition("mark").sortWithinPartitions("mark", "chrom", "start")
    ordered.select("mark", line.alias("value")).write.mode("overwrite").partitionBy("mark").text(path)


def write_table(rows: DataFrame, path: str, digits: int | None = None, order: list | None = None) -> None:
    """Tab-separated table with a header, doubles with so many decimals; report tables are small and go to one file."""
    if digits is not None:
        rows = rows.select(*(F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def wide(rows: DataFrame, row: str, column: str, value: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Matrix of a long table, its columns named by the caller."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(F.format_string(f"%.{digits}f", value)))


def write_matching(mapping: DataFrame, grid: DataFrame, ref_states: list[str], path: str) -> None:
    """Mapping with '(unassigned)' for surplus states, and the jaccard, emission and quality matrices of the grid (state1, state2, ..)."""
    write_table(mapping.withColumn("ref_state", F.coalesce("ref_state", F.lit("(unassigned)"))), f"{path}/mapping", 4, ["work_state"])
    for name in ("jaccard", "emission", "quality"):
        if name in grid.columns:
            write_table(wide(grid, "state1", "state2", name, ref_states), f"{path}/{name}", order=["state1"])


def write_enrichment(table: DataFrame, path: str, labels: list[str]) -> None:
    """The whole table at 4 decimals and a matrix a measure at 6."""
    write_table(table, f"{path}/enrichment", 4, ["state", "label"])
    for name in ("coverage", "fold", "jaccard", "sensitivity", "sensitivity_50", "coverage_50"):
        write_table(wide(table, "state", "label", name, labels, 6), f"{path}/{name}", order=["state"])


def write_emissions_npz(table: DataFrame, path: str) -> None:
    """Archive of states, marks and the matrix of an emission table (state, mark, value): a few thousand numbers, on the driver."""
    import io

    import numpy as np
    from pyarrow.fs import FileSystem

    rows = table.orderBy("state", "mark").collect()
    states, marks = sorted({r.state for r in rows}, key=natural_key), sorted({r.mark for r in rows}, key=natural_key)
    mat = np.zeros((len(states), len(marks)))
    for r in rows:
        mat[states.index(r.state), marks.index(r.mark)] = r.value
    data = io.BytesIO()
    np.savez(data, states=np.array(states), marks=np.array(marks), mat=mat)
    fs, local = FileSystem.from_uri(path)
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(local, compression=None) as out:
        out.write(data.getvalue())


def write_transitions(counts: DataFrame, entropy: DataFrame, states: list[str], path: str) -> None:
    """Entropy by state, and the matrix of shares of each state's successors (from_state, to_state, n), 0 where there are none."""
    write_table(entropy, f"{path}/entropy", 6, ["state"])
    total = counts.groupBy("from_state").agg(F.sum("n").alias("__t"))
    share = counts.join(total, "from_state").select("from_state", "to_state", F.try_divide(F.col("n"), F.col("__t")).alias("p"))
    write_table(wide(share, "from_state", "to_state", "p", states, 6).na.fill("0.000000"), f"{path}/transitions", order=["from_state"])


def write_metrics(matrix: DataFrame, labels: list[str], path: str) -> None:
    """A symmetric matrix (a, b, value) in the order of the labels; pairs that were not compared are 0 in it."""
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("a"))
    write_table(wide(matrix, "a", "b", "value", labels, 6).withColumn("__o", order).orderBy("__o").drop("__o"), path)


def write_inter_dataset(rows: DataFrame, path: str) -> None:
    """Table of pairs across data sets by method and both data sets."""
    write_table(rows, path, 6, ["method", "dataset_a", "dataset_b"])


def write_pair_report(overlap: DataFrame, mapping: DataFrame, work: DataFrame, grid: DataFrame, ref_states: list[str], path: str) -> None:
    """Matrix of the grid's Jaccard, and the similarity: matched bp over the bp of the work labelling."""
    write_table(wide(grid, "state1", "state2", "jaccard", ref_states), f"{path}/jaccard", order=["state1"])
    write_table(similarity(overlap, mapping, work), f"{path}/similarity", 6)


def similarity(overlap: DataFrame, mapping: DataFrame, work: DataFrame) -> DataFrame:
    """similarity: bp that lie under the state they are mapped to (work_state, ref_state), over all bp of the work labelling (state, bp)."""
    hit = overlap.join(F.broadcast(mapping.select(F.col("work_state").alias("state1"), F.col("ref_state").alias("state2"))), ["state1", "state2"]).agg(F.coalesce(F.sum("bp"), F.lit(0)).alias("hit"))
    whole = work.agg(F.sum("bp").alias("whole"))
    return hit.join(whole, F.lit(True)).select(F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("whole")), F.lit(0.0)).alias("similarity"))


def cell_mark_table(files: DataFrame) -> DataFrame:
    """cell, mark, file, control of each signal file (dataset, accession, mark, control), as the learner's table names them."""
    named = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c), F.lit(".bam")))
    return files.where("mark is not null").select(F.col("dataset").alias("cell"), "mark", named("accession").alias("file"), F.coalesce(named("control"), F.lit("")).alias("control"))


def joint_input(one: DataFrame, two: DataFrame) -> DataFrame:
    """Binarizations (cell, chrom, bin, mark, v) of two replicates over their common marks and chromosomes; an error if none is
    common."""
    both = one.unionByName(two.select(*one.columns))
    marks = one.select("mark").distinct().intersect(two.select("mark").distinct())
    chroms = one.select("chrom").distinct().intersect(two.select("chrom").distinct())
    out = both.join(F.broadcast(marks), "mark", "left_semi").join(F.broadcast(chroms), "chrom", "left_semi")
    if out.isEmpty():
        raise ValueError("the replicates have no mark and chromosome in common")
    return out


def sweep_input(tables: dict[str, DataFrame]) -> DataFrame:
    """Binarizations of a sweep, each labelled by its threshold."""
    parts = [d.withColumn("label", F.lit(k)) for k, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- results kept with a signature -------------------------------------------------------------------------------------------


def signature(spark: SparkSession, paths: list[str], version: str) -> str:
    """Digest of the modification time and size of every input, and a version."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        for s in where.getFileSystem(conf).globStatus(where) or []:
            found.append([s.getPath().toString(), s.getModificationTime(), s.getLen()])
    return hashlib.sha256(json.dumps([sorted(found), version]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def kept(spark: SparkSession, path: str, stamp: str, compute: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """A table computed once: read again while its recorded stamp is the same, its files are there and ``valid`` holds."""
    mark = f"{path}/stamp"
    if _exists(spark, f"{path}/table/_SUCCESS") and _exists(spark, f"{mark}/_SUCCESS") and spark.read.text(mark).first().value == stamp:
        table = spark.read.parquet(f"{path}/table")
        if valid is None or valid(table):
            return table
    compute().write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(f"{path}/table")
