"""Readers of interval, matrix, expression and configuration files. Every schema is declared; text is gzip-transparent."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa


def _place() -> Column:
    """Sorts rows by file name, then by place in the file, however a scan packs files and their parts into tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and ord (by file name and line) of text files, plain or gzip; globs expand."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), _place().alias("ord"))


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """n: track and browser lines before the first other line of a file."""
    rows = lines(spark, path).withColumn("__h", _is_header())
    first = rows.agg(F.min(F.when(~F.col("__h"), F.col("ord"))).alias("__first"))
    return rows.join(F.broadcast(first), F.lit(True)).where(F.col("__h") & (F.col("__first").isNull() | (F.col("ord") < F.col("__first")))).agg(F.count("*").alias("n"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def _is_header() -> Column:
    return F.col("value").startswith("track") | F.col("value").startswith("browser")


def _filled(c: Column, default: str) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(default)).otherwise(c)


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end, state, color, ord. Blank, comment and header lines are skipped wherever they stand, lines of under three
    fields dropped; a coordinate that is no number raises."""
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~_is_header()).withColumn("f", F.split("value", "\t"))
    return rows.where(F.size("f") >= 3).select(
        _field(0).alias("chrom"), _field(1).cast("long").alias("start"), _field(2).cast("long").alias("end"),
        F.coalesce(_field(3), F.lit(".")).alias("state"), F.coalesce(_field(8), F.lit("0,0,0")).alias("color"), "ord",
    )


def _tolerant(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = lines(spark, path).where(~_is_header()).withColumn("value", F.regexp_replace("value", "#.*$", "")).where(F.trim("value") != "")
    return rows.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 3)


def _coordinate(i: int) -> Column:
    """A number that is not whole is cut, what is no number is 0."""
    return F.coalesce(F.trim(_field(i)).try_cast("double").try_cast("long"), F.lit(0))


def _known(i: int) -> Column:
    return F.coalesce(F.trim(_field(i)), F.lit("")) != ""


def read_segmentation(spark: SparkSession, path: str | list[str], color: str = "0,0,0", sample: str | None = None) -> DataFrame:
    """chrom, start, end, state, color, length, ord and, if given, sample. Comments may begin within a line; missing coordinates drop a
    row, a missing chromosome is chrUnk, a missing name is '.', a missing colour the default."""
    rows = _tolerant(spark, path).where(_known(1) & _known(2))
    out = rows.select(
        _filled(_field(0), "chrUnk").alias("chrom"), _coordinate(1).alias("start"), _coordinate(2).alias("end"), _filled(_field(3), ".").alias("state"), _filled(_field(8), color).alias("color"), "ord"
    ).withColumn("length", F.col("end") - F.col("start"))
    return out.withColumn("sample", F.lit(sample)) if sample is not None else out


def read_segment_frame(spark: SparkSession, path: str | list[str], sample: str | None = None) -> DataFrame:
    """The same for frames: rows without a state are dropped, the default colour is 128,128,128."""
    return read_segmentation(spark, path, "128,128,128", sample).where("state <> '.'")


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end; malformed rows are skipped, and a truncated gzip file gives what can be read of it."""
    text = spark.read.option("ignoreCorruptFiles", "true").text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~_is_header())
    rows = text.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 3)
    out = rows.select(_field(0).alias("chrom"), F.trim(_field(1)).try_cast("long").alias("start"), F.trim(_field(2)).try_cast("long").alias("end"))
    return out.where("start is not null and end is not null")


def on_chromosome(rows: DataFrame, chrom: str) -> DataFrame:
    return rows.where(F.col("chrom") == chrom)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, part, value) with their number in the part and, in a file's first part, its first two lines. A task reads the lines of a
    part one after another."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    now, n, head = None, 0, [None, None]
    for b in batches:
        files, parts, values = b.columns
        start = 0
        while start < b.num_rows:
            key = (files[start].as_py(), parts[start].as_py())
            same = pc.and_(pc.equal(files, key[0]), pc.equal(parts, key[1])).to_numpy(zero_copy_only=False)[start:]
            size = len(same) if same.all() else int(same.argmin())
            if key != now:
                now, n, head = key, 0, [None, None]
            if key[1] == 0:
                for k in range(n, min(n + size, 2)):
                    head[k] = values[start + k - n].as_py()
            whole = b.slice(start, size)
            yield pa.RecordBatch.from_arrays(
                [*whole.columns, pa.array(np.arange(n, n + size)), *(pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int64))) for x in head)],
                ["file", "part", "value", "line", "head", "marks"],
            )
            start, n = start + size, n + size


def read_binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """cell, chrom, bin, mark, v of binary matrices: a line 'cell<TAB>chrom', a line of marks, then one line a bin. A file is one
    chromosome; a task follows a gzip file, or a part of a plain one, line by line. An empty file has no rows, a blank line no values."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.rtrim("value", F.lit("\r")).alias("value"))
    rows = text.mapInArrow(_numbered, "file string, part long, value string, line long, head string, marks string")
    # lines before each further part of a plain file, and the file's first two lines; gzip files have no further parts
    plain = ~F.col("file").endswith(".gz")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = text.where(plain).groupBy("file", "part").agg(F.count("*").alias("n")).select("file", "part", before.alias("before")).where("part > 0")
    first = rows.where(plain & (F.col("line") == 1) & (F.col("part") == 0)).select("file", F.col("head").alias("__head"), F.col("marks").alias("__marks"))
    named = rows.join(F.broadcast(parts.join(first, "file")), ["file", "part"], "left").select(
        F.split(F.coalesce("head", "__head"), "\t").alias("h"), F.split(F.coalesce("marks", "__marks"), "\t").alias("marks"), "value",
        (F.when(F.col("part") == 0, F.lit(0)).otherwise(F.coalesce("before", F.raise_error(F.lit("the first lines of a part are unknown")).cast("long"))) + F.col("line") - 2).alias("bin"),
    ).where("bin >= 0 and trim(value) <> ''")
    each = named.select(F.get("h", F.lit(0)).alias("cell"), F.coalesce(F.get("h", F.lit(1)), F.lit("chrUnknown")).alias("chrom"), "bin", F.explode(F.arrays_zip("marks", F.split("value", "\t").alias("v"))).alias("x"))
    return each.select("cell", "chrom", "bin", F.col("x.marks").alias("mark"), F.col("x.v").cast("tinyint").alias("v"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size, ord: comments and names with '_' skipped, the size being the first run of digits of its field."""
    rows = lines(spark, path).withColumn("value", F.trim("value")).where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("f", F.split("value", r"\s+"))
    got = rows.where((F.size("f") >= 2) & ~_field(0).contains("_")).select(_field(0).alias("chrom"), F.regexp_extract(_field(1), r"(\d+)", 1).try_cast("long").alias("size"), "ord")
    known = got.where("size is not null")
    return known.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")))


#: Chromosomes where no size table is at hand.
CANONICAL = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]


def chrom_names(spark: SparkSession, path: str | None) -> list[str]:
    """Names of a size table in its order, else the canonical ones."""
    if path is None:
        return CANONICAL
    return [r.chrom for r in read_chrom_sizes(spark, path).orderBy("ord").collect()] or CANONICAL


def read_tpms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """gene_id, tpm, ord of a quantification table with a header; rows whose TPM is no number are skipped, and a repeated gene keeps
    its last row."""
    raw = spark.read.csv(path, sep="\t", header=True).select("gene_id", F.col("TPM").try_cast("double").alias("tpm"), _place().alias("ord"))
    last = raw.where("tpm is not null and gene_id is not null and not isnan(tpm)").groupBy("gene_id").agg(F.max(F.struct("ord", "tpm")).alias("x"))
    return last.select("gene_id", "x.tpm", "x.ord")


def read_genes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end (half-open from 0), strand, gene_id, gene_name of the gene features of a GTF."""
    rows = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where((F.size("f") >= 9) & (_field(2) == "gene"))
    attr = lambda k: F.regexp_extract(_field(8), rf'{k} "?([^";]+)', 1)
    return rows.select(
        _field(0).alias("chrom"), (_field(3).cast("long") - 1).alias("start"), _field(4).cast("long").alias("end"), _field(6).alias("strand"),
        attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"), "ord",
    ).where("gene_id <> ''")


def gene_ids(genes: DataFrame) -> DataFrame:
    """gene_id: ids and names of a gene model, with and without version."""
    base = lambda c: F.substring_index(c, ".", 1)
    return genes.select(F.explode(F.array("gene_id", base("gene_id"), "gene_name", base("gene_name"))).alias("gene_id")).where("gene_id <> ''").distinct()


def read_matrix(spark: SparkSession, path: str, rows: str = "state", columns: str = "mark") -> DataFrame | None:
    """rows, columns, value of a table of numbers whose first column names the rows; None if it cannot be read or is empty."""
    try:
        raw = spark.read.csv(path, sep="\t", header=True)
        if len(raw.columns) < 2 or raw.isEmpty():
            return None
    except Exception as error:  # a missing table is no table
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return None
        raise
    named = raw.toDF("__row", *(c.strip() for c in raw.columns[1:]))
    long = named.unpivot(["__row"], named.columns[1:], columns, "value")
    return long.select(F.trim("__row").alias(rows), columns, F.col("value").try_cast("double").alias("value"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; a missing file is an empty table."""
    names = [x.split()[0] for x in schema.split(",")]
    try:
        raw = spark.read.csv(path, sep="\t", header=True)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
    kinds = dict(x.split() for x in schema.split(","))
    return raw.select(*((F.col(n).try_cast(kinds[n]) if n in raw.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names))


def read_comparisons(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comparison table, pooled rows only: an absent replicate column counts as empty."""
    rows = read_table(spark, path, schema + ",replicate string")
    return rows.where(F.coalesce("replicate", F.lit("")) == "").drop("replicate")


def read_bedgraph(spark: SparkSession, path: str | list[str], mark: str) -> DataFrame:
    """chrom, start, end, mark, value: a signal track exported as bedGraph."""
    rows = lines(spark, path).where(~F.col("value").startswith("#") & ~_is_header()).withColumn("f", F.split("value", r"\s+")).where(F.size("f") >= 4)
    return rows.select(_field(0).alias("chrom"), _field(1).cast("long").alias("start"), _field(2).cast("long").alias("end"), F.lit(mark).alias("mark"), _field(3).cast("double").alias("value"))


def read_emissions_npz(spark: SparkSession, path: str) -> DataFrame:
    """state, mark, value of a small archive of states, marks and a matrix; read on the driver."""
    import numpy as np

    from pyarrow.fs import FileSystem

    fs, local = FileSystem.from_uri(path)
    with fs.open_input_file(local) as file, np.load(file, allow_pickle=False) as z:
        states, marks, mat = (z[k] for k in ("states", "marks", "mat" if "mat" in z else "matrix"))
    rows = [(str(s), str(m), float(mat[i, j])) for i, s in enumerate(states) for j, m in enumerate(marks)]
    return spark.createDataFrame(rows, "state string, mark string, value double")


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """type, short, description of a types table: ';'-separated, quoted text over lines, comments, white space collapsed."""
    rows = spark.read.csv(path, sep=";", header=True, multiLine=True, comment="#", quote='"')
    plain = rows.toDF(*(c.strip().lstrip("﻿") for c in rows.columns))
    return plain.select(F.trim(plain.columns[0]).alias("type"), F.trim(plain.columns[1]).alias("short"), F.trim(F.regexp_replace(plain.columns[2], r"\s+", " ")).alias("description"))


def read_config(path: str) -> dict:
    """Configuration of data sets, YAML or JSON; small, on the driver."""
    with open(path, encoding="utf-8") as text:
        raw = text.read()
    try:
        import yaml
    except ImportError:
        return json.loads(raw)
    return yaml.safe_load(raw)


def datasets(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Tables of a configuration: data sets (dataset, cell, reference, rnaseq, atac, replicates, outlier) and their files (dataset,
    accession, mark, rep, control)."""
    bad = set(config.get("outliers") or [])
    sets, files = [], []
    for name, d in (config.get("datasets") or {}).items():
        sets.append((name, d.get("cell"), d.get("ref_chromhmm"), d.get("rnaseq"), d.get("atac"), bool(d.get("replicates", False)), name in bad))
        for acc, f in (d.get("bams") or {}).items():
            f = f if isinstance(f, dict) else {"mark": f}
            files.append((name, acc, f.get("mark"), None if f.get("rep") is None else str(f["rep"]), f.get("control")))
    return (
        spark.createDataFrame(sets, "dataset string, cell string, reference string, rnaseq string, atac string, replicates boolean, outlier boolean"),
        spark.createDataFrame(files, "dataset string, accession string, mark string, rep string, control string"),
    )


def accessions(files: DataFrame, dataset: str, mark: str | None = None, rep: str | None = None) -> DataFrame:
    """Accessions of a data set by mark and replicate; if none is tagged with the replicate, those without tag serve."""
    rows = files.where((F.col("dataset") == dataset) & (F.lit(mark is None) | (F.col("mark") == mark)))
    if rep is None:
        return rows.select("accession").distinct()
    tagged = rows.withColumn("__any", F.max((F.col("rep") == rep).cast("int")).over(Window.partitionBy("dataset")))
    return tagged.where((F.col("rep") == rep) | ((F.coalesce("__any", F.lit(0)) == 0) & F.col("rep").isNull())).select("accession").distinct()


def controls(files: DataFrame, dataset: str) -> DataFrame:
    """Distinct control accessions of a data set."""
    return files.where((F.col("dataset") == dataset) & F.col("control").isNotNull()).select("control").distinct()
