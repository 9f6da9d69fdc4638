"""Gene models and expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import extend


def base_id(gene: Column) -> Column:
    """ENSG1.4 -> ENSG1."""
    return F.substring_index(gene, ".", 1)


def top_expressed(tpms: DataFrame, known: DataFrame | None = None, n: int = 12000) -> DataFrame:
    """gene_id, base_id, tpm, ord of the n genes of highest TPM above 0; of equals the one that comes first (ord). known: gene_id of the
    genes that a model has, with or without version."""
    rows = tpms.where("tpm > 0").withColumn("base_id", base_id(F.col("gene_id")))
    if known is not None:
        ids = known.select(F.explode(F.array("gene_id", base_id(F.col("gene_id")))).alias("k")).distinct()
        each = rows.select("*", F.explode(F.array_distinct(F.array("gene_id", "base_id"))).alias("k")).join(ids, "k", "left_semi").drop("k")
        rows = each.dropDuplicates(["gene_id", "ord"])
    return rows.orderBy(F.desc("tpm"), "ord").limit(n).select("gene_id", "base_id", "tpm", "ord")


def lookup_tpm(genes: DataFrame, tpms: DataFrame) -> DataFrame:
    """genes (gene_id, gene_name, ..) with tpm by id, else by name, else by id without version, else 0. A repeated id keeps its last
    row, an id without version the largest."""
    last = tpms.groupBy("gene_id").agg(F.max_by("tpm", "ord").alias("t"))
    best = tpms.groupBy(base_id(F.col("gene_id")).alias("b")).agg(F.max("tpm").alias("t3"))
    one = last.select(F.col("gene_id").alias("i1"), F.col("t").alias("t1"))
    two = last.select(F.col("gene_id").alias("i2"), F.col("t").alias("t2"))
    rows = genes.join(one, F.col("gene_id") == F.col("i1"), "left").join(two, F.col("gene_name") == F.col("i2"), "left")
    rows = rows.join(best, base_id(F.col("gene_id")) == F.col("b"), "left")
    return rows.withColumn("tpm", F.coalesce("t1", "t2", "t3", F.lit(0.0))).drop("i1", "t1", "i2", "t2", "b", "t3")


def tss(genes: DataFrame) -> DataFrame:
    """One-base interval of each gene's start of transcription."""
    at = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    return genes.withColumn("__at", at).withColumn("start", F.col("__at")).withColumn("end", F.col("__at") + 1).drop("__at")


def expression_annotations(genes: DataFrame, top: DataFrame, quiet: float = 0.1, flank: int = 2000) -> DataFrame:
    """label, chrom, start, end: bodies, starts and flanks of expressed (``top``: gene_id) and of quiet genes (tpm at most ``quiet``)."""
    marked = genes.join(top.select("gene_id").distinct().withColumn("top", F.lit(True)), "gene_id", "left")
    kind = F.when(F.col("top"), "expressed").when(F.col("tpm") <= quiet, "quiet")
    rows = marked.withColumn("kind", kind).where("kind is not null").select("kind", "chrom", "start", "end", "strand")
    named = lambda d, what: d.select(F.concat("kind", F.lit(f"_{what}")).alias("label"), "chrom", "start", "end")
    return named(rows, "body").unionByName(named(tss(rows), "tss")).unionByName(named(extend(tss(rows), flank), "flank"))
