"""Presence of marks in fixed bins, and patterns of marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import guarded_sequence


def binarize(peaks: DataFrame, sizes: DataFrame, bin_size: int, key: str = "mark", by: list[str] | None = None) -> DataFrame:
    """chrom, bin, mark of every bin that a peak of the mark touches. sizes: chrom, size. Peaks of other chromosomes are left out; a peak
    past the end of its chromosome marks the last bin."""
    n = F.ceil(F.col("size") / bin_size)
    first = F.least(F.greatest(F.expr(f"start div {bin_size}"), F.lit(0)), n - 1)
    last = F.least(F.expr(f"(`end` + {bin_size - 1}) div {bin_size}"), n) - 1
    rows = peaks.join(F.broadcast(sizes), "chrom").where("size > 0").select(*(by or []), "chrom", key, F.explode(guarded_sequence(first, F.greatest(last, first))).alias("bin"))
    return rows.select(*(by or []), "chrom", "bin", key).distinct()


def codes(bits: DataFrame, marks: list[str], key: str = "mark", by: list[str] | None = None) -> DataFrame:
    """chrom, bin, code: bit j is set where the j-th mark is present. A code is a long: more than 63 marks raise."""
    if len(marks) > 63:
        raise ValueError("a code holds 63 marks")
    place = F.array_position(F.array(*map(F.lit, marks)), F.col(key)) - 1
    rows = bits.where(F.col(key).isin(marks)).withColumn("__j", place.cast("int"))
    return rows.groupBy(*(by or []), "chrom", "bin").agg(F.bit_or(F.expr("shiftleft(1L, __j)")).alias("code"))


def bits_of(code: Column, n: int) -> Column:
    """0/1 of each of n marks."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.call_function("shiftright", code, j).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def patterns(coded: DataFrame) -> DataFrame:
    """code, n, n_marks of every distinct pattern."""
    return coded.groupBy("code").agg(F.count("*").alias("n")).withColumn("n_marks", F.bit_count("code").cast("int"))


def coverage_by_depth(coded: DataFrame, n_marks: int) -> DataFrame:
    """depth 1..n_marks, bins with at least so many marks, and that over the bins with one; nothing if no bin has a mark."""
    spark = coded.sparkSession
    counts = coded.where("code <> 0").groupBy(F.bit_count("code").cast("int").alias("depth")).agg(F.count("*").alias("n"))
    rows = spark.range(1, n_marks + 1).select(F.col("id").cast("int").alias("depth")).join(F.broadcast(counts), "depth", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    down = Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)  # n_marks rows
    least = rows.withColumn("bins", F.sum("n").over(down).cast("long"))
    first = F.max("bins").over(Window.partitionBy(F.lit(0)))
    return least.select("depth", "bins", F.round(F.try_divide(F.col("bins"), first), 6).alias("share")).where("share is not null")


def combinations_by_depth(coded: DataFrame, n_marks: int) -> DataFrame:
    """depth, distinct patterns of exactly so many marks, their share of the possible ones, and of all patterns but the empty one."""
    spark = coded.sparkSession
    counts = coded.where("code <> 0").select("code").distinct().groupBy(F.bit_count("code").cast("int").alias("depth")).agg(F.count("*").alias("n"))
    rows = spark.range(1, n_marks + 1).select(F.col("id").cast("int").alias("depth")).join(F.broadcast(counts), "depth", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    possible = F.factorial(F.lit(n_marks)) / (F.factorial("depth") * F.factorial(F.lit(n_marks) - F.col("depth")))
    usage = F.sum("n").over(Window.partitionBy(F.lit(0))) / (F.pow(F.lit(2.0), F.lit(n_marks)) - 1)
    return rows.select("depth", F.col("n").cast("long").alias("n"), F.round(F.col("n") / possible, 6).alias("share"), F.round(usage, 6).alias("usage"))


def joint_bits(cells: DataFrame, sizes: DataFrame, bin_size: int, key: str = "mark", cell: str = "cell") -> DataFrame:
    """Bits of several cells over one space of marks: cell, chrom, bin, mark."""
    return binarize(cells, sizes, bin_size, key, [cell])
