"""State by mark tables (state, mark, value) and similarities of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agreement import ratio
from .intervals import guarded_sequence
from .overlap import WIDTH, overlap_pairs


def bin_emissions(segments: DataFrame, bits: DataFrame, bin_size: int, bins: DataFrame | None = None) -> DataFrame:
    """state, mark, value: share of a state's bins that hold the mark. A segment covers bins floor(start/b) to ceil(end/b) - 1, of
    those that exist (``bins``: chrom, n_bins) where it is given."""
    rows = segments
    last = F.expr(f"(`end` + {bin_size - 1}) div {bin_size}")
    if bins is not None:
        rows, last = rows.join(F.broadcast(bins), "chrom"), F.least(last, F.col("n_bins"))
    each = rows.select("chrom", "state", F.explode(guarded_sequence(F.expr(f"start div {bin_size}"), last - 1)).alias("bin"))
    total = each.groupBy("state").agg(F.count("*").alias("bins"))
    held = each.groupBy("chrom", "bin", "state").agg(F.count("*").alias("k")).join(bits.select("chrom", "bin", "mark").distinct(), ["chrom", "bin"])
    ones = held.groupBy("state", "mark").agg(F.sum("k").alias("ones"))
    full = total.join(F.broadcast(bits.select("mark").distinct()), F.lit(True)).join(ones, ["state", "mark"], "left")
    return full.select("state", "mark", ratio(F.coalesce("ones", F.lit(0)), F.col("bins")).alias("value"))


def signal_emissions(segments: DataFrame, signal: DataFrame, bin_size: int, compat: bool = True, width: int = WIDTH) -> DataFrame:
    """state, mark, value: mean signal of a state. signal: chrom, start, end, mark, value. Segments shorter than a bin are skipped.
    compat: a segment's mean weighs its length, and the denominator is the whole bins of every segment of the state, with signal or
    without; else it is the length of those with signal."""
    rows = segments.where(F.col("end") - F.col("start") >= bin_size)
    pairs = overlap_pairs(rows.select("chrom", "start", "end", "state"), signal, width)
    per = pairs.groupBy("chrom", "l_start", "l_end", F.col("l_state").alias("state"), F.col("r_mark").alias("mark")).agg(
        (F.sum(F.col("r_value") * F.col("bp")) / F.sum("bp")).alias("mean")
    )
    n = F.col("l_end") - F.col("l_start")
    top = per.groupBy("state", "mark").agg(F.sum(F.col("mean") * n).alias("num"), F.sum(n).alias("own"))
    whole = rows.groupBy("state").agg(F.sum(F.floor((F.col("end") - F.col("start")) / bin_size) * bin_size).alias("all"))
    return top.join(whole, "state").select("state", "mark", ratio(F.col("num"), F.col("all") if compat else F.col("own")).alias("value"))


def vectors(table: DataFrame) -> DataFrame:
    """state, vec: values in the order of the marks' names."""
    got = table.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("mark", "value"))).alias("v"))
    return got.select("state", F.col("v.value").alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def cosine_matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """state1, state2, cosine over the vectors (state, vec) of two tables."""
    one, two = left.toDF("state1", "v1"), right.toDF("state2", "v2")
    return one.join(F.broadcast(two), F.lit(True)).select("state1", "state2", cosine(F.col("v1"), F.col("v2")).alias("cosine"))


def augmented(vecs: DataFrame) -> DataFrame:
    """Vectors with 1 - max appended as a background mark; left alone if any value of the table is outside [0, 1] or none exists."""
    whole = Window.partitionBy(F.lit(0))
    low, high = F.min(F.array_min("vec")).over(whole), F.max(F.array_max("vec")).over(whole)
    fits = (low >= 0) & (high <= 1) & (F.size("vec") > 0)
    return vecs.select("state", F.when(fits, F.concat("vec", F.array(1 - F.array_max("vec")))).otherwise(F.col("vec")).alias("vec"))


def scaled(table: DataFrame) -> DataFrame:
    """Signal values by mark: log1p(max(x, 0)) less its median over the states, over (max - median), held to [0, 1]; flat marks are 0."""
    x = table.withColumn("x", F.log1p(F.greatest(F.col("value"), F.lit(0.0))))
    mark = Window.partitionBy("mark")
    mid, top = F.median("x").over(mark), F.max("x").over(mark)
    value = F.coalesce(F.try_divide(F.col("x") - mid, top - mid), F.lit(0.0))
    return x.select("state", "mark", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("value"))


def base_mark(mark: Column) -> Column:
    """H3K4me3_100 -> H3K4ME3."""
    return F.upper(F.substring_index(mark, "_", 1))


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables over the marks they share by base name; of several marks with one base name the last by name stands."""
    based = lambda d: d.groupBy("state", base_mark(F.col("mark")).alias("base")).agg(F.max_by("value", "mark").alias("value")).withColumnRenamed("base", "mark")
    one, two = based(left), based(right)
    return one.join(F.broadcast(two.select("mark").distinct()), "mark", "left_semi"), two.join(F.broadcast(one.select("mark").distinct()), "mark", "left_semi")


def is_binary(table: DataFrame) -> bool:
    """Whether the values look like shares of bins."""
    row = table.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    return row.lo is not None and row.lo >= -0.01 and row.hi <= 1.01


def similarity(left: DataFrame, right: DataFrame, binary: tuple[bool, bool] | None = None) -> DataFrame:
    """state1, state2, cosine of the scaled and background-augmented vectors of two emission tables."""
    one, two = aligned(left, right)
    kinds = binary or (is_binary(one), is_binary(two))
    ready = [augmented(vectors(t if b else scaled(t))) for t, b in zip((one, two), kinds, strict=True)]
    return cosine_matrix(*ready)


def similarity_for(left: DataFrame, right: DataFrame, states1: DataFrame, states2: DataFrame, binary: tuple[bool, bool] | None = None) -> DataFrame:
    """Similarity on the full grid of two state lists (state); a pair that is not known gets the mean of the known ones."""
    known = similarity(left, right, binary)
    grid = states1.toDF("state1").join(F.broadcast(states2.toDF("state2")), F.lit(True)).join(known, ["state1", "state2"], "left")
    return grid.select("state1", "state2", F.coalesce("cosine", F.avg("cosine").over(Window.partitionBy(F.lit(0)))).alias("cosine"))


def pairwise_cosine(vecs: DataFrame) -> DataFrame:
    """Mean and population deviation of the cosines of all pairs of rows; null under two."""
    pairs = cosine_matrix(vecs, vecs).where("state1 < state2")
    return pairs.agg(F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"), F.count("*").alias("n"))


def gini(vec: Column) -> Column:
    """Gini index of absolute values; null where they sum to 0."""
    s = F.array_sort(F.transform(vec, F.abs))
    n, total = F.size(vec), F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.zip_with(s, F.sequence(F.lit(1), n), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(2 * weighted, n * total) - (n + 1) / n


def minmax(table: DataFrame, by: str = "mark") -> DataFrame:
    """Values scaled to [0, 1] within each column; a constant column of n values becomes 1/n."""
    col = Window.partitionBy(by)
    low, high = F.min("value").over(col), F.max("value").over(col)
    value = F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(1.0) / F.count("*").over(col))
    return table.withColumn("value", value)


def same_state_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean cosine of equally named states over the marks that two tables share."""
    one, two = left.withColumnRenamed("value", "x"), right.withColumnRenamed("value", "y")
    both = one.join(two, ["state", "mark"]).groupBy("state")
    each = both.agg(ratio(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))
    return each.agg(F.avg("cosine").alias("cosine"), F.count("*").alias("n_states"))
