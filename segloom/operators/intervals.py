"""Operators on one table of half-open intervals (chrom, start, end, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a chromosome that one task merges in the first pass.
BLOCK = 1 << 20


def length() -> Column:
    return F.col("end") - F.col("start")


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("__new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    named = starts.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def merge_intervals(rows: DataFrame, by: list[str] | None = None, drop_empty: bool = False, block: int = BLOCK) -> DataFrame:
    """Merge overlapping or touching intervals of each chromosome (and of each value of ``by``).

    Two passes: blocks of a chromosome are merged apart, and only their islands, at least one a block, meet in the pass by
    chromosome; so the work by chromosome does not grow with the depth of the input."""
    keys = [*(by or []), "chrom"]
    rows = rows.where("end > start") if drop_empty else rows
    cut = rows.select(*keys, "start", "end").withColumn("__b", F.floor(F.col("start") / block))
    return _islands(_islands(cut, [*keys, "__b"]).drop("__b"), keys)


def extend(rows: DataFrame, window: int) -> DataFrame:
    """Widen by a window; the start stops at 0, the end is not clipped."""
    return rows.withColumn("start", F.greatest(F.lit(0), F.col("start") - window)).withColumn("end", F.col("end") + window)


def total_bp(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(length()), F.lit(0)).cast("long").alias("bp"))


def state_lengths(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    return segments.groupBy(*(by or []), "state").agg(F.sum(length()).cast("long").alias("bp"))


def segment_stats(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States, segments and the spread of lengths."""
    n = length()
    return segments.groupBy(*(by or [])).agg(
        F.countDistinct("state").alias("n_states"), F.count("*").alias("n_segments"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        F.round(F.avg(n), 6).alias("mean_len"), F.round(F.median(n), 6).alias("median_len"),
    )


def state_report(segments: DataFrame, by: list[str] | None = None, digits: int = 1) -> DataFrame:
    """Count, total, mean and median length of each state."""
    n = length()
    return segments.groupBy(*(by or []), "state").agg(
        F.count("*").alias("n"), F.sum(n).cast("long").alias("total_bp"), F.round(F.avg(n), digits).alias("mean_len"), F.round(F.median(n), digits).alias("median_len")
    )


def composition(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of covered bp of each named state, with mean and median length; states '' and '.' have no name."""
    named = segments.where("state is not null and state not in ('', '.')")
    n = length()
    rows = named.groupBy(*(by or []), "state").agg(F.sum(n).cast("long").alias("bp"), F.round(F.avg(n), 6).alias("mean_len"), F.round(F.median(n), 6).alias("median_len"))
    whole = F.sum("bp").over(Window.partitionBy(*(by or [F.lit(0)])))
    return rows.withColumn("share", F.round(F.try_divide(F.col("bp"), whole), 6)).drop("bp")


def region_stats(regions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number, mean and median length of regions; zeros where there are none."""
    n = length()
    zero = lambda c, a: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(a)
    return regions.groupBy(*(by or [])).agg(F.count("*").alias("n"), zero(F.avg(n), "mean_len"), zero(F.median(n), "median_len"))


def guarded_sequence(first: Column, last: Column) -> Column:
    """first..last, empty (not descending) where last is before first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def bin_labels(segments: DataFrame, bin_size: int, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """chrom, bin, state: bins floor(start/b) to floor(end/b) - 1; the segment that comes last in ``order`` wins a bin.
    Segments without a state are skipped."""
    keys = [*(by or []), "chrom", "bin"]
    rows = segments.where("state is not null").withColumn("__o", F.struct(*(order or ["start", "end", "state"])))
    each = rows.select(*(by or []), "chrom", "state", "__o", F.explode(guarded_sequence(F.expr(f"start div {bin_size}"), F.expr(f"end div {bin_size} - 1"))).alias("bin"))
    return each.groupBy(*keys).agg(F.max_by("state", "__o").alias("state"))


#: Bins of a chromosome that one task follows.
BINS = 1 << 16


def runs(labels: DataFrame, bin_size: int, value: str = "state", by: list[str] | None = None, block: int = BINS) -> DataFrame:
    """Segments of adjacent bins with the same value; a segment's end may pass the chromosome's. Blocks of a chromosome are followed apart, then
    their runs."""
    keys = [*(by or []), "chrom", value]
    at = Window.partitionBy(*keys, "__b").orderBy("bin")
    cut = labels.withColumn("__b", F.floor(F.col("bin") / block))
    first = cut.withColumn("__i", F.col("bin") - F.row_number().over(at)).groupBy(*keys, "__b", "__i").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"))
    return _islands(first.drop("__b", "__i"), keys).withColumn("start", F.col("start") * bin_size).withColumn("end", F.col("end") * bin_size)


def depth_sweep(segments: DataFrame, sample: str, bin_size: int, window: int = 0, block: int = BLOCK) -> DataFrame:
    """state, depth, bins, cum_bins: bins that at most ``depth`` samples label with the state. Pieces between the ends of intervals are
    floor-divided by the bin one by one; with a window every sample's intervals are extended and merged first. A block of a chromosome is
    followed from the depth at which it begins."""
    rows = segments.select(sample, "chrom", "state", "start", "end")
    if window:
        rows = merge_intervals(extend(rows, window), [sample, "state"])
    ends = rows.select("chrom", "state", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    net = ends.select("chrom", "state", "x.*").groupBy("chrom", "state", "pos").agg(F.sum("d").alias("d")).withColumn("__b", F.floor(F.col("pos") / block))
    of_blocks = Window.partitionBy("chrom", "state").orderBy("__b")
    blocks = net.groupBy("chrom", "state", "__b").agg(F.sum("d").alias("__d"), F.min("pos").alias("__p"))
    begin = blocks.select("chrom", "state", "__b", F.coalesce(F.sum("__d").over(of_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"), F.lead("__p").over(of_blocks).alias("__to"))
    at = Window.partitionBy("chrom", "state", "__b").orderBy("pos")
    inside = net.select("chrom", "state", "__b", "pos", F.sum("d").over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("__in"), F.lead("pos").over(at).alias("__next"))
    deep = inside.join(begin, ["chrom", "state", "__b"]).select("state", (F.col("__from") + F.col("__in")).alias("depth"), (F.coalesce("__next", "__to") - F.col("pos")).alias("n"))
    bins = deep.where("depth > 0 and n is not null").groupBy("state", "depth").agg(F.sum(F.expr(f"n div {bin_size}")).cast("long").alias("bins"))
    upto = Window.partitionBy("state").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("cum_bins", F.sum("bins").over(upto).cast("long"))


def transitions(labels: DataFrame, by: list[str] | None = None, block: int = BINS) -> DataFrame:
    """from_state, to_state, n: pairs of bins that adjoin. The last bin of a block of a chromosome is also seen by the next block, as the one
    before its first."""
    keys = [*(by or []), "chrom"]
    own = F.floor(F.col("bin") / block)
    seen = F.when((F.col("bin") + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))
    cut = labels.select(*keys, "bin", "state", F.explode(seen).alias("__b"))
    at = Window.partitionBy(*keys, "__b").orderBy("bin")
    pairs = cut.withColumn("__p", F.lag("state").over(at)).withColumn("__l", F.lag("bin").over(at)).where((F.col("bin") - F.col("__l") == 1) & (own == F.col("__b")))
    return pairs.groupBy(*(by or []), F.col("__p").alias("from_state"), F.col("state").alias("to_state")).agg(F.count("*").alias("n"))


def transition_entropy(counts: DataFrame, lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entropy in bits of each state's successors, and its mean weighted by the states' bp; a state without successors counts 0."""
    keys = by or []
    row = Window.partitionBy(*keys, "from_state")
    p = F.try_divide(F.col("n"), F.sum("n").over(row))
    h = counts.withColumn("__p", p).groupBy(*keys, "from_state").agg(F.sum(-F.col("__p") * F.log2("__p")).alias("entropy")).withColumnRenamed("from_state", "state")
    joined = lengths.join(h, [*keys, "state"], "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    mean = F.try_divide(F.sum(F.col("entropy") * F.col("bp")).over(whole), F.sum("bp").over(whole))
    return joined.select(*keys, "state", F.round("entropy", 6).alias("entropy"), F.round(mean, 6).alias("weighted_entropy"))
