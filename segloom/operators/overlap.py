"""Joins of intervals by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import length, merge_intervals

#: Bases of a join bucket.
WIDTH = 1 << 14


def bucket_width(rows: DataFrame, least: int = 256) -> int:
    """A width that the longest twentieth of the intervals spans few of: a power of two at 64 median lengths, at least
    the 95th percentile."""
    got = rows.select(F.percentile_approx(length(), [0.5, 0.95], 1000).alias("q")).first()
    if not got or got.q is None:
        return WIDTH
    return 1 << max(int(max(64 * got.q[0], got.q[1], least)) - 1, 1).bit_length()


def overlap_pairs(left: DataFrame, right: DataFrame, width: int = WIDTH, on: list[str] | None = None) -> DataFrame:
    """Rows of both sides whose intervals share at least one base, columns named l_* and r_*, with ``bp`` shared. on: further columns
    that must be equal and keep their name.

    Both sides are dealt to the buckets of a chromosome that they touch and joined on (chrom, bucket); the bucket in which the
    shared part begins owns a pair, so each is made once, without a distinct. A chromosome is as many keys as it has buckets."""

    keys = [*(on or []), "chrom"]

    def dealt(rows: DataFrame, p: str) -> DataFrame:
        named = rows.where("end > start").select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in keys), *keys)
        return named.withColumn("bucket", F.explode(F.sequence(F.expr(f"{p}_start div {width}"), F.expr(f"({p}_end - 1) div {width}"))))

    first = F.greatest("l_start", "r_start")
    joined = dealt(left, "l").join(dealt(right, "r"), [*keys, "bucket"]).where("l_start < r_end and r_start < l_end")
    return joined.where(F.floor(first / width) == F.col("bucket")).withColumn("bp", F.least("l_end", "r_end") - first).drop("bucket")


def overlap_table(left: DataFrame, right: DataFrame, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """state1, state2, bp over two labellings; keys in ``by`` are columns of ``left`` that the result keeps."""
    pairs = overlap_pairs(left, right, width)
    keys = [F.col(f"l_{k}").alias(k) for k in by or []]
    return pairs.groupBy(*keys, F.col("l_state").alias("state1"), F.col("r_state").alias("state2")).agg(F.sum("bp").cast("long").alias("bp"))


def shared_bp(left: DataFrame, right: DataFrame, width: int = WIDTH) -> Column:
    return overlap_pairs(merge_intervals(left), merge_intervals(right), width).agg(F.coalesce(F.sum("bp"), F.lit(0)).cast("long").alias("bp"))


def region_jaccard(regions: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Jaccard of all pairs of region sets, key1 < key2: shared bp of the merged sets over the sum of unmerged lengths less it."""
    merged = merge_intervals(regions, [key])
    pairs = overlap_pairs(merged, merged, width).where(f"l_{key} < r_{key}")
    shared = pairs.groupBy(F.col(f"l_{key}").alias("key1"), F.col(f"r_{key}").alias("key2")).agg(F.sum("bp").cast("long").alias("shared"))
    sizes = regions.groupBy(key).agg(F.sum(length()).cast("long").alias("bp"))
    one, two = sizes.select(F.col(key).alias("key1"), F.col("bp").alias("bp1")), sizes.select(F.col(key).alias("key2"), F.col("bp").alias("bp2"))
    grid = one.join(two, F.col("key1") < F.col("key2")).join(shared, ["key1", "key2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("bp1") + F.col("bp2") - F.col("shared")
    return grid.select("key1", "key2", "shared", F.round(F.coalesce(F.try_divide(F.col("shared"), union), F.lit(0.0)), 6).alias("jaccard"))


def overlaps_within(regions: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """key1, key2, n, bp over all pairs of regions that overlap, both orders and each with itself. Equal regions are counted first, each pair of
    different ones is made once, and the width of the join's buckets is measured."""
    each = regions.where("end > start").groupBy(key, "chrom", "start", "end").agg(F.count("*").alias("c"))
    pairs = overlap_pairs(each, each, width or bucket_width(regions))
    order = lambda p: F.struct(f"{p}_start", f"{p}_end", f"{p}_{key}")
    once = pairs.where(order("l") < order("r")).withColumn("n", F.col("l_c") * F.col("r_c"))
    other = once.select(F.explode(F.array(F.struct(F.col(f"l_{key}").alias("key1"), F.col(f"r_{key}").alias("key2")), F.struct(F.col(f"r_{key}").alias("key1"), F.col(f"l_{key}").alias("key2")))).alias("k"), "n", F.col("bp").alias("one"))
    own = each.select(F.struct(F.col(key).alias("key1"), F.col(key).alias("key2")).alias("k"), (F.col("c") * F.col("c")).alias("n"), length().alias("one"))
    return other.unionByName(own).groupBy("k.key1", "k.key2").agg(F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("one")).cast("long").alias("bp"))
