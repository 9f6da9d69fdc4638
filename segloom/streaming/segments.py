"""Streams of segments: running state lengths and binned presence as they arrive.

The batch operators have no clock; a stream needs one only to forget. Lengths are sums and need no watermark in update mode; bins are
deduplicated within the watermark of their arrival column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import guarded_sequence, state_lengths


def running_lengths(stream: DataFrame, by: list[str] | None = None) -> DataFrame:
    """bp by state of a stream of segments; write it in update or complete mode."""
    return state_lengths(stream, by)


def streamed_bins(stream: DataFrame, bin_size: int, at: str, delay: str = "1 hour") -> DataFrame:
    """chrom, bin, mark once each, of a stream of peaks with an arrival time ``at``; repeats within the delay are dropped."""
    bins = F.explode(guarded_sequence(F.expr(f"start div {bin_size}"), F.expr(f"(`end` + {bin_size - 1}) div {bin_size} - 1")))
    return stream.withWatermark(at, delay).select("chrom", "mark", at, bins.alias("bin")).dropDuplicatesWithinWatermark(["chrom", "mark", "bin"])
