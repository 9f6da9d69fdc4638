"""Enrichment of states in annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import ratio
from .intervals import length, merge_intervals
from .overlap import WIDTH, overlap_pairs


def enrichment(segments: DataFrame, annotations: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per state and annotation label: coverage = shared / state bp, fold = coverage / (annotation bp / segmented bp), jaccard,
    sensitivity = shared / annotation bp, sensitivity_50 = share of the merged loci of which at least half lies in the state, and
    coverage_50 = share of the state's segments of which at least half is annotated. Undefined ratios are 0."""
    return _tables(segments.select("chrom", "start", "end", "state"), annotations, width)


def _tables(segments: DataFrame, annotations: DataFrame, width: int) -> DataFrame:
    loci = merge_intervals(annotations, ["label"])
    pairs = overlap_pairs(segments, loci, width)
    locus = pairs.groupBy("l_state", "r_label", "chrom", "r_start", "r_end").agg(F.sum("bp").alias("bp"))
    hits = locus.groupBy(F.col("l_state").alias("state"), F.col("r_label").alias("label")).agg(
        F.sum("bp").cast("long").alias("shared"), F.count(F.when(2 * F.col("bp") >= F.col("r_end") - F.col("r_start"), 1)).alias("half_loci")
    )
    segment = pairs.groupBy("l_state", "r_label", "chrom", "l_start", "l_end").agg(F.sum("bp").alias("bp"))
    half = segment.groupBy(F.col("l_state").alias("state"), F.col("r_label").alias("label")).agg(
        F.count(F.when(2 * F.col("bp") >= F.col("l_end") - F.col("l_start"), 1)).alias("half_segments")
    )
    states = segments.groupBy("state").agg(F.sum(length()).cast("long").alias("state_bp"), F.count("*").alias("n_segments"))
    labels = loci.groupBy("label").agg(F.sum(length()).cast("long").alias("label_bp"), F.count("*").alias("n_loci"))
    whole = segments.agg(F.sum(length()).cast("double").alias("genome"))
    rows = states.join(F.broadcast(labels), F.lit(True)).join(F.broadcast(whole), F.lit(True)).join(hits, ["state", "label"], "left").join(half, ["state", "label"], "left")
    rows = rows.na.fill(0, ["shared", "half_loci", "half_segments"])
    cover = ratio(F.col("shared"), F.col("state_bp"))
    out = {
        "coverage": cover, "fold": ratio(cover, F.try_divide(F.col("label_bp").cast("double"), F.col("genome"))),
        "jaccard": ratio(F.col("shared"), F.col("state_bp") + F.col("label_bp") - F.col("shared")), "sensitivity": ratio(F.col("shared"), F.col("label_bp")),
        "sensitivity_50": ratio(F.col("half_loci"), F.col("n_loci")), "coverage_50": ratio(F.col("half_segments"), F.col("n_segments")),
    }
    return rows.select("state", "label", *(F.round(v, 6).alias(k) for k, v in out.items()))


def family_enrichment(segments: DataFrame, annotations: DataFrame, families: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same for pools of states named POOL:<family>. families: family, state; a state may be in several. A locus counts by the sum
    of what its family's states share with it; a family without states has no row."""
    pooled = segments.join(F.broadcast(families), "state").select("chrom", "start", "end", F.concat(F.lit("POOL:"), "family").alias("state"))
    rows = _tables(pooled, annotations, width)
    # the genome of a pool is that of all segments, not of the pooled ones
    whole = segments.agg(F.sum(length()).cast("double").alias("genome"))
    size = merge_intervals(annotations, ["label"]).groupBy("label").agg(F.sum(length()).alias("label_bp"))
    fold = ratio(F.col("coverage"), F.try_divide(F.col("label_bp").cast("double"), F.col("genome")))
    return rows.drop("fold").join(F.broadcast(size), "label").join(F.broadcast(whole), F.lit(True)).select(
        "state", "label", "coverage", F.round(fold, 5).alias("fold"), "jaccard", "sensitivity", "sensitivity_50", "coverage_50"
    )


def sweep_point(segments: DataFrame, annotations: DataFrame, states: list[str], genome: int, width: int = WIDTH) -> DataFrame:
    """tpr, fpr, precision and F1 of a family of states against an annotation over ``genome`` bases."""
    called = merge_intervals(segments.where(F.col("state").isin(states)))
    truth = merge_intervals(annotations, drop_empty=True)
    shared = overlap_pairs(called, truth, width).agg(F.coalesce(F.sum("bp"), F.lit(0)).alias("tp"))
    size = lambda d, a: d.agg(F.coalesce(F.sum(length()), F.lit(0)).alias(a))
    row = shared.join(size(called, "called"), F.lit(True)).join(size(truth, "truth"), F.lit(True))
    tp, c, t = F.col("tp"), F.col("called"), F.col("truth")
    tpr, prec = ratio(tp, t), ratio(tp, c)
    return row.select(
        F.round(tpr, 6).alias("tpr"), F.round(ratio(c - tp, F.lit(genome) - t), 6).alias("fpr"), F.round(prec, 6).alias("precision"),
        F.round(ratio(2 * tpr * prec, tpr + prec), 6).alias("f1"),
    )


def recovered(table: DataFrame, sizes: DataFrame, states: list[str], prefix: str, genome: int) -> DataFrame:
    """Sensitivity, precision and F1 of a family from a rounded enrichment table (state, label, coverage, fold) and state sizes (state,
    total_bp): the annotation's size is the median of coverage / fold, times the genome."""
    rows = table.where(F.col("label").startswith(prefix)).join(F.broadcast(sizes), "state")
    size = rows.where("fold > 0").groupBy("label").agg((F.median(F.try_divide(F.col("coverage"), F.col("fold"))) * genome).alias("label_bp"))
    mine = rows.where(F.col("state").isin(states)).groupBy("label").agg(F.sum(F.col("coverage") * F.col("total_bp")).alias("shared"), F.sum("total_bp").alias("bp"))
    both = mine.join(size, "label")
    s, p = F.least(ratio(F.col("shared"), F.col("label_bp")), F.lit(1.0)), ratio(F.col("shared"), F.col("bp"))
    return both.select("label", F.round(s, 6).alias("sensitivity"), F.round(p, 6).alias("precision"), F.round(ratio(2 * s * p, s + p), 6).alias("f1"))


def pooled_from_table(table: DataFrame, sizes: DataFrame, states: list[str], label: str) -> DataFrame:
    """Family values from stored tables: summed sensitivity, coverage weighted by bp, and enrichment by the first state with fold > 0."""
    rows = table.where((F.col("label") == label) & F.col("state").isin(states)).join(F.broadcast(sizes), "state")
    background = F.min_by(F.try_divide(F.col("coverage"), F.col("fold")), F.when(F.col("fold") > 0, F.col("state")))
    cover = F.try_divide(F.sum(F.col("coverage") * F.col("total_bp")), F.sum("total_bp"))
    return rows.agg(F.round(F.sum("sensitivity"), 6).alias("sensitivity"), F.round(cover, 6).alias("coverage"), F.round(F.try_divide(cover, background), 5).alias("fold"))
