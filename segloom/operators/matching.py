"""Optimal assignment of one labelling's states to another's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import natural_key
from .agreement import jaccard_matrix
from .intervals import state_lengths
from .overlap import WIDTH, overlap_pairs

def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of greatest total gain, by shortest augmenting paths with potentials."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    if not n:
        return []
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        dist, via, done = cost[i] - u[i] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            if row_of[j] < 0:
                break
            done[j] = True
            k = row_of[j]
            through = dist[j] + cost[k] - u[k] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], j
        # potentials keep all reduced costs at zero or more
        far = dist[j]
        u[i] += far
        for c in np.nonzero(done)[0]:
            u[row_of[c]] += far - dist[c]
            v[c] -= far - dist[c]
        while via[j] >= 0:
            row_of[j] = row_of[via[j]]
            j = int(via[j])
        row_of[j] = i
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, r) if flip else (r, j) for r, j in pairs)


def assignment(scores: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """state1, state2, <value> of the best one-to-one assignment of a grid (state1, state2, value), for each value of ``by``. Surplus
    states are left out. States stand in natural order, which settles ties. A grid is one task: its matrix has the square of the states."""
    keys = by or []
    schema = ", ".join([f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys] + ["state1 string", "state2 string", f"{value} double"])

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        one, two = (sorted(rows[c].unique(), key=natural_key) for c in ("state1", "state2"))
        gain = np.zeros((len(one), len(two)))
        at1, at2 = {s: i for i, s in enumerate(one)}, {s: i for i, s in enumerate(two)}
        gain[rows["state1"].map(at1), rows["state2"].map(at2)] = rows[value].fillna(0.0)
        got = assign(gain)
        cols = {k: pa.array([x.as_py()] * len(got), table.schema.field(k).type) for k, x in zip(keys, key, strict=True)}
        return pa.table(cols | {"state1": pa.array([one[i] for i, _ in got], pa.string()), "state2": pa.array([two[j] for _, j in got], pa.string()), value: pa.array([float(gain[i, j]) for i, j in got])})

    rows = scores.select(*keys, "state1", "state2", F.col(value).cast("double").alias(value))
    if not keys:
        rows = rows.withColumn("__k", F.lit(0))
        one_ = lambda key, table: solve((), table.drop(["__k"]))

        def alone(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return one_(key, table)

        return rows.groupBy("__k").applyInArrow(alone, schema)
    return rows.groupBy(*keys).applyInArrow(solve, schema)


def best_mapping(overlap: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The assignment of greatest total shared bp."""
    return assignment(overlap, "bp", by)


def match_states(overlap: DataFrame, work: DataFrame, ref: DataFrame, emission: DataFrame | None = None) -> DataFrame:
    """work_state, ref_state, jaccard, emission, quality of the assignment of greatest utility. overlap: state1 (work), state2 (ref), bp;
    work, ref: state, bp; emission: state1, state2, cosine. Quality is the mean of Jaccard and emission similarity, utility that
    with the square root of Jaccard; without emissions both are of Jaccard alone. A surplus work state has ref_state null."""
    grid = jaccard_matrix(overlap, work, ref)
    if emission is None:
        rows = grid.withColumn("emission", F.lit(None).cast("double")).withColumn("quality", F.col("jaccard")).withColumn("utility", F.sqrt("jaccard"))
    else:
        rows = grid.join(emission.withColumnRenamed("cosine", "emission"), ["state1", "state2"], "left").withColumn("emission", F.coalesce("emission", F.lit(0.0)))
        rows = rows.withColumn("quality", 0.5 * F.col("jaccard") + 0.5 * F.col("emission")).withColumn("utility", 0.5 * F.sqrt("jaccard") + 0.5 * F.col("emission"))
    best = assignment(rows, "utility").drop("utility")
    full = work.select(F.col("state").alias("state1")).join(best, "state1", "left").join(rows, ["state1", "state2"], "left")
    return full.select(F.col("state1").alias("work_state"), F.col("state2").alias("ref_state"), "jaccard", "emission", "quality")


def match_all(pairs: DataFrame, emission: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """One mapping over several pairs of files: overlaps and lengths are summed over the pairs first. pairs: pair, side (work or ref), chrom,
    start, end, state."""
    cut = lambda side: pairs.where(F.col("side") == side).drop("side")
    work, ref = cut("work"), cut("ref")
    overlap = overlap_pairs(work, ref, width, on=["pair"]).groupBy(F.col("l_state").alias("state1"), F.col("r_state").alias("state2")).agg(F.sum("bp").cast("long").alias("bp"))
    return match_states(overlap, state_lengths(work), state_lengths(ref), emission)


def pick_emissions(files: DataFrame) -> DataFrame:
    """dataset, path: the emission file that feeds the matching of a data set: the one that is named (``override``), else that of the binarized
    signal, else that of the signal; null if there is none. files: dataset, kind (override, binarized, signal), path."""
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path")))
    return files.groupBy("dataset").agg(F.coalesce(of("override"), of("binarized"), of("signal")).alias("path"))


def relabel(segments: DataFrame, mapping: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """Segments with mapped states (work_state -> ref_state); unmapped ones keep their name; a leading number and underscore goes, after
    the reference's colour (state, color) was taken by the whole name."""
    rows = segments.join(F.broadcast(mapping.select(F.col("work_state").alias("state"), "ref_state")), "state", "left")
    rows = rows.withColumn("state", F.coalesce("ref_state", "state")).drop("ref_state")
    if colors is not None:
        rows = rows.drop("color").join(F.broadcast(colors), "state", "left").withColumn("color", F.coalesce("color", F.lit("0,0,0")))
    return rows.withColumn("state", F.regexp_replace(F.trim("state"), r"^\d+_", ""))


def random_bijection(states: DataFrame, other: DataFrame, seed: int) -> DataFrame:
    """A random one-to-one map of two small state lists (state), the same for a seed."""
    order = lambda k: Window.partitionBy(F.lit(0)).orderBy(F.md5(F.concat(F.lit(f"{seed + k}:"), "state").cast("binary")), "state")
    one = states.select(F.col("state").alias("work_state"), F.row_number().over(order(0)).alias("i"))
    two = other.select(F.col("state").alias("ref_state"), F.row_number().over(order(1)).alias("i"))
    return one.join(two, "i", "left").drop("i")


def emission_mapping(cosines_augmented: DataFrame, cosines_raw: DataFrame) -> DataFrame:
    """Mean raw cosine over the pairs that the assignment on augmented vectors matches."""
    best = assignment(cosines_augmented, "cosine").drop("cosine")
    return best.join(cosines_raw, ["state1", "state2"]).agg(F.avg("cosine").alias("cosine"), F.count("*").alias("n"))


def state_colors(segments: DataFrame) -> DataFrame:
    """state, color of the state's first segment by ``ord``."""
    return segments.groupBy("state").agg(F.min_by("color", "ord").alias("color"))
