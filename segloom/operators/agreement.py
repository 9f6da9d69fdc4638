"""Agreement of labellings from their overlap table (state1, state2, bp) and length vectors (state, bp).

All of it is small after one distributed join and aggregation; results stay DataFrames, so many pairs go in one query under ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def _named(lengths: DataFrame, i: int) -> DataFrame:
    return lengths.select(F.col("state").alias(f"state{i}"), F.col("bp").alias(f"bp{i}"))


def grid(overlap: DataFrame, lengths1: DataFrame, lengths2: DataFrame) -> DataFrame:
    """Every (state1, state2) with bp, bp1 and bp2; state lists are small."""
    whole = _named(lengths1, 1).join(F.broadcast(_named(lengths2, 2)), F.lit(True))
    return whole.join(overlap, ["state1", "state2"], "left").withColumn("bp", F.coalesce("bp", F.lit(0)))


def jaccard_matrix(overlap: DataFrame, lengths1: DataFrame, lengths2: DataFrame) -> DataFrame:
    """state1, state2, jaccard of full lengths; 0 where the union is 0."""
    union = F.col("bp1") + F.col("bp2") - F.col("bp")
    return grid(overlap, lengths1, lengths2).select("state1", "state2", ratio(F.col("bp"), union).alias("jaccard"))


def npmi_matrix(overlap: DataFrame, lengths1: DataFrame, lengths2: DataFrame, genome: int | Column) -> DataFrame:
    """Normalised pointwise mutual information; -1 where the states never meet or meet everywhere."""
    g = F.lit(genome).cast("double") if isinstance(genome, int) else genome
    p, p1, p2 = F.col("bp") / g, F.col("bp1") / g, F.col("bp2") / g
    value = F.when((p <= 0) | (p >= 1), F.lit(-1.0)).otherwise(F.ln(p / (p1 * p2)) / -F.ln(p))
    return grid(overlap, lengths1, lengths2).select("state1", "state2", value.alias("npmi"))


def marginals(overlap: DataFrame) -> DataFrame:
    """state, p12, p1, p2: shares of the overlap that both sides, the first and the second label with the state."""
    total = overlap.agg(F.sum("bp").cast("double").alias("total"))
    one = overlap.groupBy(F.col("state1").alias("state")).agg(F.sum("bp").alias("m1"))
    two = overlap.groupBy(F.col("state2").alias("state")).agg(F.sum("bp").alias("m2"))
    both = overlap.where("state1 = state2").select(F.col("state1").alias("state"), F.col("bp").alias("m12"))
    rows = one.join(two, "state", "full").join(both, "state", "left").join(F.broadcast(total), F.lit(True))
    share = lambda c: F.try_divide(F.coalesce(c, F.lit(0)), F.col("total"))
    return rows.select("state", share("m12").alias("p12"), share("m1").alias("p1"), share("m2").alias("p2"))


def per_state_agreement(overlap: DataFrame, lengths1: DataFrame, lengths2: DataFrame) -> DataFrame:
    """state, jaccard of full lengths and one-vs-rest kappa of the overlap's marginals; states of empty union are left out."""
    sizes = _named(lengths1, 1).join(_named(lengths2, 2), F.col("state1") == F.col("state2"), "full")
    sizes = sizes.select(F.coalesce("state1", "state2").alias("state"), F.coalesce("bp1", F.lit(0)).alias("bp1"), F.coalesce("bp2", F.lit(0)).alias("bp2"))
    both = overlap.where("state1 = state2").select(F.col("state1").alias("state"), F.col("bp"))
    po = 1 - F.col("p1") - F.col("p2") + 2 * F.col("p12")
    pe = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    kappa = F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    rows = sizes.join(both, "state", "left").join(marginals(overlap), "state", "left").withColumn("bp", F.coalesce("bp", F.lit(0)))
    return rows.where(F.col("bp1") + F.col("bp2") > 0).select(
        "state", ratio(F.col("bp"), F.col("bp1") + F.col("bp2") - F.col("bp")).alias("jaccard"), F.coalesce(kappa, F.lit(0.0)).alias("kappa")
    )


def per_state_diagonal(overlap: DataFrame, states: list[str], metric: str) -> DataFrame:
    """state, value of one metric over the marginals of the listed states; a state whose denominator is 0 is left out."""
    held = overlap.where(F.col("state1").isin(states) & F.col("state2").isin(states))
    p12, p1, p2 = F.col("p12"), F.col("p1"), F.col("p2")
    value = {
        "jaccard": F.try_divide(p12, p1 + p2 - p12),
        "kappa": F.try_divide(2 * (p12 - p1 * p2), p1 + p2 - 2 * p1 * p2),
        "cosine": F.try_divide(p12, F.sqrt(p1 * p2)),
    }
    if metric not in value:
        raise ValueError(f"unknown metric {metric}")
    return marginals(held).select("state", value[metric].alias("value")).where("value is not null")


def kappa(overlap: DataFrame) -> DataFrame:
    """Cohen's kappa over all states; 1 if chance agreement is 1."""
    got = marginals(overlap).agg(F.sum("p12").alias("po"), F.sum(F.col("p1") * F.col("p2")).alias("pe"))
    return got.select(F.when(F.col("pe") >= 1, 1.0).otherwise(F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(0.0))).alias("kappa"))


def ami(overlap: DataFrame) -> DataFrame:
    """Mutual information over the mean entropy, natural logarithm, without the expected term; 1 if both sides are one state."""
    full = overlap.where("bp > 0")
    whole, row, col = Window.partitionBy(F.lit(0)), Window.partitionBy("state1"), Window.partitionBy("state2")
    cells = full.withColumn("t", F.sum("bp").over(whole).cast("double")).select(
        "state1", "state2", (F.col("bp") / F.col("t")).alias("p"), (F.sum("bp").over(row) / F.col("t")).alias("p1"), (F.sum("bp").over(col) / F.col("t")).alias("p2")
    )
    h = lambda s, p, a: cells.groupBy(s).agg(F.first(p).alias("q")).agg(F.sum(-F.col("q") * F.ln("q")).alias(a))
    got = cells.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("p1") * F.col("p2")))).alias("mi"), F.count("*").alias("n"))
    rows = got.join(h("state1", "p1", "h1"), F.lit(True)).join(h("state2", "p2", "h2"), F.lit(True))
    mean = (F.col("h1") + F.col("h2")) / 2
    return rows.select(F.when(F.col("n") == 0, 0.0).when(mean <= 1e-15, 1.0).otherwise(F.col("mi") / mean).alias("ami"))


def composition_cosine(lengths1: DataFrame, lengths2: DataFrame) -> DataFrame:
    """Cosine of bp by state, without the biggest state of either side; of equals the first by name is biggest. 0 if a norm is 0."""
    big = lambda d: d.orderBy(F.desc("bp"), "state").limit(1).select("state")
    left = _named(lengths1, 1).join(_named(lengths2, 2), F.col("state1") == F.col("state2"), "full")
    rows = left.select(F.coalesce("state1", "state2").alias("state"), F.coalesce("bp1", F.lit(0)).cast("double").alias("x"), F.coalesce("bp2", F.lit(0)).cast("double").alias("y"))
    kept = rows.join(F.broadcast(big(lengths1).unionByName(big(lengths2)).distinct()), "state", "left_anti")
    sums = kept.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return sums.select(ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"))


def agreement_metrics(overlap: DataFrame, lengths1: DataFrame, lengths2: DataFrame) -> DataFrame:
    """One row: kappa, mean per-state Jaccard, composition cosine, AMI; zeros if nothing overlaps."""
    mean = per_state_agreement(overlap, lengths1, lengths2).agg(F.avg("jaccard").alias("jaccard"))
    any_bp = overlap.agg(F.coalesce(F.sum("bp"), F.lit(0)).alias("total"))
    row = any_bp.join(kappa(overlap), F.lit(True)).join(mean, F.lit(True)).join(composition_cosine(lengths1, lengths2), F.lit(True)).join(ami(overlap), F.lit(True))
    return row.select(*(F.when(F.col("total") > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in ("kappa", "jaccard", "cosine", "ami")))


def confusion(labels1: DataFrame, labels2: DataFrame) -> DataFrame:
    """state1, state2, n of the bins that both sides label."""
    two = labels2.select("chrom", "bin", F.col("state").alias("state2"))
    return labels1.select("chrom", "bin", F.col("state").alias("state1")).join(two, ["chrom", "bin"]).groupBy("state1", "state2").agg(F.count("*").alias("n"))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """state, n1, n2, n12, jaccard over the common bins, with po, pe and kappa of all states in each row."""
    as_bp = counts.withColumnRenamed("n", "bp")
    whole = marginals(as_bp)
    total = counts.agg(F.sum("n").alias("n_bins"))
    sums = whole.agg(F.sum("p12").alias("po"), F.sum(F.col("p1") * F.col("p2")).alias("pe"))
    rows = whole.join(F.broadcast(total), F.lit(True)).join(F.broadcast(sums), F.lit(True))
    jac = F.try_divide(F.col("p12"), F.col("p1") + F.col("p2") - F.col("p12"))
    kap = F.when(F.col("pe") >= 1, 1.0).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    return rows.select("state", "n_bins", jac.alias("jaccard"), F.col("po"), F.col("pe"), kap.alias("kappa"))


def overlap_fraction(overlap: DataFrame, lengths1: DataFrame) -> DataFrame:
    """Share of the first side's bp that the second labels alike."""
    same = overlap.agg(F.coalesce(F.sum(F.when(F.col("state1") == F.col("state2"), F.col("bp"))), F.lit(0)).alias("same"))
    return same.join(lengths1.agg(F.sum("bp").alias("bp")), F.lit(True)).select(ratio(F.col("same"), F.col("bp")).alias("fraction"))


def relabelled_accuracy(overlap: DataFrame, map1: DataFrame, map2: DataFrame) -> DataFrame:
    """Share of bp whose mapped labels (state -> label) are equal; unmapped states never are."""
    one, two = map1.toDF("state1", "label1"), map2.toDF("state2", "label2")
    rows = overlap.join(F.broadcast(one), "state1", "left").join(F.broadcast(two), "state2", "left")
    same = F.sum(F.when(F.col("label1") == F.col("label2"), F.col("bp")).otherwise(0))
    return rows.agg(ratio(same, F.sum("bp")).alias("accuracy"))


def folded(overlap: DataFrame, map1: DataFrame, map2: DataFrame, rest: str = "Quiescent") -> DataFrame:
    """Overlap table of types: states mapped (state -> type) on either side, unmapped ones being ``rest``."""
    one, two = map1.toDF("state1", "type1"), map2.toDF("state2", "type2")
    rows = overlap.join(F.broadcast(one), "state1", "left").join(F.broadcast(two), "state2", "left")
    kinds = [F.coalesce(f"type{i}", F.lit(rest)).alias(f"state{i}") for i in (1, 2)]
    return rows.groupBy(*kinds).agg(F.sum("bp").cast("long").alias("bp"))


def combine_first(values: DataFrame) -> DataFrame:
    """a, b, value -> the value of (a, b), or that of (b, a) where it has none; every pair once for each orientation that is known."""
    swapped = values.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("other"))
    return values.join(swapped, ["a", "b"], "full").select("a", "b", F.coalesce("value", "other").alias("value"))


def symmetric_matrix(values: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, value over all pairs of labels: 1 on the diagonal, 0 where nothing was compared."""
    one, two = labels.toDF("a"), labels.toDF("b")
    grid_ = one.join(F.broadcast(two), F.lit(True)).join(combine_first(values), ["a", "b"], "left")
    return grid_.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))
