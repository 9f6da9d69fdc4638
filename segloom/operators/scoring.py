"""Sweep curves, ranks, stability and evidence tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(points: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area under (fpr, tpr), anchored at (0, 0) and (1, 1), in the order of fpr, then tpr."""
    anchors = points.select(*by).distinct().select(*by, F.explode(F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")), F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))).alias("a")).select(*by, "a.*")
    at = Window.partitionBy(*by).orderBy("fpr", "tpr")
    rows = points.select(*by, "fpr", "tpr").unionByName(anchors)
    area = (F.col("fpr") - F.lag("fpr").over(at)) * (F.col("tpr") + F.lag("tpr").over(at)) / 2
    return rows.withColumn("a", area).groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def average_precision(points: DataFrame, by: list[str], most_fpr: float | None = None) -> DataFrame:
    """Sum of recall steps times precision in the order of recall, of equals the higher precision first; no precision counts 0."""
    rows = points if most_fpr is None else points.where(F.col("fpr") < most_fpr)
    p = F.coalesce(F.nanvl("precision", F.lit(0.0)), F.lit(0.0))
    at = Window.partitionBy(*by).orderBy("tpr", F.desc("p"))
    step = F.col("tpr") - F.lag("tpr", 1, 0.0).over(at)
    return rows.withColumn("p", p).withColumn("s", step * F.col("p")).groupBy(*by).agg(F.sum("s").alias("average_precision"))


def best_f1(points: DataFrame, by: list[str]) -> DataFrame:
    """Highest F1 with its threshold (of equals the lowest), F1 at the default operating point, and mean F1."""
    return points.groupBy(*by).agg(
        F.max("f1").alias("best_f1"), F.max_by("threshold", F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("threshold"),
        F.max(F.when(F.col("is_default"), F.col("f1"))).alias("default_f1"), F.avg("f1").alias("mean_f1"),
    )


def rank_scores(rows: DataFrame, unit: list[str], value: str = "value", high: bool | Column = True) -> DataFrame:
    """score of each row in its unit: 1 - (number that beat it) / (n - 1); none if the unit has one row or only equals."""
    w = Window.partitionBy(*unit)
    signed = F.when(F.lit(high) if isinstance(high, bool) else high, F.col(value)).otherwise(-F.col(value))
    known = rows.where(F.col(value).isNotNull()).withColumn("__v", signed)
    beaten = F.rank().over(w.orderBy(F.desc("__v"))) - 1
    scored = known.withColumn("__n", F.count("*").over(w)).withColumn("__lo", F.min("__v").over(w)).withColumn("__hi", F.max("__v").over(w))
    score = F.when((F.col("__n") > 1) & (F.col("__hi") > F.col("__lo")), 1 - F.try_divide(beaten, F.col("__n") - 1))
    return scored.withColumn("score", score).drop("__v", "__n", "__lo", "__hi")


def score_evidence(rows: DataFrame, unit: list[str], high: bool | Column = True) -> DataFrame:
    """Rank scores of the units that bring none of their own (column ``given``); a unit with one is left as it is."""
    w = Window.partitionBy(*unit)
    own = F.max(F.col("given").isNotNull()).over(w)
    ranked = rank_scores(rows.withColumn("__own", own).where("not __own").drop("__own"), unit, high=high)
    kept = rows.withColumn("__own", own).where("__own").drop("__own").withColumn("score", F.col("given"))
    return ranked.unionByName(kept)


def axis_table(scored: DataFrame, axes: list[str]) -> DataFrame:
    """method, then a column per axis: the mean score."""
    return scored.groupBy("method").pivot("axis", axes).agg(F.avg("score"))


def fold_axes(table: DataFrame, into: str, axes: list[str]) -> DataFrame:
    """Variants of an axis as one column: their mean over those that are known."""
    n = sum((F.col(a).isNotNull().cast("int") for a in axes), F.lit(0))
    total = sum((F.coalesce(a, F.lit(0.0)) for a in axes), F.lit(0.0))
    return table.withColumn(into, F.try_divide(total, n)).drop(*(a for a in axes if a != into))


def blank_joint(table: DataFrame, axes: list[str]) -> DataFrame:
    """Axes across assays mean nothing for joint models."""
    joint = F.lower("method").contains("joint")
    return table.withColumns({a: F.when(~joint, F.col(a)) for a in axes})


def flip(rows: DataFrame, low: list[str], value: str = "value") -> DataFrame:
    """1 - value on the axes where low is better."""
    return rows.withColumn(value, F.when(F.col("axis").isin(low), 1 - F.col(value)).otherwise(F.col(value)))


def weighted_ranking(scored: DataFrame, weights: DataFrame, without: list[str] | None = None) -> DataFrame:
    """method, total = sum of weight * score over the sum of weights of the axes that it has, rank by position. weights: axis, weight.
    Methods in ``without`` take no part."""
    rows = scored.where(~F.col("method").isin(without or []) & F.col("score").isNotNull())
    mean = rows.groupBy("method", "axis").agg(F.avg("score").alias("score")).join(F.broadcast(weights), "axis")
    total = mean.groupBy("method").agg(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("total"), F.count("*").alias("n_axes"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "method")))


def best_and_worst(scored: DataFrame) -> DataFrame:
    """First best and first worst axis, in their given order (ord), of each method."""
    rows = scored.where("score is not null").groupBy("method").agg(F.array_sort(F.collect_list(F.struct("ord", "axis", "score"))).alias("r"))
    pick = lambda f: F.get("r.axis", F.array_position("r.score", f("r.score")).cast("int") - 1)
    return rows.select("method", pick(F.array_max).alias("best"), pick(F.array_min).alias("worst"))


def check_axes(rows: DataFrame, axes: list[str]) -> None:
    """Raise if evidence names an axis that is not known."""
    unknown = [r.axis for r in rows.where(~F.col("axis").isin(axes)).select("axis").distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown axes: {sorted(unknown)}")


def stability(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Coefficient of variation and sample variance; null under two values, and for the first where the mean is 0."""
    many = F.count(value) >= 2
    return rows.groupBy(*by).agg(
        F.when(many, F.try_divide(F.stddev_samp(value), F.avg(value))).alias("cv"), F.when(many, F.var_samp(value)).alias("var"), F.count(value).alias("n")
    )


def mean_error(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, count and standard error."""
    sd = F.stddev_samp(value)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("std"), F.count(value).alias("n"), F.try_divide(sd, F.sqrt(F.count(value))).alias("se"))


def outliers(rows: DataFrame, by: list[str], value: str = "value", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows under the low or over the high percentile of their group, percentiles by linear interpolation."""
    cut = rows.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("p_low"), F.percentile(value, F.lit(high)).alias("p_high"))
    return rows.join(cut, by).where((F.col(value) < F.col("p_low")) | (F.col(value) > F.col("p_high")))


def unusable(stats: DataFrame, min_share: float = 0.5, min_states: int = 15) -> DataFrame:
    """Labellings that cover less than a share of the data set's median or have too few states, with the reason. stats: dataset,
    segmentation, covered, n_states."""
    mid = F.median("covered").over(Window.partitionBy("dataset"))
    thin, few = F.col("covered") < min_share * mid, F.col("n_states") < min_states
    why = F.concat_ws("; ", F.when(thin, "covers too little"), F.when(few, F.concat(F.col("n_states").cast("string"), F.lit(" states"))))
    return stats.withColumn("reason", F.when(thin | few, why)).where("reason is not null").select("dataset", "segmentation", "reason")


def without_unusable(rows: DataFrame, bad: DataFrame, pair: str = "segmentation") -> DataFrame:
    """Rows neither side of whose a/b name is unusable (dataset, segmentation)."""
    names = bad.select(F.col("dataset"), F.col("segmentation").alias("__s"))
    keyed = rows.withColumn("__k", F.monotonically_increasing_id())
    hit = keyed.select("__k", "dataset", F.explode(F.split(pair, "/")).alias("__s")).join(names, ["dataset", "__s"]).select("__k").distinct()
    return keyed.join(hit, "__k", "left_anti").drop("__k")


def common_units(rows: DataFrame, unit: list[str], method: str = "method", value: str = "value") -> DataFrame:
    """Mean and count by method over the units that every method has a value for."""
    known = rows.where(F.col(value).isNotNull())
    total = known.agg(F.countDistinct(method).alias("__m"))
    whole = known.groupBy(*unit).agg(F.countDistinct(method).alias("__n")).join(F.broadcast(total), F.lit(True)).where("__n = __m").select(*unit)
    return known.join(whole, unit, "left_semi").groupBy(method).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def family_fold(rows: DataFrame, families: DataFrame, pair: list[str], value: str = "value") -> DataFrame:
    """Mean over the pairs of the mean over a family's states (families: state, family); states of no family are dropped."""
    inner = rows.join(F.broadcast(families), "state").groupBy(*pair, "family").agg(F.avg(value).alias("v"))
    return inner.groupBy("family").agg(F.avg("v").alias("mean"), F.count("*").alias("n_pairs"))


def paired_deltas(rows: DataFrame, unit: list[str], baseline: str, value: str = "value") -> DataFrame:
    """unit, method, delta to the baseline over the units that every method has."""
    known = rows.where(F.col(value).isNotNull())
    total = known.agg(F.countDistinct("method").alias("__m"))
    whole = known.groupBy(*unit).agg(F.countDistinct("method").alias("__n")).join(F.broadcast(total), F.lit(True)).where("__n = __m").select(*unit)
    base = known.where(F.col("method") == baseline).select(*unit, F.col(value).alias("__b"))
    rest = known.where(F.col("method") != baseline).join(whole, unit, "left_semi").join(base, unit)
    return rest.select(*unit, "method", (F.col(value) - F.col("__b")).alias("delta"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    """Mean, median, better and worse counts and share of wins by method; differences of 1e-12 are none."""
    return deltas.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.count(F.when(F.col("delta") > 1e-12, 1)).alias("better"),
        F.count(F.when(F.col("delta") < -1e-12, 1)).alias("worse"), F.avg((F.col("delta") > 0).cast("double")).alias("wins"),
    )


def wilcoxon(deltas: list[float]) -> float | None:
    """Two-sided p of the signed-rank test: exact up to 25 untied differences, else by the normal limit with ties; none under two."""
    d = [x for x in deltas if abs(x) > 1e-12]
    n = len(d)
    if n < 2:
        return None
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks, at, ties = [0.0] * n, 0, 0
    while at < n:
        to = at
        while to + 1 < n and abs(abs(d[order[to + 1]]) - abs(d[order[at]])) < 1e-15:
            to += 1
        for k in range(at, to + 1):
            ranks[order[k]] = (at + to) / 2 + 1
        t = to - at + 1
        ties += t**3 - t
        at = to + 1
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    total = n * (n + 1) / 2
    low = min(plus, total - plus)
    if n <= 25 and not ties:
        ways = [1] + [0] * int(total)
        for r in range(1, n + 1):
            for s in range(int(total), r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, math.erfc(abs(low - total / 2) / sd / math.sqrt(2))) if sd else 1.0


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    whole = Window.partitionBy(F.lit(0))
    average = lambda c: F.rank().over(whole.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.select(average(x).alias("a"), average(y).alias("b")).agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation by Student's t, its tail integrated numerically."""
    if n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    df, t = n - 2, abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
    lead = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    m, top = 4000, math.atan(t / math.sqrt(df))
    # with x = sqrt(df) tan(a) the density becomes lead * sqrt(df) * cos(a) ** (df - 1)
    h = top / m
    f = [math.cos(k * h) ** (df - 1) for k in range(m + 1)]
    inner = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return max(0.0, 1 - 2 * lead * math.sqrt(df) * inner)


def quiet_share(segments: DataFrame, by: list[str], is_quiet: Column) -> DataFrame:
    """Share of covered bp in quiescent states and in the others."""
    n = F.col("end") - F.col("start")
    quiet = F.coalesce(F.try_divide(F.sum(F.when(is_quiet, n).otherwise(0)), F.sum(n)), F.lit(0.0))
    return segments.groupBy(*by).agg(quiet.alias("quiescent"), (1 - quiet).alias("annotated"))


def mean_fractions(fractions: DataFrame, unit: str = "dataset") -> DataFrame:
    """Mean share of each state over all units, a state that a unit lacks counting 0."""
    units = fractions.agg(F.countDistinct(unit).alias("n"))
    total = fractions.groupBy("state").agg(F.sum("share").alias("s"))
    return total.join(F.broadcast(units), F.lit(True)).select("state", (F.col("s") / F.col("n")).alias("share"))


def _drawn(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def sample_pairs(items: DataFrame, key: str, limit: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``limit`` pairs a < b of the distinct names of a list, the same for a seed, in order; all pairs if there are no more. Pairs are
    drawn by number and then made, so their number does not grow with the square of the list."""
    names = items.select(F.col(key).alias("name")).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")).cast("long") - 1)
    n = names.count()
    total = n * (n - 1) // 2
    spark = items.sparkSession
    if total <= limit:
        which = spark.range(total).select(F.col("id").alias("p"))
    else:
        draws = spark.range(8 * limit).select("id", F.pmod(_drawn(F.lit(str(seed)), F.col("id").cast("string")), F.lit(total)).alias("p"))
        which = draws.groupBy("p").agg(F.min("id").alias("id")).orderBy("id").limit(limit)
    # pair number p of rows (0, 1), (0, 2), .. (1, 2), ..: row i begins at i (2 n - i - 1) / 2
    begin = lambda i: F.expr(f"{i} * (2L * {n} - {i} - 1) div 2")
    guess = which.withColumn("i", F.floor((2 * n - 1 - F.sqrt(F.lit(float(2 * n - 1)) ** 2 - 8 * F.col("p"))) / 2).cast("long"))
    exact = guess.withColumn("i", F.when(begin("i") > F.col("p"), F.col("i") - 1).when(begin("(i + 1)") <= F.col("p"), F.col("i") + 1).otherwise(F.col("i")))
    both = exact.withColumn("j", F.col("p") - begin("i") + F.col("i") + 1)
    one, two = names.select(F.col("i"), F.col("name").alias("a")), names.select(F.col("i").alias("j"), F.col("name").alias("b"))
    return both.join(one, "i").join(two, "j").select("a", "b").orderBy("a", "b")


def thin(rows: DataFrame, by: list[str], key: list[str], most: int = 150, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group for drawing, the same for a seed."""
    at = Window.partitionBy(*by).orderBy(_drawn(F.lit(str(seed)), *(F.col(k).cast("string") for k in key)), *key)
    return rows.withColumn("__r", F.row_number().over(at)).where(F.col("__r") <= most).drop("__r")


def unordered_pairs(items: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """a, b of all pairs a < b of a small list, of those that ``where`` (over a, b) admits."""
    names = items.select(key).distinct()
    both = names.toDF("a").join(F.broadcast(names.toDF("b")), F.col("a") < F.col("b"))
    return both if where is None else both.where(where)


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def in_order(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows with ``ord``: the place in a known list, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, known)), F.col(column))
    return rows.withColumn("ord", F.when(place > 0, place).otherwise(len(known) + F.dense_rank().over(Window.partitionBy(place > 0).orderBy(column))).cast("int"))


def reindex(rows: DataFrame, keys: DataFrame, on: list[str], fill: float = 0.0) -> DataFrame:
    """Rows for every key, ``fill`` where there are none."""
    return keys.join(rows, on, "left").na.fill(fill)


def sweep_order(points: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """Points with ``step``, their place in a sweep by threshold (ascending, or descending for a sign of -1), and ``edge``: first, last or null."""
    t = F.col("threshold") * sign
    up, down = Window.partitionBy(*by).orderBy(t), Window.partitionBy(*by).orderBy(F.desc(t))
    rows = points.withColumn("step", F.row_number().over(up).cast("long"))
    return rows.withColumn("edge", F.when(F.col("step") == 1, "first").when(F.row_number().over(down) == 1, "last"))


def group_share(rows: DataFrame, by: list[str], value: str, whole: str = "sum") -> DataFrame:
    """``share``: the value over the sum, maximum, mean or median of its group."""
    over = {"sum": F.sum, "max": F.max, "mean": F.avg, "median": F.median}[whole](value).over(Window.partitionBy(*by))
    return rows.withColumn("share", F.try_divide(F.col(value), over))


def in_sequence(rows: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """Rows of a small list numbered from 1 in an order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("long"))
