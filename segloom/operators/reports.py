"""Tables over many labellings: comparisons of pairs in one query, summaries, lookups and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_joint, is_replicate, should_compare
from .agreement import ratio
from .emissions import cosine, gini
from .enrichment import enrichment
from .intervals import bin_labels, composition, guarded_sequence, length, merge_intervals, state_lengths, state_report, total_bp, transition_entropy, transitions
from .matching import assignment
from .overlap import WIDTH, overlap_pairs


def eligible_pairs(labels: DataFrame) -> DataFrame:
    """a, b of the pairs of labellings (label) that may be compared."""
    names = labels.select("label").distinct()
    both = names.toDF("a").join(names.toDF("b"), F.col("a") < F.col("b"))
    return both.where(should_compare(F.col("a"), F.col("b")))


def compare_pairs(segments: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, overlap_fraction, kappa, mean_jaccard for every pair (a, b) of labellings (id, chrom, start, end, state): one join and
    aggregation for all pairs, not a job for each."""
    keyed = pairs.withColumn("pair", F.struct("a", "b"))
    side = lambda c: segments.join(F.broadcast(keyed), F.col("id") == F.col(c)).select("pair", "chrom", "start", "end", "state")
    one, two = side("a"), side("b")
    ov = overlap_pairs(one, two, width, on=["pair"]).groupBy("pair", F.col("l_state").alias("s1"), F.col("r_state").alias("s2")).agg(F.sum("bp").cast("double").alias("bp"))
    l1, l2 = state_lengths(one, ["pair"]), state_lengths(two, ["pair"])
    total = ov.groupBy("pair").agg(F.sum("bp").alias("t"), F.sum(F.when(F.col("s1") == F.col("s2"), F.col("bp")).otherwise(0.0)).alias("same"))
    m1 = ov.groupBy("pair", F.col("s1").alias("state")).agg(F.sum("bp").alias("m1"))
    m2 = ov.groupBy("pair", F.col("s2").alias("state")).agg(F.sum("bp").alias("m2"))
    chance = m1.join(m2, ["pair", "state"]).groupBy("pair").agg(F.sum(F.col("m1") * F.col("m2")).alias("mm"))
    sizes = l1.withColumnRenamed("bp", "b1").join(l2.withColumnRenamed("bp", "b2"), ["pair", "state"], "full").na.fill(0, ["b1", "b2"])
    alike = ov.where("s1 = s2").select("pair", F.col("s1").alias("state"), F.col("bp").alias("both"))
    jac = sizes.join(alike, ["pair", "state"], "left").na.fill(0.0, ["both"]).where("b1 + b2 > 0")
    mean = jac.groupBy("pair").agg(F.avg(ratio(F.col("both"), F.col("b1") + F.col("b2") - F.col("both"))).alias("mean_jaccard"), F.sum("b1").alias("genome"))
    po, pe = ratio(F.col("same"), F.col("t")), F.coalesce(F.try_divide(F.col("mm"), F.col("t") * F.col("t")), F.lit(0.0))
    rows = mean.join(total, "pair", "left").join(chance, "pair", "left").na.fill(0.0, ["t", "same", "mm"])
    kappa = F.when(F.col("t") == 0, 0.0).when(pe >= 1, 1.0).otherwise(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)))
    return rows.select("pair.a", "pair.b", ratio(F.col("same"), F.col("genome")).alias("overlap_fraction"), kappa.alias("kappa"), F.col("mean_jaccard"))


def segmentation_summary(segments: DataFrame, bin_size: int, by: list[str] | None = None) -> DataFrame:
    """Count, lengths, share of bp, entropy of the successors and, if there is one, colour of each state."""
    keys = [*(by or []), "state"]
    share = composition(segments, by).select(*keys, "share")
    entropy = transition_entropy(transitions(bin_labels(segments, bin_size, by), by), state_lengths(segments, by), by).select(*keys, "entropy")
    out = state_report(segments, by).join(share, keys, "left").join(entropy, keys, "left")
    if "color" in segments.columns:
        out = out.join(segments.groupBy(*keys).agg(F.min_by("color", F.struct("chrom", "start")).alias("color")), keys, "left")
    return out


def lookup_rows(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """state of ``wanted`` with the table's row (name, ..) of that name, else of the same number ('1.0' is '1'); null if there is none."""
    number = lambda c: F.col(c).try_cast("double").try_cast("int")
    exact = wanted.join(table.withColumn("state", F.col("name")), "state", "left")
    found, missing = exact.where("name is not null"), exact.where("name is null").select("state")
    numbered = table.withColumn("__n", number("name")).where("__n is not null")
    first = numbered.withColumn("__r", F.row_number().over(Window.partitionBy("__n").orderBy("name"))).where("__r = 1").drop("__r")
    return found.unionByName(missing.withColumn("__n", number("state")).join(first, "__n", "left").drop("__n").select(*found.columns))


def upper_pairs(*matrices: tuple[str, DataFrame], order: DataFrame) -> DataFrame:
    """a, b and a column per matrix (a, b, value), a before b in ``order`` (label, ord); the first matrix decides which pairs there are."""
    ord1, ord2 = order.select(F.col("label").alias("a"), F.col("ord").alias("o1")), order.select(F.col("label").alias("b"), F.col("ord").alias("o2"))
    name, first = matrices[0]
    rows = first.withColumnRenamed("value", name).join(F.broadcast(ord1), "a").join(F.broadcast(ord2), "b").where("o1 < o2").drop("o1", "o2")
    for name, m in matrices[1:]:
        rows = rows.join(m.withColumnRenamed("value", name), ["a", "b"], "left")
    return rows.withColumn("dataset_a", F.split_part("a", F.lit(":"), F.lit(1))).withColumn("dataset_b", F.split_part("b", F.lit(":"), F.lit(1)))


def individual_joint_pairs(catalogue: DataFrame) -> DataFrame:
    """Individual and joint labelling of a data set by one caller, side by side. catalogue: dataset, caller, method, path."""
    joint = catalogue.where(is_joint(F.col("method"))).select("dataset", "caller", F.col("path").alias("joint_path"))
    return catalogue.where(~is_joint(F.col("method"))).join(joint, ["dataset", "caller"])


def replicate_pairs(catalogue: DataFrame) -> DataFrame:
    """Both replicates of a method of a data set. catalogue: dataset, method, rep, path."""
    two = catalogue.where("rep = 'rep2'").select("dataset", "method", F.col("path").alias("path2"))
    return catalogue.where("rep = 'rep1'").withColumnRenamed("path", "path1").drop("rep").join(two, ["dataset", "method"])


def scorecard(overlap: DataFrame, mapping: DataFrame, recovery: DataFrame, is_regulatory: Column) -> DataFrame:
    """Scores of a matching: bp accuracy, balanced accuracy (mean recall of the reference's states), accuracy of regulatory and of other
    reference states (is_regulatory over state2), mean matched emission, and mean F1 if all are known. overlap: state1, state2, bp;
    mapping: work_state, ref_state, emission; recovery: label, f1."""
    named = overlap.join(F.broadcast(mapping.select(F.col("work_state").alias("state1"), "ref_state")), "state1", "left")
    rows = named.withColumn("hit", F.when(F.col("ref_state") == F.col("state2"), F.col("bp")).otherwise(0)).withColumn("reg", is_regulatory)
    per = rows.groupBy("state2", "reg").agg(F.sum("hit").alias("hit"), F.sum("bp").alias("bp"))
    part = lambda c: ratio(F.sum(F.when(c, F.col("hit"))), F.sum(F.when(c, F.col("bp"))))
    got = per.agg(part(F.lit(True)).alias("accuracy"), F.avg(ratio(F.col("hit"), F.col("bp"))).alias("balanced"), part(F.col("reg")).alias("regulatory"), part(~F.col("reg")).alias("background"))
    em = mapping.agg(F.avg("emission").alias("emission"))
    f1 = recovery.agg(F.when(F.count("f1") == F.count("*"), F.avg("f1")).alias("mean_f1"))
    return got.join(em, F.lit(True)).join(f1, F.lit(True))


def zipped_emissions(reference: DataFrame, dense: DataFrame, values: DataFrame, first: int = 1000) -> DataFrame:
    """Emissions under reference names where only two aligned files are left: the i-th of the first segments of each pair up, a state
    takes its commonest partner, and values (state, mark, value) are averaged under it. Both files carry ``ord``."""
    top = lambda d, n: d.orderBy("ord").limit(first).select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")).alias("i"), F.col("state").alias(n))
    pairs = top(dense, "state").join(top(reference, "ref"), "i").groupBy("state", "ref").agg(F.count("*").alias("n"))
    best = pairs.groupBy("state").agg(F.max_by("ref", F.struct("n", "ref")).alias("ref"))
    return values.join(F.broadcast(best), "state").groupBy(F.col("ref").alias("state"), "mark").agg(F.avg("value").alias("value"))


def peak_table(stats: DataFrame, jaccard: DataFrame) -> DataFrame:
    """n, mean and median length of peaks by method and mark: pooled ones, else the mean of the replicates that have peaks; with the
    replicates' Jaccard. stats: method, mark, rep ('' pooled), n, mean_len, median_len; jaccard: method, mark, jaccard."""
    pooled = F.col("rep") == ""
    some = F.col("n") > 0
    pick = lambda c: F.coalesce(F.max(F.when(pooled & some, F.col(c).cast("double"))), F.avg(F.when(~pooled & some, F.col(c).cast("double"))), F.lit(0.0)).alias(c)
    return stats.groupBy("method", "mark").agg(pick("n"), pick("mean_len"), pick("median_len")).join(jaccard, ["method", "mark"], "left")


def versus_reference(rows: DataFrame, reference: str) -> DataFrame:
    """Pooled rows of which exactly one side is the reference, with the other side's name. rows: seg1, seg2, .."""
    one, two = F.col("seg1") == reference, F.col("seg2") == reference
    kept = rows.where((one != two) & ~is_replicate(F.col("seg1")) & ~is_replicate(F.col("seg2")))
    return kept.withColumn("method", F.when(F.col("seg1") == reference, F.col("seg2")).otherwise(F.col("seg1")))


def footprint(peaks: DataFrame, by: list[str]) -> DataFrame:
    """Peaks, merged bp and last base of each group."""
    merged = total_bp(merge_intervals(peaks, by, drop_empty=True), by)
    return peaks.groupBy(*by).agg(F.count("*").alias("n"), F.max("end").alias("last")).join(merged, by, "left").na.fill(0, ["bp"])


def check_complete(table: DataFrame, size: int, share: float = 0.95) -> None:
    """Raise if the last peak of a group is not near the chromosome's end."""
    short = table.where(F.col("last") < share * size).limit(20).collect()
    if short:
        raise ValueError(f"peaks stop early: {[r.asDict() for r in short]}")


def annotation_jaccard(table: DataFrame, state: str, prefix: str) -> DataFrame:
    """label, jaccard of one state with the annotations of a prefix."""
    return table.where((F.col("state") == state) & F.col("label").startswith(prefix)).select("label", "jaccard")


def by_threshold(points: DataFrame) -> DataFrame:
    """Mean and variance, in percent, of sensitivity and precision by method and threshold."""
    pct = lambda c: [F.avg(100 * F.col(c)).alias(f"{c}_mean"), F.var_samp(100 * F.col(c)).alias(f"{c}_var")]
    return points.groupBy("method", "threshold").agg(*pct("tpr"), *pct("precision"))


def tolerant_lookup(table: DataFrame, state: str, label: str) -> DataFrame:
    """The row of a table (state, label, ord, ..) for a state and an annotation: the exact state, else one that is equal but for case,
    else one that contains it; the annotation itself, else one with the same name before a dot."""
    base = lambda c: F.substring_index(c, ".", 1)
    s = F.when(F.col("state") == state, 0).when(F.lower("state") == state.lower(), 1).when(F.lower("state").contains(state.lower()), 2)
    a = F.when(F.col("label") == label, 0).when(base("label") == F.substring_index(F.lit(label), ".", 1), 1)
    rows = table.withColumn("__s", s).withColumn("__a", a).where("__s is not null and __a is not null")
    return rows.orderBy("__s", "__a", "ord").limit(1).drop("__s", "__a")


def comparison_table(methods: DataFrame, *tables: DataFrame) -> DataFrame:
    """One row per method (method, ord), in order, with the columns of every table (method, ..) that has it; '_dense' variants are left out."""
    rows = methods.where(~F.col("method").endswith("_dense"))
    for t in tables:
        rows = rows.join(t, "method", "left")
    return rows.orderBy("ord", "method")


def offsets(sizes: DataFrame, bin_size: int) -> DataFrame:
    """First bin of each chromosome (chrom, size, ord) when all are laid end to end."""
    before = Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    n = F.ceil(F.col("size") / bin_size)
    return sizes.withColumn("n_bins", n).withColumn("first_bin", F.coalesce(F.sum("n_bins").over(before), F.lit(0)))


def grid_labels(labels: DataFrame, sizes: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bin, state over every bin of the chromosomes; bins that nothing covers hold '0'."""
    n = sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / bin_size) - 1)).alias("bin"))
    return n.join(labels, ["chrom", "bin"], "left").select("chrom", "bin", F.coalesce("state", F.lit("0")).alias("state"))


def canonical_order(states: DataFrame, known: DataFrame) -> DataFrame:
    """states with ord: that of the known list (state, ord), then by the number in the name."""
    number = F.regexp_extract("state", r"(\d+)", 1).try_cast("int")
    rows = states.join(F.broadcast(known), "state", "left")
    return rows.withColumn("ord", F.coalesce(F.col("ord"), F.lit(1_000_000) + F.coalesce(number, F.lit(999_999))))


def dropped_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """item, side of what only one of two lists has."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def grouped_order(items: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """Items in an order that keeps a group together, groups by their first item."""
    return items.withColumn("__g", F.min(order).over(Window.partitionBy(group))).orderBy("__g", order).drop("__g")


def same_biosample(one: Column, two: Column) -> Column:
    """Whether two data sets are of one biosample: equal up to the assay after the first underscore."""
    return F.lower(F.substring_index(one, "_", 1)) == F.lower(F.substring_index(two, "_", 1))


def coverage_share(segments: DataFrame, by: list[str]) -> DataFrame:
    """Shares of states by group, and those renormalised to 1 over the states that all groups have."""
    rows = segments.groupBy(*by, "state").agg(F.sum(length()).alias("bp"))
    total = F.sum("bp").over(Window.partitionBy(*by))
    return rows.select(*by, "state", F.try_divide(F.col("bp"), total).alias("share"))


def compare_labellings(segments: DataFrame, pairs: DataFrame, bins: DataFrame, emissions: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """The whole comparison of every pair (a, b): ``compare_pairs``, agreement of bins of the smaller bin size of the two (n_bins, bin_kappa), cosine
    of compositions, and, of pairs whose sides both have emissions (id, state, mark, value), their mean cosine after the one-to-one assignment.
    bins: id, bin_size."""
    base = compare_pairs(segments, pairs, width)
    size = lambda c: bins.select(F.col("id").alias(c), F.col("bin_size").alias(f"__{c}"))
    sized = pairs.join(F.broadcast(size("a")), "a").join(F.broadcast(size("b")), "b").select("a", "b", F.least("__a", "__b").alias("__n"))

    def side(c: str) -> DataFrame:
        rows = segments.join(F.broadcast(sized), F.col("id") == F.col(c)).where("state is not null")
        each = rows.select("a", "b", "chrom", "state", F.struct("start", "end", "state").alias("o"), F.explode(guarded_sequence(F.expr("start div __n"), F.expr("end div __n - 1"))).alias("bin"))
        return each.groupBy("a", "b", "chrom", "bin").agg(F.max_by("state", "o").alias(f"s_{c}"))

    cells = side("a").join(side("b"), ["a", "b", "chrom", "bin"]).groupBy("a", "b", "s_a", "s_b").agg(F.count("*").cast("double").alias("n"))
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("s_a") == F.col("s_b"), F.col("n")).otherwise(0.0)).alias("same"))
    margin = lambda c: cells.groupBy("a", "b", F.col(f"s_{c}").alias("state")).agg(F.sum("n").alias(f"m_{c}"))
    chance = margin("a").join(margin("b"), ["a", "b", "state"]).groupBy("a", "b").agg(F.sum(F.col("m_a") * F.col("m_b")).alias("mm"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("mm", F.lit(0.0)) / (F.col("t") * F.col("t"))
    by_bin = total.join(chance, ["a", "b"], "left").select("a", "b", F.col("t").cast("long").alias("n_bins"), F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("bin_kappa"))
    lengths = state_lengths(segments, ["id"]).withColumn("bp", F.col("bp").cast("double"))
    own = lambda c: pairs.join(lengths, F.col("id") == F.col(c)).select("a", "b", "state", F.col("bp").alias(f"l_{c}"))
    both = own("a").join(own("b"), ["a", "b", "state"], "full").na.fill(0.0, ["l_a", "l_b"]).groupBy("a", "b")
    x, y = F.col("l_a"), F.col("l_b")
    shape = both.agg(ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("composition_cosine"))
    out = base.join(by_bin, ["a", "b"], "left").join(shape, ["a", "b"], "left")
    if emissions is None:
        return out.withColumn("emission_cosine", F.lit(None).cast("double"))
    vecs = emissions.groupBy("id", "state").agg(F.array_sort(F.collect_list(F.struct("mark", "value"))).alias("v")).select("id", "state", F.col("v.value").alias("v"))
    vec = lambda c, n: pairs.join(vecs, F.col("id") == F.col(c)).select("a", "b", F.col("state").alias(f"state{n}"), F.col("v").alias(f"v{n}"))
    alike = vec("a", 1).join(vec("b", 2), ["a", "b"]).select("a", "b", "state1", "state2", cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    mean = assignment(alike, "cosine", ["a", "b"]).groupBy("a", "b").agg(F.avg("cosine").alias("emission_cosine"))
    return out.join(mean, ["a", "b"], "left")


def emission_records(emissions: DataFrame) -> DataFrame:
    """Per dataset, method and kind of emissions (dataset, method, kind, state, mark, value): the states, mean and population deviation of the
    cosines of all pairs of states, and the mean Gini index of the states."""
    keys = ["dataset", "method", "kind"]
    vecs = emissions.groupBy(*keys, "state").agg(F.array_sort(F.collect_list(F.struct("mark", "value"))).alias("v")).select(*keys, "state", F.col("v.value").alias("v"))
    pairs = vecs.toDF(*keys, "s1", "v1").join(vecs.toDF(*keys, "s2", "v2"), keys).where("s1 < s2")
    alike = pairs.groupBy(*keys).agg(F.avg(cosine(F.col("v1"), F.col("v2"))).alias("mean"), F.stddev_pop(cosine(F.col("v1"), F.col("v2"))).alias("std"))
    return vecs.groupBy(*keys).agg(F.count("*").alias("n_states"), F.avg(gini(F.col("v"))).alias("gini")).join(alike, keys, "left")


def records_by_method(records: DataFrame) -> DataFrame:
    """Mean over data sets of each method and kind of emissions, and its deviation, 0 where there is one data set."""
    return records.groupBy("method", "kind").agg(F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.count("mean").alias("n"))


def grid_agreement(labels: DataFrame) -> DataFrame:
    """sample1, point1, sample2, point2, ami of every two labellings of a parameter grid (sample, point, chrom, bin, state): of one sample at two
    points, or of two samples at one point; over the bins that both cover. An index of 1 where both have one state."""
    one = labels.toDF("sample1", "point1", "chrom", "bin", "s1")
    two = labels.toDF("sample2", "point2", "chrom", "bin", "s2")
    pair = (F.col("sample1") == F.col("sample2")) & (F.col("point1") < F.col("point2")) | (F.col("sample1") < F.col("sample2")) & (F.col("point1") == F.col("point2"))
    keys = ["sample1", "point1", "sample2", "point2"]
    cells = one.join(two, ["chrom", "bin"]).where(pair).groupBy(*keys, "s1", "s2").agg(F.count("*").cast("double").alias("n"))
    whole = Window.partitionBy(*keys)
    p = cells.select(
        *keys, "s1", "s2", (F.col("n") / F.sum("n").over(whole)).alias("p"), (F.sum("n").over(Window.partitionBy(*keys, "s1")) / F.sum("n").over(whole)).alias("p1"),
        (F.sum("n").over(Window.partitionBy(*keys, "s2")) / F.sum("n").over(whole)).alias("p2"),
    )
    # -sum q ln q over the states is -sum p ln q over the cells
    out = p.groupBy(*keys).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("p1") * F.col("p2")))).alias("mi"), (-F.sum(F.col("p") * F.ln("p1")) - F.sum(F.col("p") * F.ln("p2"))).alias("h"))
    return out.select(*keys, F.when(F.col("h") <= 1e-12, 1.0).otherwise(2 * F.col("mi") / F.col("h")).alias("ami"))


def evidence_of(segments: DataFrame, bin_size: int, emissions: DataFrame | None = None, annotations: DataFrame | None = None, width: int = WIDTH) -> dict[str, DataFrame]:
    """All tables of one labelling: report, composition, entropy and transitions of its states, emissions as they are given, and enrichment with
    its annotations."""
    moves = transitions(bin_labels(segments, bin_size))
    out = {"report": state_report(segments), "composition": composition(segments), "entropy": transition_entropy(moves, state_lengths(segments)), "transitions": moves}
    if emissions is not None:
        out["emissions"] = emissions
    if annotations is not None:
        out["enrichment"] = enrichment(segments, annotations, width)
    return out


def data_set_annotations(standard: DataFrame, atac: DataFrame, expressed: DataFrame, dataset: str) -> DataFrame:
    """chrom, start, end, label: the standard annotations, the data set's own open chromatin (dataset, chrom, start, end) and its expression
    annotations (label, chrom, start, end)."""
    own = atac.where(F.col("dataset") == dataset).select("chrom", "start", "end", F.lit("ATAC").alias("label"))
    return standard.select("chrom", "start", "end", "label").unionByName(own).unionByName(expressed.select("chrom", "start", "end", "label"))
