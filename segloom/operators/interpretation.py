"""Types of states from marks and annotations, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks with weights by group, annotations that support a family, thresholds on scores of 0 to 1, short names of types.
MARK_GROUPS = {
    "prom": {"H3K4me3": 1.0, "H3K9ac": 0.8, "H3K4me2": 0.4, "H2AFZ": 0.3},
    "enh": {"H3K27ac": 1.0, "H3K4me1": 1.0},
    "tx": {"H3K36me3": 1.0, "H3K79me2": 0.4, "H4K20me1": 0.3},
    "facu": {"H3K27me3": 1.0},
    "cons": {"H3K9me3": 1.0, "H3K9me2": 0.4},
    "ctcf": {"CTCF": 1.0},
}
TSS_ANNOTATIONS = ["RefSeqTSS", "RefSeqTSS2kb", "CpGIsland"]
GENE_ANNOTATIONS = ["RefSeqGene", "RefSeqExon", "RefSeqTES"]
MIN_SCALE, QUIET, STRONG, FACULTATIVE, OTHERS = 0.20, 0.15, 0.50, 0.35, 0.30
TIER_RATIO, TIER_FLOOR, FOLD_TSS, FOLD_GENE, UNCLASSIFIED = 0.60, 0.50, 20.0, 2.5, 0.05
SHORT = {
    "Promoter": "Prom", "PromoterFlanking": "Prom fla", "Enhancer": "Enha", "EnhancerLow": "Enha low", "Bivalent": "Biva", "CTCF": "CTCF",
    "Transcribed": "Tran", "K9K36": "K9K36", "FacultativeHet": "Facu", "ConstitutiveHet": "Cons", "Quiescent": "Quie",
}
FAMILIES = {"Promoter": "s_prom", "Enhancer": "s_enh", "Transcribed": "s_tran", "FacultativeHet": "s_facu", "ConstitutiveHet": "s_cons", "CTCF": "s_ctcf"}


def state_evidence(emissions: DataFrame, folds: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Per state: scores of the mark groups, of the annotations and of the families. emissions: state, mark, value; folds: state, label,
    fold. A mark counts relative to its strongest state, or to MIN_SCALE if that is weaker; a group that has no mark is null."""
    keys = by or []
    top = F.greatest(F.max("value").over(Window.partitionBy(*keys, "mark")), F.lit(MIN_SCALE))
    rel = emissions.withColumn("rel", F.least(F.greatest(F.col("value") / top, F.lit(0.0)), F.lit(1.0)))

    def group(weights: dict[str, float]) -> Column:
        w = F.element_at(F.create_map(*(x for m, v in weights.items() for x in (F.lit(m), F.lit(v)))), F.col("mark"))
        mine = F.col("mark").isin(list(weights))
        return F.try_divide(F.sum(F.when(mine, F.col("rel") * w)), F.sum(F.when(mine, w)))

    one = lambda m: F.max(F.when(F.col("mark") == m, F.col("rel")))
    rows = rel.groupBy(*keys, "state").agg(
        *(group(w).alias(g) for g, w in MARK_GROUPS.items()), one("H3K27ac").alias("k27ac"), one("H3K4me3").alias("k4me3"),
        F.max("rel").alias("max_mark"), F.max("value").alias("max_raw"),
    )
    if folds is None:
        rows = rows.withColumn("tss_fold", F.lit(1.0)).withColumn("gene_fold", F.lit(1.0))
    else:
        base = F.regexp_replace("label", r"\.[^.]+$", "")
        best = lambda names: F.max(F.when(base.isin(names), F.col("fold")))
        found = folds.groupBy(*keys, "state").agg(best(TSS_ANNOTATIONS).alias("tss_fold"), best(GENE_ANNOTATIONS).alias("gene_fold"))
        rows = rows.join(found, [*keys, "state"], "left").na.fill(1.0, ["tss_fold", "gene_fold"])
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("tss_ann", unit(F.log10(F.greatest(F.col("tss_fold"), F.lit(1.0))) / F.log10(F.lit(FOLD_TSS))))
    rows = rows.withColumn("gene_ann", unit((F.col("gene_fold") - 1) / (FOLD_GENE - 1))).drop("tss_fold", "gene_fold")
    return rows.select(
        "*", (0.6 * F.col("prom") + 0.4 * F.col("tss_ann")).alias("s_prom"), F.col("enh").alias("s_enh"),
        (0.7 * F.col("tx") + 0.3 * F.col("gene_ann")).alias("s_tran"), F.col("facu").alias("s_facu"), F.col("cons").alias("s_cons"), F.col("ctcf").alias("s_ctcf"),
    )


def interpret(evidence: DataFrame, by: list[str] | None = None) -> DataFrame:
    """family, type, short, reason, strength and margin of each state: the first rule that holds decides, and families of two tiers are
    split by the strongest state of the family in the segmentation."""
    keys = by or []
    some = lambda *cs: F.coalesce(F.greatest(*cs), F.lit(0.0))  # noqa: E731  greatest skips nulls
    active = some("k27ac", "k4me3")
    others = some("prom", "enh", "tx", "facu", "cons")
    ranked = F.array_sort(
        F.array(*(F.struct((-F.coalesce(c, F.lit(-1.0))).alias("neg"), F.lit(i).alias("i"), F.lit(f).alias("family")) for i, (f, c) in enumerate(FAMILIES.items())))
    )
    top = -F.get(ranked, F.lit(0))["neg"]
    fits = lambda c, at: F.coalesce(F.col(c) >= at, F.lit(False))
    quiet = 1 - F.col("max_mark")
    rules = [
        ((F.col("max_mark") < QUIET) & (F.col("max_raw") < QUIET), "Quiescent", F.lit("no mark"), quiet),
        (fits("cons", STRONG) & fits("tx", STRONG), "K9K36", F.lit("H3K9me3+H3K36me3"), F.least("cons", "tx")),
        (fits("facu", FACULTATIVE) & (active >= STRONG), "Bivalent", F.lit("H3K27me3+activating"), F.least(F.col("facu"), active)),
        (fits("ctcf", STRONG) & (others < OTHERS), "CTCF", F.lit("CTCF only"), F.col("ctcf") - others),
        (top < UNCLASSIFIED, "Quiescent", F.lit("no family"), quiet),
    ]

    def choose(k: int, rest: Column) -> Column:
        out = None
        for cond, *values in rules:
            v = F.lit(values[0]) if k == 0 else values[k]
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(rest)

    rows = evidence.withColumn("family", choose(0, F.get(ranked, F.lit(0))["family"])).withColumn("reason", choose(1, F.lit("dominant family"))).withColumn("strength", choose(2, top))
    best = lambda c: F.greatest(TIER_RATIO * F.max(c).over(Window.partitionBy(*keys, "family")), F.lit(TIER_FLOOR))
    kind = (
        F.when(F.col("family") == "Promoter", F.when(F.col("s_prom") >= best("s_prom"), "Promoter").otherwise("PromoterFlanking"))
        .when(F.col("family") == "Enhancer", F.when(F.col("s_enh") >= best("s_enh"), "Enhancer").otherwise("EnhancerLow"))
        .otherwise(F.col("family"))
    )
    scores = F.array_sort(F.array(*(F.coalesce(c, F.lit(0.0)) for c in FAMILIES.values())))
    margin = F.element_at(scores, -1) - F.element_at(scores, -2)
    short = F.element_at(F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv)), F.col("type"))
    return rows.withColumn("type", kind).select(*keys, "state", "family", "type", short.alias("short"), "reason", "strength", margin.alias("margin"))


def check_types(types: DataFrame, table: DataFrame) -> None:
    """Raise if a type is missing from the types table (type)."""
    unknown = [r.type for r in types.select("type").distinct().join(table.select("type"), "type", "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"types missing from the types table: {sorted(unknown)}")


def type_matrix(types: DataFrame, value: str = "short") -> DataFrame:
    """method, 1, 2, ..: the types of a method's states by the number in their name, then by name; as many columns as the method with the most
    states has."""
    number = F.coalesce(F.regexp_replace("state", r"\D", "").try_cast("int"), F.lit(0))
    rows = types.withColumn("k", F.row_number().over(Window.partitionBy("method").orderBy(number, "state")))
    most = rows.agg(F.max("k")).first()[0] or 0
    return rows.groupBy("method").pivot("k", list(range(1, most + 1))).agg(F.first(value))
