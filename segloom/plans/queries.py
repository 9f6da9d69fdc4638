"""Registered queries of the interval engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import agreement as A
from ..operators import binarize as B
from ..operators import clustering as C
from ..operators import emissions as E
from ..operators import enrichment as R
from ..operators import genes as G
from ..operators import interpretation as P
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import overlap as O
from ..operators import reports as T
from ..operators import scoring as S
from ..sources import readers, writers
from ..sources.folder import shared_folder
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BIN, COARSE, MARKS = 300, 3600, ["AF", "AO", "NF", "NO", "RF", "RO"]
MODES = ["AF", "NF", "NO", "RF"]
WIDTH = 1 << 12


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = V.seg(spark, sf)
    return s.where("side = 0").drop("side"), s.where("side = 1").drop("side")


def pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlap table and length vectors of the two sides."""
    one, two = sides(spark, sf)
    return O.overlap_table(one, two, width=WIDTH), I.state_lengths(one), I.state_lengths(two)


_OV = {
    "ov": """SELECT a.state AS state1, b.state AS state2, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS bp
        FROM seg a JOIN seg b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2""",
    "l1": 'SELECT state, CAST(sum("end" - start) AS BIGINT) AS bp FROM seg WHERE side = 0 GROUP BY 1',
    "l2": 'SELECT state, CAST(sum("end" - start) AS BIGINT) AS bp FROM seg WHERE side = 1 GROUP BY 1',
}
_MARG = _OV | {
    "tot": "SELECT CAST(sum(bp) AS DOUBLE) AS t FROM ov",
    "mg": """SELECT state, coalesce(m12, 0) / t AS p12, coalesce(m1, 0) / t AS p1, coalesce(m2, 0) / t AS p2 FROM
        (SELECT state1 AS state, sum(bp) AS m1 FROM ov GROUP BY 1) FULL JOIN (SELECT state2 AS state, sum(bp) AS m2 FROM ov GROUP BY 1) USING (state)
        LEFT JOIN (SELECT state1 AS state, bp AS m12 FROM ov WHERE state1 = state2) USING (state), tot""",
}


# --- intervals -----------------------------------------------------------------------------------------------------------


@query(V.with_views("seg", {}, 'SELECT side, state, CAST(sum("end" - start) AS BIGINT) AS bp FROM seg GROUP BY 1, 2'))
def state_lengths(spark, sf):
    return I.state_lengths(V.seg(spark, sf), ["side"])


@query(V.with_views("seg", {}, """SELECT side, count(DISTINCT state) AS n_states, count(*) AS n_segments, min("end" - start) AS min_len, max("end" - start) AS max_len,
    round(avg("end" - start), 6) AS mean_len, round(median("end" - start), 6) AS median_len FROM seg GROUP BY 1"""))
def seg_stats(spark, sf):
    return I.segment_stats(V.seg(spark, sf), ["side"])


@query(V.with_views("seg", {}, """SELECT side, state, round(avg("end" - start), 6) AS mean_len, round(median("end" - start), 6) AS median_len,
    round(sum("end" - start) / sum(sum("end" - start)) OVER (PARTITION BY side), 6) AS share FROM seg GROUP BY 1, 2"""))
def composition(spark, sf):
    return I.composition(V.seg(spark, sf), ["side"])


@query(V.with_views("seg", {}, """SELECT side, state, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS total_bp, round(avg("end" - start), 1) AS mean_len,
    round(median("end" - start), 1) AS median_len FROM seg GROUP BY 1, 2"""))
def report(spark, sf):
    return I.state_report(V.seg(spark, sf), ["side"])


_ISL = """SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end"
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {src})) GROUP BY {keys}, i"""


@query(V.with_views("peaks", {}, _ISL.format(keys="mark, chrom", src="peaks")))
def merge_intervals(spark, sf):
    return I.merge_intervals(V.peaks(spark, sf), ["mark"], block=1 << 17)


@query(V.with_views("peaks", {"m": _ISL.format(keys="mark, chrom", src="peaks")}, 'SELECT mark, CAST(sum("end" - start) AS BIGINT) AS bp FROM m GROUP BY 1'))
def region_total(spark, sf):
    return I.total_bp(I.merge_intervals(V.peaks(spark, sf), ["mark"], block=1 << 17), ["mark"])


@query(V.with_views("ann", {}, 'SELECT chrom, greatest(0, start - 500) AS start, "end" + 500 AS "end", label FROM ann'))
def extend(spark, sf):
    return I.extend(V.ann(spark, sf), 500)


@query(V.with_views("peaks", {}, """SELECT mark, count(*) AS n, round(avg("end" - start), 6) AS mean_len, round(median("end" - start), 6) AS median_len FROM peaks GROUP BY 1"""))
def peak_stats(spark, sf):
    return I.region_stats(V.peaks(spark, sf), ["mark"])


_BINS = {"lab": f"""SELECT side, chrom, bin, max_by(state, (start, "end", state)) AS state FROM (SELECT *, unnest(range(start // {BIN}, "end" // {BIN})) AS bin FROM seg
    WHERE "end" // {BIN} > start // {BIN}) GROUP BY 1, 2, 3"""}


@query(V.with_views("seg", _BINS, "SELECT * FROM lab"))
def bin_explode(spark, sf):
    return I.bin_labels(V.seg(spark, sf), BIN, ["side"])


@query(V.with_views("seg", _BINS, f"""SELECT side, chrom, state, min(bin) * {BIN} AS start, (max(bin) + 1) * {BIN} AS "end" FROM
    (SELECT *, bin - row_number() OVER (PARTITION BY side, chrom, state ORDER BY bin) AS i FROM lab) GROUP BY 1, 2, 3, i"""))
def rle_islands(spark, sf):
    return I.runs(I.bin_labels(V.seg(spark, sf), BIN, ["side"]), BIN, by=["side"])


def _depth_sql(src: str) -> str:
    return f"""SELECT state, depth, bins, CAST(sum(bins) OVER (PARTITION BY state ORDER BY depth) AS BIGINT) AS cum_bins FROM
    (SELECT state, CAST(depth AS BIGINT) AS depth, CAST(sum(n // {BIN}) AS BIGINT) AS bins FROM (SELECT state, sum(d) OVER (PARTITION BY chrom, state ORDER BY pos) AS depth,
    lead(pos) OVER (PARTITION BY chrom, state ORDER BY pos) - pos AS n FROM (SELECT chrom, state, pos, sum(d) AS d FROM
    (SELECT chrom, state, start AS pos, 1 AS d FROM {src} UNION ALL SELECT chrom, state, "end", -1 FROM {src}) GROUP BY 1, 2, 3)) WHERE depth > 0 AND n IS NOT NULL GROUP BY 1, 2)"""


@query(V.with_views("seg", {}, _depth_sql("seg")))
def depth_sweep(spark, sf):
    return I.depth_sweep(V.seg(spark, sf), "side", BIN)


@query(V.with_views("seg", {"wide": 'SELECT side, chrom, state, greatest(0, start - 1000) AS start, "end" + 1000 AS "end" FROM seg', "m": _ISL.format(keys="side, state, chrom", src="wide")}, _depth_sql("m")))
def depth_sweep_window(spark, sf):
    return I.depth_sweep(V.seg(spark, sf), "side", BIN, 1000)


_TR = _BINS | {"tr": """SELECT side, p AS from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) OVER w AS p, lag(bin) OVER w AS b FROM lab
    WINDOW w AS (PARTITION BY side, chrom ORDER BY bin)) WHERE bin - b = 1 GROUP BY 1, 2, 3"""}


@query(V.with_views("seg", _TR, "SELECT * FROM tr"))
def transition_counts(spark, sf):
    return I.transitions(I.bin_labels(V.seg(spark, sf), BIN, ["side"]), ["side"])


@query(V.with_views("seg", _TR | {"h": """SELECT side, from_state AS state, sum(-p * log2(p)) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY side, from_state) AS p FROM tr) GROUP BY 1, 2""",
    "l": 'SELECT side, state, sum("end" - start) AS bp FROM seg GROUP BY 1, 2'}, """SELECT side, state, round(coalesce(h, 0.0), 6) AS entropy,
    round(sum(coalesce(h, 0.0) * bp) OVER (PARTITION BY side) / sum(bp) OVER (PARTITION BY side), 6) AS weighted_entropy FROM l LEFT JOIN h USING (side, state)"""))
def transition_entropy(spark, sf):
    s = V.seg(spark, sf)
    return I.transition_entropy(I.transitions(I.bin_labels(s, BIN, ["side"]), ["side"]), I.state_lengths(s, ["side"]), ["side"])


# --- joins by overlap and agreement ----------------------------------------------------------------------------------------


@query(V.with_views("seg", _OV, "SELECT * FROM ov"))
def ovl_join(spark, sf):
    return pair(spark, sf)[0]


@query(V.with_views("peaks", {}, """SELECT a.mark AS mark1, b.mark AS mark2, count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS bp
    FROM peaks a JOIN peaks b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY 1, 2"""))
def ovl_join_bucketed(spark, sf):
    return O.overlaps_within(V.peaks(spark, sf), "mark").toDF("mark1", "mark2", "n", "bp")


@query(V.with_views("peaks", {"m": _ISL.format(keys="mark, chrom", src="peaks"), "sz": 'SELECT mark, sum("end" - start) AS bp FROM peaks GROUP BY 1',
    "sh": """SELECT a.mark AS key1, b.mark AS key2, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS shared FROM m a JOIN m b
    ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.mark < b.mark GROUP BY 1, 2"""}, """SELECT x.mark AS key1, y.mark AS key2,
    CAST(coalesce(shared, 0) AS BIGINT) AS shared, round(coalesce(shared, 0) / (x.bp + y.bp - coalesce(shared, 0)), 6) AS jaccard
    FROM sz x JOIN sz y ON x.mark < y.mark LEFT JOIN sh ON key1 = x.mark AND key2 = y.mark"""))
def region_jaccard(spark, sf):
    return O.region_jaccard(V.peaks(spark, sf), "mark", WIDTH)


@query(V.with_views("seg", _OV, """SELECT l1.state AS state1, l2.state AS state2, round(coalesce(ov.bp, 0) / (l1.bp + l2.bp - coalesce(ov.bp, 0)), 6) AS jaccard
    FROM l1 CROSS JOIN l2 LEFT JOIN ov ON state1 = l1.state AND state2 = l2.state"""))
def jaccard_matrix(spark, sf):
    return rounded(A.jaccard_matrix(*pair(spark, sf)))


@query(V.with_views("seg", _OV | {"g": "SELECT CAST(sum(bp) AS DOUBLE) AS g FROM ov"}, """SELECT state1, state2, round(CASE WHEN p <= 0 OR p >= 1 THEN -1.0 ELSE ln(p / (p1 * p2)) / -ln(p) END, 6) AS npmi
    FROM (SELECT l1.state AS state1, l2.state AS state2, coalesce(ov.bp, 0) / g AS p, l1.bp / g AS p1, l2.bp / g AS p2 FROM l1 CROSS JOIN l2 CROSS JOIN g
    LEFT JOIN ov ON ov.state1 = l1.state AND ov.state2 = l2.state)"""))
def npmi(spark, sf):
    ov, l1, l2 = pair(spark, sf)
    total = ov.agg(F.sum("bp").alias("t")).first().t or 1
    return rounded(A.npmi_matrix(ov, l1, l2, int(total)))


@query(V.with_views("seg", _MARG, """SELECT state, round(coalesce(CAST(ov.bp AS DOUBLE), 0) / (b1 + b2 - coalesce(ov.bp, 0)), 6) AS jaccard,
    round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT state, p12, p1, p2, l1.bp AS b1, l2.bp AS b2, 1 - p1 - p2 + 2 * p12 AS po,
    p1 * p2 + (1 - p1) * (1 - p2) AS pe FROM l1 JOIN l2 USING (state) JOIN mg USING (state)) LEFT JOIN ov ON state1 = state AND state2 = state"""))
def per_state_jaccard_kappa(spark, sf):
    return rounded(A.per_state_agreement(*pair(spark, sf)))


@query(V.with_views("seg", _MARG, "SELECT state, round(2 * (p12 - p1 * p2) / (p1 + p2 - 2 * p1 * p2), 6) AS value FROM mg"))
def per_state_diagonal(spark, sf):
    ov = pair(spark, sf)[0]
    states = [r.state1 for r in ov.select("state1").distinct().collect()]
    return rounded(A.per_state_diagonal(ov, states, "kappa"))


@query(V.with_views("seg", _MARG | {"big": "(SELECT state FROM l1 ORDER BY bp DESC, state LIMIT 1) UNION (SELECT state FROM l2 ORDER BY bp DESC, state LIMIT 1)",
    "cell": "SELECT state1, state2, bp / t AS p, sum(bp) OVER (PARTITION BY state1) / t AS p1, sum(bp) OVER (PARTITION BY state2) / t AS p2 FROM ov, tot WHERE bp > 0"}, """
    SELECT (SELECT round((sum(p12) - sum(p1 * p2)) / (1 - sum(p1 * p2)), 6) FROM mg) AS kappa,
    (SELECT round(avg(coalesce(CAST(ov.bp AS DOUBLE), 0) / (l1.bp + l2.bp - coalesce(ov.bp, 0))), 6) FROM l1 JOIN l2 USING (state) LEFT JOIN ov ON state1 = l1.state AND state2 = l1.state) AS jaccard,
    (SELECT round(sum(CAST(l1.bp AS DOUBLE) * l2.bp) / sqrt(sum(CAST(l1.bp AS DOUBLE) * l1.bp) * sum(CAST(l2.bp AS DOUBLE) * l2.bp)), 6) FROM l1 JOIN l2 USING (state) WHERE state NOT IN (SELECT state FROM big)) AS cosine,
    (SELECT round(mi / ((h1 + h2) / 2), 6) FROM (SELECT sum(p * ln(p / (p1 * p2))) AS mi FROM cell), (SELECT sum(-q * ln(q)) AS h1 FROM (SELECT state1, first(p1) AS q FROM cell GROUP BY 1)),
    (SELECT sum(-q * ln(q)) AS h2 FROM (SELECT state2, first(p2) AS q FROM cell GROUP BY 1))) AS ami"""))
def agreement_metrics(spark, sf):
    return rounded(A.agreement_metrics(*pair(spark, sf)))


@query(V.with_views("seg", _MARG, "SELECT round((sum(p12) - sum(p1 * p2)) / (1 - sum(p1 * p2)), 6) AS kappa FROM mg"))
def kappa(spark, sf):
    return rounded(A.kappa(pair(spark, sf)[0]))


@query(V.with_views("seg", _OV, "SELECT round(CAST(sum(CASE WHEN state1 = state2 THEN bp ELSE 0 END) AS DOUBLE) / (SELECT sum(bp) FROM l1), 6) AS fraction FROM ov"))
def overlap_fraction(spark, sf):
    ov, l1, _ = pair(spark, sf)
    return rounded(A.overlap_fraction(ov, l1))


_MAP = """SELECT DISTINCT state, CASE WHEN length(state) % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM seg"""


def _label_map(spark, sf):
    return V.seg(spark, sf).select("state", F.when(F.length("state") % 2 == 0, "even").otherwise("odd").alias("label")).distinct()


@query(V.with_views("seg", _OV | {"m": _MAP}, """SELECT round(CAST(sum(CASE WHEN a.label = b.label THEN bp ELSE 0 END) AS DOUBLE) / sum(bp), 6) AS accuracy
    FROM ov JOIN m a ON a.state = state1 JOIN m b ON b.state = state2"""))
def relabelled_accuracy(spark, sf):
    m = _label_map(spark, sf)
    return rounded(A.relabelled_accuracy(pair(spark, sf)[0], m, m))


@query(V.with_views("seg", _OV | {"m": f"SELECT * FROM ({_MAP}) WHERE label = 'even'"}, """SELECT coalesce(a.label, 'Quiescent') AS state1, coalesce(b.label, 'Quiescent') AS state2, CAST(sum(bp) AS BIGINT) AS bp
    FROM ov LEFT JOIN m a ON a.state = state1 LEFT JOIN m b ON b.state = state2 GROUP BY 1, 2"""))
def type_agreement(spark, sf):
    m = _label_map(spark, sf).where("label = 'even'")
    return A.folded(pair(spark, sf)[0], m, m)


_CONF = _BINS | {"cf": "SELECT a.state AS state1, b.state AS state2, count(*) AS n FROM lab a JOIN lab b USING (chrom, bin) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2"}


def _labels(spark, sf):
    return (I.bin_labels(s, BIN) for s in sides(spark, sf))


@query(V.with_views("seg", _CONF, "SELECT * FROM cf"))
def bin_confusion(spark, sf):
    return A.confusion(*_labels(spark, sf))


@query(V.with_views("seg", _CONF | {"t": "SELECT sum(n) AS t FROM cf", "m": """SELECT state, CAST(coalesce(n12, 0) AS DOUBLE) / t AS p12, CAST(coalesce(n1, 0) AS DOUBLE) / t AS p1, CAST(coalesce(n2, 0) AS DOUBLE) / t AS p2 FROM
    (SELECT state1 AS state, sum(n) AS n1 FROM cf GROUP BY 1) FULL JOIN (SELECT state2 AS state, sum(n) AS n2 FROM cf GROUP BY 1) USING (state)
    LEFT JOIN (SELECT state1 AS state, n AS n12 FROM cf WHERE state1 = state2) USING (state), t"""}, """SELECT state, CAST(t AS BIGINT) AS n_bins, round(p12 / (p1 + p2 - p12), 6) AS jaccard, round(sum(p12) OVER (), 6) AS po,
    round(sum(p1 * p2) OVER (), 6) AS pe, round((sum(p12) OVER () - sum(p1 * p2) OVER ()) / (1 - sum(p1 * p2) OVER ()), 6) AS kappa FROM m, t"""))
def confusion_metrics(spark, sf):
    return rounded(A.confusion_metrics(A.confusion(*_labels(spark, sf))))


@query("""WITH v AS (SELECT l_returnflag AS a, l_linestatus AS b, round(avg(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem GROUP BY 1, 2)
    SELECT coalesce(v.a, s.b) AS a, coalesce(v.b, s.a) AS b, coalesce(v.value, s.value) AS value FROM v FULL JOIN v s ON v.a = s.b AND v.b = s.a""")
def combine_first(spark, sf):
    v = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("value"))
    return A.combine_first(v)


# --- patterns -------------------------------------------------------------------------------------------------------------


def _sizes(spark, sf):
    return V.peaks(spark, sf).groupBy("chrom").agg(F.max("end").alias("size"))


def _bits(spark, sf):
    return B.binarize(V.peaks(spark, sf), _sizes(spark, sf), 100)


def _codes(spark, sf):
    return B.codes(_bits(spark, sf), MARKS)


_BIT = {"bits": 'SELECT DISTINCT chrom, unnest(range(start // 100, ("end" + 99) // 100)) AS bin, mark FROM peaks',
        "cd": "SELECT chrom, bin, CAST(bit_or(1 << CAST(list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], mark) - 1 AS BIGINT)) AS BIGINT) AS code FROM bits GROUP BY 1, 2"}


@query(V.with_views("peaks", _BIT, "SELECT * FROM bits"))
def binarize(spark, sf):
    return _bits(spark, sf)


@query(V.with_views("peaks", _BIT, "SELECT code, count(*) AS n, CAST(bit_count(code) AS INTEGER) AS n_marks FROM cd GROUP BY 1"))
def patterns(spark, sf):
    return B.patterns(_codes(spark, sf))


@query(V.with_views("peaks", _BIT, "SELECT DISTINCT code, " + ", ".join(f"CAST((code >> {j}) & 1 AS INTEGER) AS b{j}" for j in range(6)) + " FROM cd"))
def pattern_bits(spark, sf):
    rows = _codes(spark, sf).select("code").distinct().withColumn("v", B.bits_of(F.col("code"), 6))
    return rows.select("code", *(F.get("v", F.lit(j)).alias(f"b{j}") for j in range(6)))


@query(V.with_views("peaks", _BIT, """SELECT mark, chrom, min(bin) * 100 AS start, (max(bin) + 1) * 100 AS "end" FROM
    (SELECT *, bin - row_number() OVER (PARTITION BY mark, chrom ORDER BY bin) AS i FROM bits) GROUP BY 1, 2, i"""))
def mark_runs(spark, sf):
    return I.runs(_bits(spark, sf), 100, value="mark").select("mark", "chrom", "start", "end")


@query(V.with_views("peaks", _BIT | {"c": "SELECT d, coalesce(n, 0) AS n FROM range(1, 7) t(d) LEFT JOIN (SELECT bit_count(code) AS k, count(*) AS n FROM cd GROUP BY 1) ON k = d"},
    "SELECT CAST(d AS INTEGER) AS depth, CAST(sum(n) OVER (ORDER BY d DESC) AS BIGINT) AS bins, round(sum(n) OVER (ORDER BY d DESC) / sum(n) OVER (), 6) AS share FROM c"))
def mark_coverage(spark, sf):
    return B.coverage_by_depth(_codes(spark, sf), 6)


@query(V.with_views("peaks", _BIT | {"c": "SELECT d, coalesce(n, 0) AS n FROM range(1, 7) t(d) LEFT JOIN (SELECT bit_count(code) AS k, count(DISTINCT code) AS n FROM cd GROUP BY 1) ON k = d"},
    "SELECT CAST(d AS INTEGER) AS depth, CAST(n AS BIGINT) AS n, round(n / (factorial(6) / (factorial(CAST(d AS INTEGER)) * factorial(CAST(6 - d AS INTEGER)))), 6) AS share, round(sum(n) OVER () / 63, 6) AS usage FROM c"))
def mark_combinations(spark, sf):
    return B.combinations_by_depth(_codes(spark, sf), 6)


# --- enrichment, genes, emissions -------------------------------------------------------------------------------------------


def _enrich_sql(seg: str, genome: str = '(SELECT CAST(sum("end" - start) AS DOUBLE) FROM s)', digits: int = 6) -> dict[str, str]:
    return {
        "m": _ISL.format(keys="label, chrom", src="ann"),
        "s": seg,
        "ov": """SELECT a.state, b.label, a.chrom, a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2, least(a."end", b."end") - greatest(a.start, b.start) AS bp
            FROM s a JOIN m b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end\"""",
        "h": "SELECT state, label, sum(bp) AS shared, sum(CASE WHEN 2 * bp >= e2 - s2 THEN 1 ELSE 0 END) AS hl FROM (SELECT state, label, chrom, s2, e2, sum(bp) AS bp FROM ov GROUP BY ALL) GROUP BY 1, 2",
        "g": "SELECT state, label, sum(CASE WHEN 2 * bp >= e1 - s1 THEN 1 ELSE 0 END) AS hs FROM (SELECT state, label, chrom, s1, e1, sum(bp) AS bp FROM ov GROUP BY ALL) GROUP BY 1, 2",
        "st": 'SELECT state, sum("end" - start) AS sbp, count(*) AS ns FROM s GROUP BY 1',
        "lb": 'SELECT label, sum("end" - start) AS lbp, count(*) AS nl FROM m GROUP BY 1',
        "out": f"""SELECT state, label, round(coalesce(shared, 0) / sbp, 6) AS coverage, round(coalesce(shared, 0) / sbp / (lbp / {genome}), {digits}) AS fold,
            round(coalesce(shared, 0) / (sbp + lbp - coalesce(shared, 0)), 6) AS jaccard, round(coalesce(shared, 0) / lbp, 6) AS sensitivity,
            round(CAST(coalesce(hl, 0) AS DOUBLE) / nl, 6) AS sensitivity_50, round(CAST(coalesce(hs, 0) AS DOUBLE) / ns, 6) AS coverage_50
            FROM st CROSS JOIN lb LEFT JOIN h USING (state, label) LEFT JOIN g USING (state, label)""",
    }


@query(V.with_views("seg ann", _enrich_sql('SELECT chrom, start, "end", state FROM seg WHERE side = 0'), "SELECT * FROM out"))
def enrichment(spark, sf):
    return R.enrichment(sides(spark, sf)[0], V.ann(spark, sf), WIDTH)


_FAM = [("A", "click"), ("A", "view"), ("B", "view"), ("B", "purchase")]


@query(V.with_views("seg ann", {"f": "SELECT * FROM (VALUES " + ", ".join(map(str, _FAM)) + ") t(family, fs)"} | _enrich_sql(
    "SELECT chrom, start, \"end\", 'POOL:' || family AS state FROM seg JOIN f ON fs = state WHERE side = 0"),
    "SELECT state, label, coverage, jaccard, sensitivity, sensitivity_50, coverage_50 FROM out"))
def enrichment_families(spark, sf):
    fam = spark.createDataFrame(_FAM, "family string, state string")
    return R.family_enrichment(sides(spark, sf)[0], V.ann(spark, sf), fam, WIDTH).drop("fold")


@query(V.with_views("genes", {}, "SELECT gene_id, base_id, tpm, ord FROM genes WHERE tpm > 0 ORDER BY tpm DESC, ord LIMIT 100"))
def top_n_genes(spark, sf):
    return G.top_expressed(V.genes(spark, sf).select("gene_id", "tpm", "ord"), V.genes(spark, sf).select("gene_id"), 100)


@query(V.with_views("genes", {}, """SELECT g.gene_id, coalesce(x.tpm, y.tpm, 0.0) AS tpm FROM (SELECT base_id || '.9' AS gene_id, base_id FROM genes WHERE ord % 3 = 0 UNION ALL SELECT gene_id, base_id FROM genes WHERE ord % 3 <> 0) g
    LEFT JOIN genes x ON x.gene_id = g.gene_id LEFT JOIN (SELECT base_id, max(tpm) AS tpm FROM genes GROUP BY 1) y ON y.base_id = g.base_id"""))
def gene_lookup(spark, sf):
    g = V.genes(spark, sf)
    model = g.select(F.when(F.col("ord") % 3 == 0, F.concat("base_id", F.lit(".9"))).otherwise(F.col("gene_id")).alias("gene_id"), F.lit("none").alias("gene_name"))
    return G.lookup_tpm(model, g.select("gene_id", "tpm", "ord")).select("gene_id", "tpm")


@query(V.with_views("genes", {"t": "SELECT gene_id FROM genes WHERE tpm > 0 ORDER BY tpm DESC, ord LIMIT 200", "k": """SELECT CASE WHEN gene_id IN (SELECT gene_id FROM t) THEN 'expressed' WHEN tpm <= 0.1 THEN 'quiet' END AS kind, chrom, start, "end",
    CASE WHEN strand = '+' THEN start ELSE "end" - 1 END AS p FROM genes"""}, """SELECT kind || '_body' AS label, chrom, start, "end" FROM k WHERE kind IS NOT NULL UNION ALL SELECT kind || '_tss', chrom, p, p + 1 FROM k WHERE kind IS NOT NULL
    UNION ALL SELECT kind || '_flank', chrom, greatest(0, p - 2000), p + 2001 FROM k WHERE kind IS NOT NULL"""))
def expression_annotations(spark, sf):
    g = V.genes(spark, sf)
    return G.expression_annotations(g, G.top_expressed(g.select("gene_id", "tpm", "ord"), n=200))


_MB = {"bits": f'SELECT DISTINCT chrom, unnest(range(start // {COARSE}, ("end" + {COARSE - 1}) // {COARSE})) AS bin, mark FROM marks_t',
       "eb": f'SELECT chrom, state, unnest(range(start // {COARSE}, ("end" + {COARSE - 1}) // {COARSE})) AS bin FROM seg WHERE side = 0'}


@query(V.with_views("seg marks_t", _MB, """SELECT state, mark, round(CAST(coalesce(n, 0) AS DOUBLE) / t, 6) AS value FROM (SELECT state, count(*) AS t FROM eb GROUP BY 1) CROSS JOIN (SELECT DISTINCT mark FROM bits)
    LEFT JOIN (SELECT state, mark, count(*) AS n FROM eb JOIN bits USING (chrom, bin) GROUP BY 1, 2) USING (state, mark)"""))
def bin_emissions(spark, sf):
    m = V.marks_t(spark, sf)
    far = m.groupBy("chrom").agg(F.max("end").alias("size"))
    return rounded(E.bin_emissions(sides(spark, sf)[0], B.binarize(m, far, COARSE), COARSE))


@query(V.with_views("seg ann", {"s": f'SELECT * FROM seg WHERE side = 0 AND "end" - start >= {BIN}', "sg": """SELECT chrom, start, "end", label AS mark, CAST(start % 17 AS DOUBLE) AS value FROM ann""",
    "p": """SELECT a.state, b.mark, a."end" - a.start AS n, sum(value * (least(a."end", b."end") - greatest(a.start, b.start))) / sum(least(a."end", b."end") - greatest(a.start, b.start)) AS mean
    FROM s a JOIN sg b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY a.chrom, a.start, a."end", a.state, b.mark"""}, f"""SELECT state, mark, round(sum(mean * n) / any_value(d), 6) AS value
    FROM p JOIN (SELECT state, sum(("end" - start) // {BIN} * {BIN}) AS d FROM s GROUP BY 1) USING (state) GROUP BY 1, 2"""))
def signal_emissions(spark, sf):
    signal = V.ann(spark, sf).select("chrom", "start", "end", F.col("label").alias("mark"), (F.col("start") % 17).cast("double").alias("value"))
    return rounded(E.signal_emissions(sides(spark, sf)[0], signal, BIN, width=WIDTH))


_COS = """SELECT a.state AS state1, b.state AS state2, coalesce(sum(a.value * b.value) / nullif(sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 0), 0.0) AS cosine
    FROM {0} a JOIN {0} b USING (mark) GROUP BY 1, 2"""


@query(V.with_views("emis", {"c": _COS.format("emis")}, "SELECT state1, state2, round(cosine, 5) AS cosine FROM c"))
def emission_cosine(spark, sf):
    v = E.vectors(V.emis(spark, sf))
    return rounded(E.cosine_matrix(v, v), 5)


_SC = {"x": "SELECT state, mark, ln(1 + greatest(value, 0)) AS x FROM emis",
       "sc": """SELECT state, mark, least(greatest(coalesce((x - median(x) OVER (PARTITION BY mark)) / nullif(max(x) OVER (PARTITION BY mark) - median(x) OVER (PARTITION BY mark), 0), 0), 0), 1) AS value FROM x"""}


@query(V.with_views("emis", _SC, "SELECT state, mark, round(value, 5) AS value FROM sc"))
def emission_scaled(spark, sf):
    return rounded(E.scaled(V.emis(spark, sf)), 5)


@query(V.with_views("emis", _SC | {"ag": "SELECT * FROM sc UNION ALL SELECT state, 'zz', 1 - max(value) FROM sc GROUP BY 1", "c": _COS.format("ag")}, "SELECT state1, state2, round(cosine, 4) AS cosine FROM c"))
def emission_similarity(spark, sf):
    e = V.emis(spark, sf)
    return rounded(E.similarity(e, e, (False, False)), 4)


@query(V.with_views("emis", {"c": _COS.format("emis")}, "SELECT round(avg(cosine), 5) AS mean, round(stddev_pop(cosine), 5) AS std, count(*) AS n FROM c WHERE state1 < state2"))
def pairwise_cosine(spark, sf):
    return rounded(E.pairwise_cosine(E.vectors(V.emis(spark, sf))), 5)


@query(V.with_views("emis", {}, """SELECT state, round(2 * sum(i * a) / (count(*) * sum(a)) - (count(*) + 1.0) / count(*), 5) AS gini FROM
    (SELECT state, abs(value) AS a, row_number() OVER (PARTITION BY state ORDER BY abs(value)) AS i FROM emis) GROUP BY 1"""))
def gini(spark, sf):
    return rounded(E.vectors(V.emis(spark, sf)).select("state", E.gini(F.col("vec")).alias("gini")), 5)


@query(V.with_views("emis", {}, """SELECT state, mark, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 1.0 / count(*) OVER w), 5) AS value FROM emis WINDOW w AS (PARTITION BY mark)"""))
def minmax_scale(spark, sf):
    return rounded(E.minmax(V.emis(spark, sf)), 5)


# --- matching, clustering (rows only) ----------------------------------------------------------------------------------------


def _best(gain: str, columns: str) -> str:
    """SQL of the one-to-one assignment of greatest total gain of a grid (state1, state2, gain) of few states, by trying all."""
    return f"""WITH RECURSIVE {{views}}, gr AS ({gain}), o AS (SELECT state1, row_number() OVER (ORDER BY state1) AS i FROM (SELECT DISTINCT state1 FROM gr)),
        pm(i, used, total) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0.0 AS DOUBLE) UNION ALL SELECT o.i, list_append(pm.used, gr.state2), pm.total + gr.gain
            FROM pm JOIN o ON o.i = pm.i + 1 JOIN gr ON gr.state1 = o.state1 AND NOT list_contains(pm.used, gr.state2)),
        top AS (SELECT used FROM pm WHERE i = (SELECT max(i) FROM o) ORDER BY total DESC LIMIT 1)
        SELECT {columns} FROM o, top JOIN gr ON gr.state1 = o.state1 AND gr.state2 = top.used[o.i]"""


def _over(names: str, more: dict[str, str], body: str) -> str:
    return body.replace("{views}", V.with_views(names, more, "").removeprefix("WITH ").rstrip())


@query(_over("seg", _OV, _best("SELECT state1, state2, CAST(bp AS DOUBLE) AS gain FROM ov", "gr.state1, gr.state2, gr.gain AS bp")))
def best_mapping(spark, sf):
    return M.best_mapping(pair(spark, sf)[0])


@query(_over("seg", _OV, _best("""SELECT l1.state AS state1, l2.state AS state2, coalesce(ov.bp, 0) / (l1.bp + l2.bp - coalesce(ov.bp, 0)) AS jaccard,
    sqrt(coalesce(ov.bp, 0) / (l1.bp + l2.bp - coalesce(ov.bp, 0))) AS gain FROM l1 CROSS JOIN l2 LEFT JOIN ov ON ov.state1 = l1.state AND ov.state2 = l2.state""",
    "gr.state1 AS work_state, gr.state2 AS ref_state, round(jaccard, 6) AS jaccard, CAST(NULL AS DOUBLE) AS emission, round(jaccard, 6) AS quality")))
def match_states(spark, sf):
    ov, l1, l2 = pair(spark, sf)
    return rounded(M.match_states(ov, l1, l2))


# of a table with itself, where no two states are alike, the best assignment is the identity
@query(V.with_views("emis", {}, "SELECT CAST(1.0 AS DOUBLE) AS cosine, count(DISTINCT state) AS n FROM emis"))
def emission_match(spark, sf):
    v = E.vectors(V.emis(spark, sf))
    return rounded(M.emission_mapping(E.cosine_matrix(E.augmented(v), E.augmented(v)), E.cosine_matrix(v, v)))


@query()
def kmeans_states(spark, sf):
    return C.kmeans_patterns(B.patterns(_codes(spark, sf)).select("code", "n"), 6, 5)


@query()
def joint_kmeans(spark, sf):
    cells = V.peaks(spark, sf).withColumn("cell", F.when(F.expr("start div 100 % 2 = 0"), "c0").otherwise("c1"))
    coded = B.codes(B.joint_bits(cells, _sizes(spark, sf), 100), MARKS, by=["cell"])
    labels = C.kmeans_patterns(B.patterns(coded).select("code", "n"), 6, 4)
    return I.runs(C.label_bins(coded, labels), 100, by=["cell"]).groupBy("cell", "state").agg(F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("""WITH n AS (SELECT s_suppkey AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM (SELECT DISTINCT s_suppkey FROM supplier)),
    t AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS total FROM n), pr AS (SELECT a.name AS a, b.name AS b, row_number() OVER (ORDER BY a.i, b.i) - 1 AS p FROM n a JOIN n b ON a.i < b.i),
    d AS (SELECT p, min(k) AS k FROM (SELECT k, CAST('0x' || substr(md5('42:' || k), 1, 15) AS BIGINT) % total AS p FROM range(0, 1600) r(k), t) GROUP BY 1 ORDER BY 2 LIMIT 200)
    SELECT a, b FROM pr, t WHERE total <= 200 OR p IN (SELECT p FROM d)""")
def sampled_pairs(spark, sf):
    return S.sample_pairs(V.table(spark, sf, "supplier"), "s_suppkey", 200)


# --- interpretation -----------------------------------------------------------------------------------------------------------

_CHROM_MARKS = ["H3K4me3", "H3K27ac", "H3K4me1", "H3K36me3", "H3K27me3", "H3K9me3"]


def _chrom_emis(spark, sf):
    """Emissions with chromatin marks' names and values of 0 to 1."""
    m = F.create_map(*(F.lit(x) for j, n in enumerate(_CHROM_MARKS) for x in (f"m{j}", n)))
    return E.minmax(V.emis(spark, sf)).select("state", F.element_at(m, F.col("mark")).alias("mark"), F.round("value", 4).alias("value"))


_INT = {
    "ce": "SELECT state, CASE mark " + " ".join(f"WHEN 'm{j}' THEN '{n}'" for j, n in enumerate(_CHROM_MARKS)) + """ END AS mark,
        round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 1.0 / count(*) OVER w), 4) AS value FROM emis WINDOW w AS (PARTITION BY mark)""",
    "rl": "SELECT state, mark, value, least(greatest(value / greatest(max(value) OVER (PARTITION BY mark), 0.2), 0), 1) AS r FROM ce",
    "ev": """SELECT state, max(r) AS mm, max(value) AS mr, max(r) FILTER (mark = 'H3K4me3') AS prom, (sum(r) FILTER (mark IN ('H3K27ac', 'H3K4me1'))) / 2 AS enh, max(r) FILTER (mark = 'H3K27ac') AS ac,
        max(r) FILTER (mark = 'H3K36me3') AS tx, max(r) FILTER (mark = 'H3K27me3') AS facu, max(r) FILTER (mark = 'H3K9me3') AS cons FROM rl GROUP BY 1""",
    "sc": "SELECT *, 0.6 * prom AS s1, enh AS s2, 0.7 * tx AS s3, facu AS s4, cons AS s5, greatest(0.6 * prom, enh, 0.7 * tx, facu, cons) AS top, greatest(ac, prom) AS act FROM ev",
    "fm": """SELECT *, CASE WHEN mm < 0.15 AND mr < 0.15 THEN 'Quiescent' WHEN cons >= 0.5 AND tx >= 0.5 THEN 'K9K36' WHEN facu >= 0.35 AND act >= 0.5 THEN 'Bivalent' WHEN top < 0.05 THEN 'Quiescent'
        WHEN s1 = top THEN 'Promoter' WHEN s2 = top THEN 'Enhancer' WHEN s3 = top THEN 'Transcribed' WHEN s4 = top THEN 'FacultativeHet' ELSE 'ConstitutiveHet' END AS family FROM sc""",
}


@query(V.with_views("emis", _INT, """SELECT state, family, CASE WHEN family = 'Promoter' THEN CASE WHEN s1 >= greatest(0.6 * max(s1) OVER (PARTITION BY family), 0.5) THEN 'Promoter' ELSE 'PromoterFlanking' END
    WHEN family = 'Enhancer' THEN CASE WHEN s2 >= greatest(0.6 * max(s2) OVER (PARTITION BY family), 0.5) THEN 'Enhancer' ELSE 'EnhancerLow' END ELSE family END AS type,
    round(CASE WHEN family = 'Quiescent' THEN 1 - mm WHEN family = 'K9K36' THEN least(cons, tx) WHEN family = 'Bivalent' THEN least(facu, act) ELSE top END, 4) AS strength FROM fm"""))
def interpretation(spark, sf):
    return rounded(P.interpret(P.state_evidence(_chrom_emis(spark, sf))).select("state", "family", "type", "strength"), 4)


# --- scoring --------------------------------------------------------------------------------------------------------------------


def _points(spark, sf):
    """Sweep points by method, made of discounts and taxes."""
    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_linenumber")).cast("long").alias("threshold"))
    p = t.agg(F.round(F.avg(F.col("l_tax").cast("double")) * 10, 6).alias("fpr"), F.round(F.avg(F.col("l_quantity").cast("double")) / 50, 6).alias("tpr"), F.round(F.avg(F.col("l_discount").cast("double")) * 10, 6).alias("precision"))
    return p.withColumn("f1", F.round(2 * F.col("tpr") * F.col("precision") / (F.col("tpr") + F.col("precision")), 6)).withColumn("is_default", F.col("threshold") == 3)


_PT = {"p0": """SELECT l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS threshold, round(avg(CAST(l_tax AS DOUBLE)) * 10, 6) AS fpr, round(avg(CAST(l_quantity AS DOUBLE)) / 50, 6) AS tpr,
    round(avg(CAST(l_discount AS DOUBLE)) * 10, 6) AS precision FROM lineitem GROUP BY 1, 2""", "p": "SELECT *, round(2 * tpr * precision / (tpr + precision), 6) AS f1 FROM p0"}


@query(V.with_views("", _PT | {"q": "SELECT method, fpr, tpr FROM p UNION ALL SELECT DISTINCT method, 0.0, 0.0 FROM p UNION ALL SELECT DISTINCT method, 1.0, 1.0 FROM p"}, """SELECT method, round(sum(a), 6) AS auc FROM
    (SELECT method, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM q WINDOW w AS (PARTITION BY method ORDER BY fpr, tpr)) GROUP BY 1"""))
def roc_auc(spark, sf):
    return rounded(S.auc(_points(spark, sf), ["method"]))


@query(V.with_views("", _PT, """SELECT method, round(sum(s), 6) AS average_precision FROM (SELECT method, (tpr - lag(tpr, 1, 0.0) OVER (PARTITION BY method ORDER BY tpr, precision DESC)) * precision AS s FROM p) GROUP BY 1"""))
def average_precision(spark, sf):
    return rounded(S.average_precision(_points(spark, sf), ["method"]))


@query(V.with_views("", _PT, """SELECT method, max(f1) AS best_f1, arg_max(threshold, (f1, -threshold)) AS threshold, max(CASE WHEN threshold = 3 THEN f1 END) AS default_f1, round(avg(f1), 6) AS mean_f1 FROM p GROUP BY 1"""))
def best_f1(spark, sf):
    return rounded(S.best_f1(_points(spark, sf), ["method"]))


@query(V.with_views("seg ann", {"c": _ISL.format(keys="chrom", src="(SELECT * FROM seg WHERE side = 0 AND state IN ('click', 'view'))"), "t": _ISL.format(keys="chrom", src="ann"),
    "x": """SELECT sum(least(c."end", t."end") - greatest(c.start, t.start)) AS tp FROM c JOIN t ON c.chrom = t.chrom AND c.start < t."end" AND t.start < c."end\"""",
    "y": """SELECT CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce((SELECT sum("end" - start) FROM c), 0) AS DOUBLE) AS c, CAST((SELECT sum("end" - start) FROM t) AS DOUBLE) AS t FROM x"""},
    f"""SELECT round(coalesce(tp / nullif(t, 0), 0), 6) AS tpr, round(coalesce((c - tp) / ({5 * V.SPAN} - t), 0), 6) AS fpr, round(coalesce(tp / nullif(c, 0), 0), 6) AS precision,
    round(coalesce(2 * (tp / t) * (tp / c) / nullif(tp / t + tp / c, 0), 0), 6) AS f1 FROM y"""))
def sweep_points(spark, sf):
    return R.sweep_point(sides(spark, sf)[0], V.ann(spark, sf).select("chrom", "start", "end"), ["click", "view"], 5 * V.SPAN, WIDTH)


@query(V.with_views("evidence", {}, """SELECT method, axis, cell, value, round(CASE WHEN count(*) OVER u > 1 AND max(value) OVER u > min(value) OVER u THEN
    1 - (rank() OVER (PARTITION BY axis, cell ORDER BY CASE WHEN axis = 'tax' THEN value ELSE -value END) - 1.0) / (count(*) OVER u - 1) END, 6) AS score FROM evidence WINDOW u AS (PARTITION BY axis, cell)"""))
def rank_in_unit(spark, sf):
    return rounded(S.rank_scores(V.evidence(spark, sf), ["axis", "cell"], high=F.col("axis") != "tax"))


_RK = {"sc": """SELECT method, axis, cell, 1 - (rank() OVER (PARTITION BY axis, cell ORDER BY value DESC) - 1.0) / (count(*) OVER (PARTITION BY axis, cell) - 1) AS score FROM evidence""",
       "w": "SELECT * FROM (VALUES ('discount', 1.0), ('tax', 0.5), ('quantity', 2.0)) t(axis, weight)"}


@query(V.with_views("evidence", _RK, """SELECT *, row_number() OVER (ORDER BY total DESC, method) AS rank FROM (SELECT method, round(sum(weight * s) / sum(weight), 6) AS total, count(*) AS n_axes FROM
    (SELECT method, axis, avg(score) AS s FROM sc WHERE method <> 'RF' GROUP BY 1, 2) JOIN w USING (axis) GROUP BY 1)"""))
def weighted_ranking(spark, sf):
    w = spark.createDataFrame([("discount", 1.0), ("tax", 0.5), ("quantity", 2.0)], "axis string, weight double")
    got = S.weighted_ranking(S.rank_scores(V.evidence(spark, sf), ["axis", "cell"]), w, ["RF"])
    return rounded(got).withColumn("rank", F.col("rank").cast("long"))


@query(V.with_views("evidence", _RK | {"t": "SELECT method, avg(score) FILTER (axis = 'discount') AS d, avg(score) FILTER (axis = 'tax') AS t, avg(score) FILTER (axis = 'quantity') AS quantity FROM sc GROUP BY 1"},
    "SELECT method, round(quantity, 6) AS quantity, round((d + t) / 2, 6) AS rates FROM t"))
def axis_table(spark, sf):
    t = S.axis_table(S.rank_scores(V.evidence(spark, sf), ["axis", "cell"]), list(V.AXES))
    return rounded(S.fold_axes(t, "rates", ["discount", "tax"])).select("method", "quantity", "rates")


@query(V.with_views("evidence", {}, "SELECT method, axis, round(stddev_samp(value) / avg(value), 6) AS cv, round(var_samp(value), 6) AS var, count(*) AS n FROM evidence GROUP BY 1, 2"))
def cv_stability(spark, sf):
    return rounded(S.stability(V.evidence(spark, sf), ["method", "axis"]))


@query(V.with_views("evidence", {}, "SELECT axis, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM evidence GROUP BY 1"))
def mean_error(spark, sf):
    return rounded(S.mean_error(V.evidence(spark, sf), ["axis"]))


@query(V.with_views("evidence", {}, """SELECT e.axis, method, cell, value, round(lo, 4) AS p_low, round(hi, 4) AS p_high FROM evidence e JOIN (SELECT axis, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM evidence GROUP BY 1) p
    ON p.axis = e.axis WHERE value < lo OR value > hi"""))
def percentile_outliers(spark, sf):
    got = S.outliers(V.evidence(spark, sf), ["axis"])
    return got.withColumn("p_low", F.round("p_low", 4)).withColumn("p_high", F.round("p_high", 4))


_US = {"u": """SELECT 'd' || (user_id % 3) AS dataset, 's' || user_id AS segmentation, CAST(sum(floor(value)) AS BIGINT) AS covered, count(DISTINCT event_type) AS n_states FROM events GROUP BY 1, 2"""}


def _cover(spark, sf):
    e = V.table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("segmentation")).agg(
        F.sum(F.floor("value")).cast("long").alias("covered"), F.countDistinct("event_type").alias("n_states")
    )


@query(V.with_views("", _US, """SELECT dataset, segmentation, concat_ws('; ', CASE WHEN thin THEN 'covers too little' END, CASE WHEN n_states < 4 THEN n_states || ' states' END) AS reason
    FROM (SELECT *, covered < 0.5 * median(covered) OVER (PARTITION BY dataset) AS thin FROM u) WHERE thin OR n_states < 4"""))
def unusable_gate(spark, sf):
    return S.unusable(_cover(spark, sf), min_states=4)


@query(V.with_views("", _US | {"bad": "SELECT * FROM (SELECT *, covered < 0.5 * median(covered) OVER (PARTITION BY dataset) AS thin FROM u) WHERE thin OR n_states < 4"},
    """SELECT u.dataset, u.segmentation FROM u ANTI JOIN bad ON u.dataset = bad.dataset AND u.segmentation = bad.segmentation"""))
def without_unusable(spark, sf):
    c = _cover(spark, sf)
    return S.without_unusable(c, S.unusable(c, min_states=4)).select("dataset", "segmentation")


@query("""WITH v AS (SELECT l_returnflag AS method, l_suppkey AS unit, round(avg(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem WHERE l_linestatus = 'F' OR l_suppkey % 2 = 0 GROUP BY 1, 2)
    SELECT method, round(avg(value), 6) AS mean, count(*) AS n FROM v WHERE unit IN (SELECT unit FROM v GROUP BY 1 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM v)) GROUP BY 1""")
def common_units(spark, sf):
    return rounded(S.common_units(_units(spark, sf), ["unit"]))


def _units(spark, sf):
    t = V.table(spark, sf, "lineitem").where("l_linestatus = 'F' or l_suppkey % 2 = 0")
    return t.groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("unit")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("value"))


@query("""WITH v AS (SELECT l_returnflag AS method, l_suppkey AS unit, round(avg(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem WHERE l_linestatus = 'F' OR l_suppkey % 2 = 0 GROUP BY 1, 2),
    c AS (SELECT unit FROM v GROUP BY 1 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM v)), d AS (SELECT v.method, v.value - b.value AS delta FROM v JOIN c USING (unit) JOIN v b ON b.unit = v.unit AND b.method = 'A' WHERE v.method <> 'A')
    SELECT method, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, count(*) FILTER (delta > 1e-12) AS better, count(*) FILTER (delta < -1e-12) AS worse,
    round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS wins FROM d GROUP BY 1""")
def paired_delta(spark, sf):
    return rounded(S.delta_summary(S.paired_deltas(_units(spark, sf), ["unit"], "A")))


@query("""WITH r AS (SELECT event_type AS state, user_id AS pair, avg(value) AS value FROM events GROUP BY 1, 2), f AS (SELECT * FROM (VALUES ('click', 'x'), ('view', 'x'), ('purchase', 'y')) t(state, family))
    SELECT family, round(avg(v), 6) AS mean, count(*) AS n_pairs FROM (SELECT pair, family, avg(value) AS v FROM r JOIN f USING (state) GROUP BY 1, 2) GROUP BY 1""")
def family_fold(spark, sf):
    rows = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("state"), F.col("user_id").alias("pair")).agg(F.avg("value").alias("value"))
    fam = spark.createDataFrame([("click", "x"), ("view", "x"), ("purchase", "y")], "state string, family string")
    return rounded(S.family_fold(rows, fam, ["pair"]))


@query(V.with_views("seg", {}, """SELECT side, round(CAST(sum(CASE WHEN state LIKE 'v%' THEN "end" - start ELSE 0 END) AS DOUBLE) / sum("end" - start), 6) AS quiescent,
    round(1 - CAST(sum(CASE WHEN state LIKE 'v%' THEN "end" - start ELSE 0 END) AS DOUBLE) / sum("end" - start), 6) AS annotated FROM seg GROUP BY 1"""))
def annotated_share(spark, sf):
    return rounded(S.quiet_share(V.seg(spark, sf), ["side"], F.col("state").startswith("v")))


@query(V.with_views("seg", {"c": 'SELECT side, state, sum("end" - start) / sum(sum("end" - start)) OVER (PARTITION BY side) AS share FROM seg GROUP BY 1, 2'},
    "SELECT state, round(sum(share) / (SELECT count(DISTINCT side) FROM c), 5) AS share FROM c GROUP BY 1"))
def mean_fractions(spark, sf):
    return rounded(S.mean_fractions(I.composition(V.seg(spark, sf), ["side"]), "side"), 5)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b
    FROM lineitem WHERE l_orderkey <= 500) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, sf):
    return rounded(S.spearman(V.table(spark, sf, "lineitem").where("l_orderkey <= 500").select("l_quantity", "l_discount"), "l_quantity", "l_discount"))


# --- names, sets -----------------------------------------------------------------------------------------------------------------


@query("""SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '(\\d+)', 1) AS BIGINT), name) AS ord FROM (SELECT DISTINCT p_brand AS name FROM part)""")
def natural_sort(spark, sf):
    names = V.table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(N.natural_order(F.col("name")), "name")).cast("long").alias("ord"))


@query("""SELECT p_partkey, regexp_replace(trim(p_partkey || '_' || p_type), '^\\d+_', '') AS name, starts_with(lower(p_type), 'quies') OR lower(p_type) = 'background' AS quiescent,
    split_part('ENSG' || p_partkey || '.' || p_size, '.', 1) AS base_id FROM part""")
def name_normalise(spark, sf):
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_type"))
    gene = F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return V.table(spark, sf, "part").select("p_partkey", N.normalize_state(raw).alias("name"), N.is_quiescent(raw).alias("quiescent"), G.base_id(gene).alias("base_id"))


@query("""SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand""")
def unordered_pairs(spark, sf):
    return S.unordered_pairs(V.table(spark, sf, "part"), "p_brand")


@query("""SELECT event_type AS state, arg_min(user_id, event_id) AS user_id, min(event_id) AS event_id FROM events GROUP BY 1""")
def first_wins(spark, sf):
    return S.first_of(V.table(spark, sf, "events").select(F.col("event_type").alias("state"), "user_id", "event_id"), ["state"], ["event_id"])


@query("""(SELECT event_type AS state FROM events WHERE event_id % 2 = 0 INTERSECT SELECT event_type FROM events WHERE event_id % 2 = 1)""")
def common_states(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("event_type").alias("state"))
    return e.where("event_id % 2 = 0").select("state").intersect(e.where("event_id % 2 = 1").select("state"))


# --- reports ---------------------------------------------------------------------------------------------------------------------

_CP = {"sg": "SELECT 's' || side AS id, chrom, start, \"end\", state FROM seg", "o": """SELECT a.state AS s1, b.state AS s2, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS DOUBLE) AS bp FROM sg a JOIN sg b
    ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.id = 's0' AND b.id = 's1' GROUP BY 1, 2""", "t": "SELECT sum(bp) AS t, sum(CASE WHEN s1 = s2 THEN bp ELSE 0 END) AS same FROM o",
    "c": "SELECT sum(m1 * m2) AS mm FROM (SELECT s1 AS s, sum(bp) AS m1 FROM o GROUP BY 1) JOIN (SELECT s2 AS s, sum(bp) AS m2 FROM o GROUP BY 1) USING (s)",
    "j": """SELECT avg(coalesce(o.bp, 0) / (x.b + y.b - coalesce(o.bp, 0))) AS mj, sum(x.b) AS g FROM (SELECT state, sum("end" - start) AS b FROM sg WHERE id = 's0' GROUP BY 1) x
    JOIN (SELECT state, sum("end" - start) AS b FROM sg WHERE id = 's1' GROUP BY 1) y USING (state) LEFT JOIN o ON s1 = x.state AND s2 = x.state"""}


@query(V.with_views("seg", _CP, """SELECT 's0' AS a, 's1' AS b, round(same / g, 6) AS overlap_fraction, round((same / t - mm / (t * t)) / (1 - mm / (t * t)), 6) AS kappa, round(mj, 6) AS mean_jaccard FROM t, c, j"""))
def compare_pairs(spark, sf):
    s = V.seg(spark, sf).withColumn("id", F.concat(F.lit("s"), F.col("side").cast("string"))).drop("side")
    return rounded(T.compare_pairs(s, spark.createDataFrame([("s0", "s1")], "a string, b string"), WIDTH))


@query(V.with_views("seg ann", _enrich_sql('SELECT chrom, start, "end", state FROM seg WHERE side = 0'), "SELECT label, jaccard FROM out WHERE state = 'view' AND label LIKE 'O%'"))
def annotation_jaccard(spark, sf):
    return T.annotation_jaccard(R.enrichment(sides(spark, sf)[0], V.ann(spark, sf), WIDTH), "view", "O")


@query(V.with_views("peaks", {"m": _ISL.format(keys="mark, chrom", src="(SELECT * FROM peaks WHERE \"end\" > start)")}, """SELECT mark, n, last, bp FROM (SELECT mark, count(*) AS n, max("end") AS last FROM peaks GROUP BY 1)
    JOIN (SELECT mark, CAST(sum("end" - start) AS BIGINT) AS bp FROM m GROUP BY 1) USING (mark)"""))
def footprint(spark, sf):
    return T.footprint(V.peaks(spark, sf), ["mark"])


@query("""WITH p AS (SELECT l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS threshold, l_suppkey, avg(CAST(l_quantity AS DOUBLE)) / 50 AS tpr, avg(CAST(l_discount AS DOUBLE)) * 10 AS precision FROM lineitem GROUP BY 1, 2, 3)
    SELECT method, threshold, round(avg(100 * tpr), 4) AS tpr_mean, round(var_samp(100 * tpr), 4) AS tpr_var, round(avg(100 * precision), 4) AS precision_mean, round(var_samp(100 * precision), 4) AS precision_var FROM p GROUP BY 1, 2""")
def by_threshold(spark, sf):
    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("threshold"), "l_suppkey")
    return rounded(T.by_threshold(t.agg((F.avg(F.col("l_quantity").cast("double")) / 50).alias("tpr"), (F.avg(F.col("l_discount").cast("double")) * 10).alias("precision"))), 4)


@query("""WITH z AS (SELECT 'chr' || (l_suppkey % 5) AS chrom, max(l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 10) AS size FROM lineitem GROUP BY 1)
    SELECT chrom, size, n_bins, CAST(coalesce(sum(n_bins) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_bin FROM (SELECT *, (size + 99) // 100 AS n_bins FROM z)""")
def chrom_offsets(spark, sf):
    z = _sizes(spark, sf).withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("chrom")))
    return T.offsets(z, 100).select("chrom", "size", F.col("n_bins").cast("long").alias("n_bins"), F.col("first_bin").cast("long").alias("first_bin"))


@query("""(SELECT DISTINCT 'k' || (event_id % 6) AS item, 'before' AS side FROM events WHERE value > 20 EXCEPT SELECT DISTINCT 'k' || (event_id % 4), 'before' FROM events WHERE value > 20)""")
def dropped_items(spark, sf):
    e = V.table(spark, sf, "events").where("value > 20")
    names = lambda k: e.select(F.concat(F.lit("k"), (F.col("event_id") % k).cast("string")).alias("item")).distinct()
    return T.dropped_items(names(6), names(4))


# --- files -----------------------------------------------------------------------------------------------------------------------


@query(V.with_views("seg", {}, 'SELECT chrom, start, "end", state FROM seg WHERE side = 0'))
def bed_round_trip(spark, sf):
    path = shared_folder(spark, "bed")
    writers.write_bed(sides(spark, sf)[0], path)
    return readers.read_bed(spark, path).select("chrom", "start", "end", "state")


@query(V.with_views("peaks", _BIT, "SELECT chrom, bin, mark FROM bits"))
def binary_round_trip(spark, sf):
    path = shared_folder(spark, "binary")
    bits = _bits(spark, sf)
    bins = _sizes(spark, sf).select("chrom", F.ceil(F.col("size") / 100).alias("n_bins"))
    writers.write_binary(bits, bins, MARKS, "cell", path)
    return readers.read_binary(spark, f"{path}/*/*.gz").where("v = 1").select("chrom", "bin", "mark")


@query(V.with_views("emis", {}, "SELECT state, mark, round(value, 4) AS value FROM emis"))
def matrix_round_trip(spark, sf):
    path = shared_folder(spark, "matrix")
    writers.write_table(writers.wide(V.emis(spark, sf), "state", "mark", "value", [f"m{j}" for j in range(6)]), path)
    return readers.read_matrix(spark, path)


# --- more reports ------------------------------------------------------------------------------------------------------------------


@query(V.with_views("seg", _TR | {"h": "SELECT side, from_state AS state, sum(-p * log2(p)) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY side, from_state) AS p FROM tr) GROUP BY 1, 2"},
    """SELECT side, state, n, total_bp, mean_len, median_len, share, round(coalesce(h, 0.0), 6) AS entropy FROM (SELECT side, state, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS total_bp, round(avg("end" - start), 1) AS mean_len,
    round(median("end" - start), 1) AS median_len, round(sum("end" - start) / sum(sum("end" - start)) OVER (PARTITION BY side), 6) AS share FROM seg GROUP BY 1, 2) LEFT JOIN h USING (side, state)"""))
def segmentation_summary(spark, sf):
    return T.segmentation_summary(V.seg(spark, sf), BIN, ["side"])


@query(V.with_views("seg", {}, """SELECT chrom, start, "end", CASE state WHEN 'click' THEN 'Tss' WHEN 'view' THEN 'Enh' ELSE state END AS state FROM seg WHERE side = 0"""))
def relabel(spark, sf):
    m = spark.createDataFrame([("click", "1_Tss"), ("view", "2_Enh")], "work_state string, ref_state string")
    return M.relabel(sides(spark, sf)[0], m)


@query(V.with_views("seg", {}, """SELECT state, min_by(chrom || ',0,0', start * 1000000 + CAST(substr(chrom, 4) AS BIGINT)) AS color FROM seg WHERE side = 0 GROUP BY 1"""))
def state_colors(spark, sf):
    rows = sides(spark, sf)[0].withColumn("color", F.concat("chrom", F.lit(",0,0"))).withColumn("ord", F.col("start") * 1000000 + F.substring("chrom", 4, 9).cast("long"))
    return M.state_colors(rows)


_VAL = """SELECT l_returnflag || l_linestatus AS a, l_returnflag || 'F' AS b, round(avg(CAST(l_tax AS DOUBLE)), 6) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2"""


def _values(spark, sf):
    t = V.table(spark, sf, "lineitem").where("l_linestatus = 'O'")
    return t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("a"), F.concat("l_returnflag", F.lit("F")).alias("b")).agg(F.round(F.avg(F.col("l_tax").cast("double")), 6).alias("value"))


@query(f"""WITH v AS ({_VAL}), l AS (SELECT DISTINCT l_returnflag || l_linestatus AS n FROM lineitem) SELECT x.n AS a, y.n AS b,
    CASE WHEN x.n = y.n THEN 1.0 ELSE coalesce(v.value, w.value, 0.0) END AS value FROM l x CROSS JOIN l y LEFT JOIN v ON v.a = x.n AND v.b = y.n LEFT JOIN v w ON w.b = x.n AND w.a = y.n""")
def symmetric_matrix(spark, sf):
    labels = V.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()
    return A.symmetric_matrix(_values(spark, sf), labels)


@query("""WITH r AS (SELECT event_type AS state, user_id % 7 AS dataset, count(*) AS n FROM events WHERE value > 60 GROUP BY 1, 2) SELECT s.state, d.dataset, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT event_type AS state FROM events) s CROSS JOIN (SELECT DISTINCT user_id % 7 AS dataset FROM events) d LEFT JOIN r USING (state, dataset)""")
def reindex(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("state"), (F.col("user_id") % 7).alias("dataset"), "value")
    keys = e.select("state").distinct().join(F.broadcast(e.select("dataset").distinct()), F.lit(True))
    return S.reindex(e.where("value > 60").groupBy("state", "dataset").agg(F.count("*").alias("n")), keys, ["state", "dataset"], 0)


@query("""SELECT event_type AS state, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 2 + dense_rank() OVER (PARTITION BY event_type IN ('view', 'click') ORDER BY event_type) END AS ord
    FROM (SELECT DISTINCT event_type FROM events)""")
def known_order(spark, sf):
    return S.in_order(V.table(spark, sf, "events").select(F.col("event_type").alias("state")).distinct(), "state", ["view", "click"])


@query(V.with_views("seg ann", _enrich_sql('SELECT chrom, start, "end", state FROM seg WHERE side = 0'), """SELECT label, round(sum(sensitivity), 4) AS sensitivity,
    round(sum(coverage * sbp) / sum(sbp), 4) AS coverage, round(sum(coverage * sbp) / sum(sbp) / arg_min(coverage / fold, state) FILTER (fold > 0), 4) AS fold
    FROM out JOIN (SELECT state, sum("end" - start) AS sbp FROM s GROUP BY 1) USING (state) WHERE state IN ('click', 'view') GROUP BY 1"""))
def pooled_sensitivity(spark, sf):
    seg = sides(spark, sf)[0]
    table, sizes = R.enrichment(seg, V.ann(spark, sf), WIDTH), I.state_report(seg).select("state", "total_bp")
    each = [R.pooled_from_table(table, sizes, ["click", "view"], k).select(F.lit(k).alias("label"), "sensitivity", "coverage", "fold") for k in ("F", "O", "P")]
    return rounded(each[0].unionByName(each[1]).unionByName(each[2]), 4)


@query()
def kmeans_quality(spark, sf):
    rows = C.quality_sweep(B.patterns(_codes(spark, sf)).select("code", "n"), 6, [2, 3, 4])
    return spark.createDataFrame([tuple(r.values()) for r in rows], "k int, inertia double, silhouette double, entropy double, states int")


@query(V.with_views("seg", {"s": "SELECT DISTINCT state FROM seg"}, """SELECT a.state AS work_state, b.state AS ref_state FROM (SELECT state, row_number() OVER (ORDER BY md5('7:' || state), state) AS i FROM s) a
    JOIN (SELECT state, row_number() OVER (ORDER BY md5('8:' || state), state) AS i FROM s) b USING (i)"""))
def random_bijection(spark, sf):
    states = V.seg(spark, sf).select("state").distinct()
    return M.random_bijection(states, states, 7)


from . import catalogue  # noqa: E402,F401  (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
