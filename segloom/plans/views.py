"""Carrier views: the inputs of the interval engine, built over the provided tables by the same expressions in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Beginning of the coordinate of ``seg``, ``ann`` and ``marks_t``, and its length.
EPOCH, SPAN = 1704067200, 2592000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds() -> F.Column:
    return F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, chrom, start, end, state: two disjoint labellings."""
    at = Window.partitionBy("side", "chrom").orderBy("start", "event_id")
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 2).alias("side"), F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")).alias("chrom"), _seconds().alias("start"),
        F.col("event_type").alias("state"), "event_id",
    )
    return rows.withColumn("end", F.lead("start").over(at)).where("end > start").select("side", "chrom", "start", "end", "state")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, mark, start, end: six overlapping region sets."""
    start = F.col("l_orderkey") * 100
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), F.concat("l_returnflag", "l_linestatus").alias("mark"),
        start.alias("start"), (start + F.col("l_quantity").cast("long") * 10).alias("end"),
    )


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, label: three annotations on the coordinate of ``seg``."""
    start = (F.col("o_orderkey") * 173) % SPAN
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 600).alias("end"), F.col("o_orderstatus").alias("label")
    )


def marks_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, mark, start, end on the coordinate of ``seg``."""
    return table(spark, sf_dir, "events").where("value > 20").select(
        F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")).alias("chrom"), F.concat(F.lit("k"), (F.col("event_id") % 6).cast("string")).alias("mark"),
        _seconds().alias("start"), (_seconds() + 1800).alias("end"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, base_id, tpm, chrom, start, end, strand, ord."""
    key = F.col("p_partkey")
    start = (key * 1301) % SPAN
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("G"), key.cast("string"), F.lit("."), (F.col("p_size") % 5).cast("string")).alias("gene_id"), F.concat(F.lit("G"), key.cast("string")).alias("base_id"),
        F.when(key % 7 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice") - 900).cast("double").alias("tpm"),
        F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 3000).alias("end"),
        F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), key.alias("ord"),
    )


def emis(spark: SparkSession, sf_dir: str, marks: int = 6) -> DataFrame:
    """state, mark, value: mean presence-like vectors, one per label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("state"), F.posexplode(F.slice("embedding", 1, marks)).alias("j", "v"))
    return rows.groupBy("state", F.concat(F.lit("m"), F.col("j").cast("string")).alias("mark")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("value"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, axis, cell, value."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("method"), F.concat(F.lit("c"), (F.col("l_suppkey") % 4).cast("string")).alias("cell"), "l_discount", "l_tax", "l_quantity"
    )
    wide = rows.groupBy("method", "cell").agg(*(F.round(F.avg(F.col(c).cast("double")), 6).alias(a) for a, c in AXES.items()))
    return wide.unpivot(["method", "cell"], list(AXES), "axis", "value")


AXES = {"discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}

_S = f"CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH}"
SQL = {
    "seg": f"""SELECT side, chrom, start, "end", state FROM (SELECT event_id % 2 AS side, 'chr' || (user_id % 5) AS chrom, {_S} AS start, event_type AS state,
        lead({_S}) OVER (PARTITION BY event_id % 2, user_id % 5 ORDER BY {_S}, event_id) AS "end" FROM events) WHERE "end" > start""",
    "peaks": """SELECT 'chr' || (l_suppkey % 5) AS chrom, l_returnflag || l_linestatus AS mark, l_orderkey * 100 AS start,
        l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 10 AS "end" FROM lineitem""",
    "ann": f"""SELECT 'chr' || (o_custkey % 5) AS chrom, (o_orderkey * 173) % {SPAN} AS start, (o_orderkey * 173) % {SPAN} + 600 AS "end", o_orderstatus AS label FROM orders""",
    "marks_t": f"""SELECT 'chr' || (user_id % 5) AS chrom, 'k' || (event_id % 6) AS mark, {_S} AS start, {_S} + 1800 AS "end" FROM events WHERE value > 20""",
    "genes": f"""SELECT 'G' || p_partkey || '.' || (p_size % 5) AS gene_id, 'G' || p_partkey AS base_id,
        CAST(CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_retailprice - 900 END AS DOUBLE) AS tpm, 'chr' || (p_partkey % 5) AS chrom,
        (p_partkey * 1301) % {SPAN} AS start, (p_partkey * 1301) % {SPAN} + 3000 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey AS ord FROM part""",
    "emis": """SELECT CAST(label AS VARCHAR) AS state, 'm' || (j - 1) AS mark, round(avg(CAST(embedding[j] AS DOUBLE)), 6) AS value
        FROM embeddings, range(1, 7) t(j) GROUP BY 1, 2""",
    "evidence": """SELECT method, cell, axis, round(v, 6) AS value FROM (SELECT l_returnflag || l_linestatus AS method, 'c' || (l_suppkey % 4) AS cell,
        unnest(['discount', 'tax', 'quantity']) AS axis, unnest([avg(CAST(l_discount AS DOUBLE)), avg(CAST(l_tax AS DOUBLE)), avg(CAST(l_quantity AS DOUBLE))]) AS v
        FROM lineitem GROUP BY 1, 2)""",
}


def with_views(names: str, more: dict[str, str], body: str) -> str:
    """SQL over views (space separated) and further common table expressions."""
    parts = {n: SQL[n] for n in names.split()} | more
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" + body
