"""Exact dedup by distributed MSD radix partitioning.

Each round reads the next digit, a run of successive bytes, of every text still in question and splits its group by it. A group
leaves when it has one member or when its texts have ended; the members of an ended group are equal byte by byte, so no
digest takes part in the decision. The byte length is the first digit: it tells where a text ends, and all texts of a group
end together. Digits widen eightfold by round without a limit, so that equal texts of n bytes take O(log n) rounds: 20 MB take eight. In
each round, what is left of the texts in question is moved once; texts that nothing else resembles in their first bytes leave at once.

A group of any size is split by a partial aggregation, whose result is written, and a join of its rows with one row per subgroup,
whose hot keys adaptive execution splits; its rows never have to meet in one task. Rows are numbered once, in a table that is written
before it is used.

Null texts count as empty; a null id is smaller than any other. Of rows that repeat an id and a text, one stays (ties go to the
row with the largest number). Very long texts differ from others only in the rounds that they take. Extra columns are ignored or, by
``drop_copies``, passed on, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import numbered, quoted, utf8

#: Bytes of a digit at most: no text that Spark holds is longer.
ALL = (1 << 31) - 2


def _groups(rows: DataFrame, scratch: Scratch, first: int, digest: bool) -> DataFrame:
    """rows: rid, doc_id, body, written -> rid, doc_id, text_sha256 (null without ``digest``), keep_id, group_size, kept."""
    rows = rows.select("rid", "doc_id", F.octet_length("body").alias("n"), F.col("body").alias("rest"), F.lit(0).cast("long").alias("gid"))
    sha = F.sha2("rest", 256) if digest else F.lit(None).cast("string")
    done, width, live = [], first, None
    while True:
        keys = ["gid", "n", "digit"]
        cut = rows.withColumn("digit", F.substring("rest", 1, width))
        # written, so that only an exchange stands between the rows and the join: then adaptive execution can split a hot key
        groups = scratch.write(
            cut.groupBy(*keys).agg(F.min("rid").alias("new_gid"), F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
        )
        split = cut.join(groups, keys)
        ended = (F.col("group_size") == 1) | (F.col("n") <= F.octet_length("digit"))
        out = scratch.write(
            split.select(
                "doc_id", "rid", (sha if live is None else F.col("text_sha256")).alias("text_sha256"),
                F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), ended.alias("ended"),
                F.col("new_gid").alias("gid"),
                F.when(~ended, F.col("n") - F.octet_length("digit")).alias("n"),
                F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            )
        )
        scratch.drop(groups)
        done.append(out.where("ended").select("rid", "doc_id", "text_sha256", "keep_id", "group_size", "kept"))
        rows = out.where("not ended").select("doc_id", "rid", "n", "rest", "gid", "text_sha256")
        if rows.isEmpty():
            break
        live, width = out, min(width * 8, ALL)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 32) -> DataFrame:
    """One row per document: rid (number of the row), doc_id, text_sha256, keep_id (largest id among equal texts), group_size, kept.

    first: bytes of the first digit."""
    scratch = Scratch(docs.sparkSession, "radix")
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("doc_id"), utf8(quoted(text_col)).alias("body")))
    found = _groups(rows, scratch, first, True)
    scratch.drop(rows)
    return found


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 32) -> DataFrame:
    """The rows that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "radix")
    rows = scratch.write(numbered(docs))
    found = _groups(rows.select("rid", F.col(f"row.{quoted(id_col)}").alias("doc_id"), utf8(f"row.{quoted(text_col)}").alias("body")), scratch, first, False)
    gone = scratch.write(found.where("not kept").select("rid"))  # written, so that its size is known when the join is planned
    return rows.join(gone, "rid", "left_anti").select("row.*")
