"""What several operators share about texts and ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: characters other than space and tab to carriage return. ``bytes.split()`` splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def numbered(docs: DataFrame) -> DataFrame:
    """rid, and the row as one struct ``row``: under it no name of a column can clash with those that an operator makes. To be written
    before it is used twice, as the numbers depend on the order in which rows arrive."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text and so falls in fold 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` at most, a single longer row being its own batch;
    bounds what a Python worker holds whatever the lengths are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
