"""Token counts by offset-mapped attribution.

A document is its fields, joined by line feeds, and its sections are their lines. The whole document is encoded once; the tokens'
byte lengths give their spans, which are interval-joined to the sections by their sorted starts. A token that reaches over a
section's end is allocated by a rule: ``first`` gives it to the section of its first byte, ``most`` to the one that holds most of its
bytes (the earlier one of equals), ``share`` divides it by bytes. Counts of a document's sections add up to its tokens under every
rule. The line feed that ends a section belongs to it.

A null field counts as empty and is a section of its own, of no tokens but its line feed. Null ids and repeated rows each get their
rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that are held for attribution at once are those of one document; texts come in batches of so many bytes.
BATCH = 4 << 20


@lru_cache(2)
def encoder(path: str):
    """The encoding of a file of ranks, and the byte length of each token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. sizes: bytes of each token; starts: first byte of each section."""
    n = len(starts)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    cross = np.nonzero(last > first)[0]
    crossing = np.bincount(first[cross], minlength=n)
    owner = first
    if rule == "first":
        return np.bincount(owner, minlength=n).astype(float), crossing
    counts = np.bincount(np.delete(owner, cross), minlength=n).astype(float)
    stops = np.append(starts[1:], total)
    for t in cross:
        over = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[over], ends[t]) - np.maximum(starts[over], begin[t])
        if rule == "most":
            counts[over[int(held.argmax())]] += 1
        else:
            counts[over] += held / sizes[t]
    return counts, crossing


def count(docs: DataFrame, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id", rule: str = "first", ranks: str = RANKS) -> DataFrame:
    """Per section of each document: doc_id, field, section (from 0 in its field), first_byte, n_bytes, n_tokens, n_crossing."""
    if rule not in ("first", "most", "share"):
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size_of = encoder(ranks)
        for b in slices(batches, "t", BATCH):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            rows = []
            for k, (text, lines) in enumerate(zip(b.column("t").to_pylist(), b.column("lines").to_pylist(), strict=True)):
                data = np.frombuffer(text.encode(), np.uint8)
                starts = np.concatenate([[0], np.nonzero(data == 10)[0] + 1])
                sizes = size_of[np.array(encoding.encode_ordinary(text), np.int64)]
                tokens, crossing = attribute(sizes, starts, len(data), rule)
                per = np.array(lines)
                n = len(starts)
                rows.append(np.full(n, k))
                of = np.repeat(np.arange(len(per)), per)
                for c, v in zip(cols, (of, np.arange(n) - np.repeat(np.cumsum(per) - per, per), starts, np.diff(np.append(starts, len(data))), tokens, crossing), strict=True):
                    c.append(v)
            names = np.array(fields, object)
            flat = [np.concatenate(c) for c in cols]
            ids = b.column("doc_id").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(names[flat[0]], pa.string()), *(pa.array(v.astype(np.int64)) for v in flat[1:4]), pa.array(flat[4]), pa.array(flat[5].astype(np.int64))],
                ["doc_id", "field", "section", "first_byte", "n_bytes", "n_tokens", "n_crossing"],
            )

    whole = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    lines = F.array(*(F.length(w) - F.length(F.replace(w, F.lit("\n"), F.lit(""))) + 1 for w in whole))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws("\n", *whole).alias("t"), lines.alias("lines"))
    return rows.mapInArrow(run, "doc_id long, field string, section long, first_byte long, n_bytes long, n_tokens double, n_crossing long")
