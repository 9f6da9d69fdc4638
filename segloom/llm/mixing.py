"""Mixing sources to target weights by blocks.

Each source's words, its documents one after another in a pseudorandom order, are packed into blocks of ``block`` words. The mix
is a number of slots of one block each, dealt to output shards. A shard draws how many of its slots each source fills from a
multinomial, conditioned on the totals that the targets fix (so drawn without replacement from what is left of them): the
sum over the shards meets each target to half a block. Slot i of a source with n blocks takes block P_e(i mod n), P_e being
the pseudorandom permutation of the indices for pass e = i div n; a second permutation gives each slot its place in its shard, so that
the sources of a shard are interleaved. Blocks are joined to slots by index. As a target is at most twice its source, there are at
most two passes and no document is taken more than twice.

The result is a table of pieces (``pieces``): shard, slot, and the words of a document that stand there. What is taken of a document
(``mix``) and the mixed documents (``mixed_documents``) are derived from it.

Draws are made by one sampler at every size; the driver draws for groups of shards, and their shards are drawn in tasks. What the driver
holds is a row for each source and group of shards, ``PARTS`` at most but one a source.

A null text has size 0 and is never taken. A null source is a source of its own, ordered last; null ids and repeated rows are
documents like any other. Very long texts are cut at block edges like others. Documents whose rank ties are ordered by id, size and row; rows
that repeat an id and a text are the only ones that share a rank, so an id that many rows share is dealt to many buckets. Sources without
words have target 0. Extra columns are ignored or carried, whatever their names; an empty table gives an empty result. Reruns agree: order,
draws and permutations depend on the rows and ``seed`` only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import WORD, quoted, slices, utf8

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source whose offsets are summed up in one task, and such buckets that are summed up in one.
BUCKET, BUCKETS = 2048, 4096
#: Slots of an output shard.
SHARD = 1 << 16
#: Numbers (groups of shards times sources) that the driver draws, unless there are more sources.
PARTS = 1 << 20
#: Rows up to which the table of sources is broadcast; a larger one is joined.
BROADCAST = 100_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """What each source should give: ``share`` of all sizes by weight, none over ``most`` times its size; the excess is
    shared anew among the others by weight until none is above."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def draw(slots: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts [shard][source]: each shard's multinomial over the sources, conditioned on the totals ``slots``."""
    return _deal(slots, _capacities(sum(slots), shards), np.random.default_rng(seed))


def _capacities(total: int, parts: int) -> list[int]:
    return [total * (s + 1) // parts - total * s // parts for s in range(parts)]


def _deal(slots: list[int], sizes: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Counts [part][source] of parts of the given sizes, which sum to the slots."""
    left, out = list(slots), []
    for to_fill in sizes:
        row, rest = [0] * len(left), sum(left)
        for j, c in enumerate(left):  # one source after another, as a multinomial is drawn, without replacement
            rest -= c
            row[j] = hypergeometric(rng, c, rest, to_fill)
            to_fill -= row[j]
        left = [c - n for c, n in zip(left, row, strict=True)]
        out.append(row)
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn are good ones, by rejection from the table mountain hat of the ratio of uniforms: its cost does not depend on
    the numbers, and the library's generator ends at 10^9."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mean, share = n * (good / total), good / total
    spread = math.sqrt(mean * (1 - share) * (total - n) / (total - 1) + 0.5)
    # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), the width of the hat.
    width = 1.7155277699214135 * spread + 0.8989161620588988
    log_mass = lambda x: -(math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(n - x + 1) + math.lgamma(bad - n + x + 1))
    top = log_mass((n + 1) * (good + 1) // (total + 2))
    while True:
        u = 1 - rng.random()
        x = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_mass(x) - top:
            return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Images under the pseudorandom permutation of 0..size-1 that a key names, by swap-or-not rounds: each round pairs x with k - x and
    swaps the pair or not by a keyed bit of the pair, so each round is a bijection, whatever the size."""
    x, size, key = (np.asarray(a).astype(np.uint64) for a in (x, size, key))
    for _ in range(rounds):
        key = _mixed(key + _M1)
        other = (key % size + size - x) % size
        x = np.where(_mixed(np.maximum(x, other) * _M1 ^ key) >> np.uint64(63) == 1, other, x)
    return x.astype(np.int64)


def _slots(spark, slots: list[int], blocks: list[int], shard: int, seed: int) -> DataFrame:
    """k, x, pass, shard, slot: the block that each place of each shard takes."""
    total, n = sum(slots), len(slots)
    n_shards = max(1, -(-total // shard))
    groups = min(n_shards, max(1, PARTS // max(n, 1)))
    first = [n_shards * g // groups for g in range(groups + 1)]
    counts = _deal(slots, [total * b // n_shards - total * a // n_shards for a, b in zip(first, first[1:], strict=False)], np.random.default_rng(seed))
    begin, rows = np.zeros(n, np.int64), []
    for g, row in enumerate(counts):
        some = [k for k in range(n) if row[k]]
        rows.append((first[g], first[g + 1], some, [row[k] for k in some], [int(begin[k]) for k in some], [blocks[k] for k in some]))
        begin += np.array(row, np.int64)

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = [total * (s + 1) // n_shards - total * s // n_shards for s in range(r["first"], r["last"])]
                start, left, rng = np.array(r["begin"], np.int64), np.array(r["count"], np.int64), np.random.default_rng([seed, r["first"], 1])
                for at, size in enumerate(sizes):
                    own = np.array(_deal(left.tolist(), [size], rng)[0], np.int64)
                    some = np.nonzero(own)[0]
                    yield pa.RecordBatch.from_pylist(
                        [{"shard": r["first"] + at, "k": [r["k"][j] for j in some], "count": own[some].tolist(), "begin": start[some].tolist(), "blocks": [r["blocks"][j] for j in some]}],
                        pa.schema([("shard", pa.int64()), ("k", pa.list_(pa.int32())), *((c, pa.list_(pa.int64())) for c in ("count", "begin", "blocks"))]),
                    )
                    start, left = start + own, left - own

    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                count = np.array(r["count"], np.int64)
                if not len(count):
                    continue
                source, n_blocks = np.repeat(np.array(r["k"], np.int64), count), np.repeat(np.array(r["blocks"], np.int64), count)
                i = np.concatenate([np.arange(a, a + c) for a, c in zip(r["begin"], r["count"], strict=True)])
                turn = i // n_blocks
                key = _mixed((source * 4 + turn + seed * 1_000_003).astype(np.uint64) * _M1)
                place = np.random.default_rng([seed, r["shard"], 2]).permutation(len(i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source.astype(np.int32)), pa.array(permuted(i % n_blocks, n_blocks, key)), pa.array(turn.astype(np.int32)), pa.array(np.full(len(i), r["shard"])), pa.array(place.astype(np.int64))],
                    ["k", "x", "pass", "shard", "slot"],
                )

    grouped = spark.createDataFrame(rows, "first long, last long, k array<int>, count array<long>, begin array<long>, blocks array<long>").repartition(max(1, min(groups, 256)), "first")
    shards = grouped.mapInArrow(by_shard, "shard long, k array<int>, count array<long>, begin array<long>, blocks array<long>")
    return shards.repartition(max(1, min(n_shards, 100_000)), "shard").mapInArrow(by_slot, "k int, x long, pass int, shard long, slot long")


def _before(by: list[str], order: list[str], value: str) -> Column:
    """Sum of ``value`` over the rows of a group that stand before a row."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


class Mix:
    """sized: a row per document; info: a row per source; pieces: rid, k, pass, shard, slot, lo, hi (words lo to hi of a document stand there)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, block: int, shard: int, seed: int, carry: bool):
        spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
        id_, text, source = (F.col(quoted(c)) for c in (id_col, text_col, source_col))
        others = [F.col(quoted(c)) for c in docs.columns if c != text_col]
        self.sized = scratch.write(
            docs.select(
                id_.alias("doc_id"), source.cast("string").alias("source"), size_of(quoted(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_, text).alias("rank"),
                F.monotonically_increasing_id().alias("rid"), *([text.alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("row")] if carry else []),
            )
        )
        slim = self.sized.select("doc_id", "source", "size", "rank", "rid")
        known = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).collect()  # a row a source
        known.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        want = targets([r.source_size for r in known], weights, share)
        # whole blocks that come nearest to each target; the last block of a source is shorter
        blocks = [-(-r.source_size // block) for r in known]
        slots = [min(2 * b, round(t * b / r.source_size)) if r.source_size else 0 for r, t, b in zip(known, want, blocks, strict=True)]
        self.info = spark.createDataFrame(
            [(i, r.source, int(r.source_size), float(t), -(-r.n_docs // BUCKET)) for i, (r, t) in enumerate(zip(known, want, strict=True))],
            "k int, src string, source_size long, target double, n_buckets long",
        )
        self.few = len(known) <= BROADCAST
        # offsets: sums of buckets, of runs of buckets, then of the documents in each; no task holds a whole source
        placed = self.of_source(slim).withColumn("bucket", F.pmod("rank", "n_buckets")).withColumn("run", F.expr(f"bucket div {BUCKETS}"))
        sums = scratch.write(placed.groupBy("k", "run", "bucket").agg(F.sum("size").alias("words")))
        runs = sums.groupBy("k", "run").agg(F.sum("words").alias("words")).select("k", "run", _before(["k"], ["run"], "words").alias("base"))
        starts = sums.withColumn("inner", _before(["k", "run"], ["bucket"], "words")).join(runs, ["k", "run"]).select("k", "bucket", (F.col("base") + F.col("inner")).alias("start"))
        at = placed.withColumn("inner", _before(["k", "bucket"], ["rank", "doc_id", "size", "rid"], "size")).join(starts, ["k", "bucket"])
        at = at.where("size > 0").select("k", "rid", "size", (F.col("start") + F.col("inner")).alias("at"))
        each = at.select("k", "rid", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("x"))
        # both sides hold more than their plans' estimates say: they are joined by sorting, never broadcast
        self.pieces = each.hint("merge").join(_slots(spark, slots, blocks, shard, seed).hint("merge"), ["k", "x"]).select(
            "rid", "k", "pass", "shard", "slot",
            F.greatest(F.col("x") * block - F.col("at"), F.lit(0)).alias("lo"), F.least((F.col("x") + 1) * block - F.col("at"), F.col("size")).alias("hi"),
        )

    def of_source(self, rows: DataFrame) -> DataFrame:
        """rows with their source's numbers."""
        info = F.broadcast(self.info) if self.few else self.info
        return rows.join(info, F.col("source").eqNullSafe(F.col("src"))).drop("src")


def _options(weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, block: int = 64, shard: int = SHARD, seed: int = 11) -> tuple:
    """block: words in a block; shard: slots in an output shard; weights, share: see ``targets``."""
    return weights, share, block, shard, seed


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix: shard, slot, doc_id, source, pass, lo, hi. Words lo to hi (from 0, end exclusive) of a document stand in a slot of a shard; a
    slot that more documents share holds them in the order of their blocks. options: see ``_options``."""
    mix_ = Mix(docs, id_col, text_col, source_col, *_options(**options), False)
    return mix_.pieces.join(mix_.sized.select("rid", "doc_id", "source"), "rid").select("shard", "slot", "doc_id", "source", "pass", "lo", "hi")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, once (words taken at least once). options: see ``_options``."""
    mix_ = Mix(docs, id_col, text_col, source_col, *_options(**options), False)
    n = F.col("hi") - F.col("lo")
    # a block is taken in the second pass only after all of its source's were in the first
    taken = mix_.pieces.groupBy("rid").agg(F.sum(n).alias("taken"), F.sum(F.when(F.col("pass") == 0, n).otherwise(0)).alias("once"))
    return mix_.of_source(mix_.sized.join(taken.hint("merge"), "rid", "left")).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("once", F.lit(0)).cast("long").alias("once"),
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The words of sorted spans, each with the white space before it; the whole text if they are all its words."""
    word = ~_BLANK[np.frombuffer(text, np.uint8)]
    ends = np.concatenate([[0], np.nonzero(word & ~np.concatenate([word[1:], [False]]))[0] + 1])
    if sum(hi - lo for lo, hi in spans) == len(ends) - 1:
        return text
    return b"".join(text[ends[lo] : ends[hi]] for lo, hi in spans)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each pass, a row per document that the pass takes words of, whose text is those
    words with the white space between them and before the first, if the text begins with it. A row lies in the shard, and at the place in it,
    of the first of its pieces."""
    mix_ = Mix(docs, id_col, text_col, source_col, *_options(**options), True)
    spans = mix_.pieces.groupBy("rid", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.min_by(F.struct("shard", "slot"), "lo").alias("first"))
    rows = spans.hint("merge").join(mix_.sized.hint("merge"), "rid").select("first.shard", "first.slot", "rid", "pass", "spans", "row", utf8("text").alias("t"))
    names = [c for c in docs.columns if c != text_col]
    place = ["shard", "slot", "rid", "pass"]
    body = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    schema = T.StructType([*(rows.schema[c] for c in place), T.StructField("out", body)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            texts = [cut(t, [(s["lo"], s["hi"]) for s in spans]) for t, spans in zip(b.column("t").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            row = b.column("row")
            held = {c: row.field(i + 1) for i, c in enumerate(names)}
            held[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
            if chars_col in held:
                held[chars_col] = pa.array([len(t.decode()) for t in texts], pa.int64()).cast(held[chars_col].type)
            out = pa.StructArray.from_arrays([held[c] for c in docs_columns], [f"c{i}" for i in range(len(docs_columns))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in place), out], [*place, "out"])

    docs_columns = docs.columns
    shards = rows.mapInArrow(run, schema).repartition("shard").sortWithinPartitions(*place)
    return shards.select(*(F.col(f"out.c{i}").alias(c) for i, c in enumerate(docs.columns)))
