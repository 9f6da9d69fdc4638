"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed to ``BUCKETS`` buckets. A target multinomial is fitted to trusted documents and a raw one to
all documents. The raw one has ``ADD`` more of every bucket, the target one the same share of its own size, so that a bucket of
few counts says little either way and small corpora do not lose clean documents. A document's ratio is the mean over its n-grams of
log(target / raw); every document that passes the base rules is kept if it is at least ``THRESHOLD`` and rejected otherwise, without chance.

Trusted documents are those that a label table marks, at most ``TRUSTED`` of them, chosen by a hash of their id; the raw
counts and the scores cover every document and every n-gram. The broadcast model has ``BUCKETS`` numbers.

A null text counts as empty: no words, which fails the base rules. Very long texts count with all their n-grams. A ratio equal to the threshold
is kept. Null ids are scored like others but are never trusted. Repeated
rows count as often as they occur. Without labels or documents the ratio is 0 for all. Extra columns are ignored, or passed on
by ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, utf8

BUCKETS = 1 << 17
TRUSTED = 1 << 15
ADD = 20.0
#: Mean log ratio that a kept document has at least.
THRESHOLD = -0.15
SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(h: np.ndarray) -> np.ndarray:
    """Buckets of words and of pairs of words."""
    h = h * _MIX
    pair = ((h[:-1] >> np.uint64(7)) ^ h[1:]) * _MIX
    return (np.concatenate([h, pair]) >> np.uint64(64 - 17)).astype(np.int64)


def repeated(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words in windows of ``width`` that occur twice or more. ids: 0..distinct-1, equal for equal words only."""
    n = len(ids) - width + 1
    if n < 2 or distinct == len(ids):
        return 0
    code = ids[:n]
    for k in range(1, width):
        code = code * distinct + ids[k : n + k]
        if distinct**3 >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    ordered = np.sort(code)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.nonzero(np.isin(code, again))[0]
    cover = np.zeros(len(ids), bool)
    for k in range(width):
        cover[twice + k] = True
    return int(cover.sum())


class Words:
    """A text's words, numbered by first occurrence."""

    def __init__(self, text: bytes):
        self.text, self.words = text, text.split()
        seen = dict.fromkeys(self.words)
        self.distinct = len(seen)
        for k, w in enumerate(seen):
            seen[w] = k
        self.ids = np.fromiter(map(seen.__getitem__, self.words), np.int64, len(self.words))
        self.seen = seen

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(crc32, self.seen), np.uint64, self.distinct)[self.ids]

    def repeated(self) -> int:
        return repeated(self.ids, self.distinct)

    def stats(self) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
        text = self.text
        chars = len(text.decode()) - (len(text) - sum(map(len, self.words)))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        return len(self.words), chars, symbols, len(lines) - len(set(lines)), self.repeated()


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = TRUSTED) -> np.ndarray:
    """log(target / raw) by bucket. most: trusted documents at most."""
    spark = docs.sparkSession
    good = labels.where((F.col(label) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    trusted = np.array(sorted(r.id for r in good.orderBy(F.xxhash64("id"), "id").limit(most).collect()), np.int64)
    sent = spark.sparkContext.broadcast(trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros((2, BUCKETS), np.int64), sent.value
        for b in slices(batches, "t"):
            doc = b.column("id").fill_null(-1).to_numpy(zero_copy_only=False)
            is_good = np.isin(doc, ids) & ~b.column("id").is_null().to_numpy(zero_copy_only=False)
            held: list[list[np.ndarray]] = [[], []]
            for t, g in zip(b.column("t").to_pylist(), is_good, strict=True):
                held[int(g)].append(ngrams(Words(t).hashes()))
            for g in (0, 1):
                if held[g]:
                    total[g] += np.bincount(np.concatenate(held[g]), minlength=BUCKETS)
        at = np.nonzero(total.sum(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[:, at].sum(0)), pa.array(total[1, at])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(count, "bucket long, raw long, target long")
    sums = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    share = target.sum() / raw.sum()
    return np.log((target + ADD * share) / (raw + ADD) / share)


def ratio(model: np.ndarray, h: np.ndarray) -> float:
    return float(model[ngrams(h)].mean()) if len(h) else 0.0


def score(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for b in slices(batches, "t"):
            rows = []
            for t in b.column("t").to_pylist():
                words = Words(t)
                found = words.stats()
                failed = fails(found[0], found[4])
                r = ratio(weights, words.hashes())
                rows.append((*found, failed, r, not failed and r >= threshold))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in NAMES[1:6]) + ", base_failed boolean, ratio double, kept boolean")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]


def keep(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; one pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    text = plain.columns[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for b in slices(batches, text):
            good = []
            for t in b.column(text).cast(pa.binary()).to_pylist():
                words = Words(t or b"")
                good.append(not fails(len(words.words), words.repeated()) and ratio(weights, words.hashes()) >= threshold)
            yield b.filter(pa.array(good, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
