"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents that a label table marks with 1; every other use of labels is avoided. All documents of the training fold,
labelled or not, are the unlabelled sample. A logistic model of text statistics and of hashed words and pairs of words minimises the
non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l(z) = log(1 + exp(-z))

with a ridge. As l(z) - l(-z) = -z, both arms of the maximum are convex (A = prior * E_p[l(g)] and A + B = E_u[l(-g)] - prior * E_p[g]),
and so is the risk: its minimum is that of A + t B for some t of 0 to 1, either t = 1, where the clamp is not active, or t = 0, or the t at which
B, the estimate of the negative risk, is just 0. Newton steps find the minimum for a t, halving of the interval finds t.

The class prior is estimated from the same two samples: a first model tells positives from unlabelled text, and over the
bins of its score the prior is the least ratio of the unlabelled to the positive share above a bin.

Each pass is a distributed sum over a narrow table of the statistics (``DIM`` numbers a document); only sums of fixed size come to
the driver. Labels, language, source and id are never inputs of a score.

A null text counts as empty, and empty texts are scored like any other, very long ones by all their words. A score equal to the cut is
predicted 1. A null id counts as empty text for the fold and has no label.
An id that a label table repeats is positive if any of its rows says so. Without positives the score is 0.5 for all. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import _MIX, Words
from .scratch import Scratch
from .text import fold, quoted, slices, utf8

BASE, LEXICAL = 10, 32
#: Statistics, their square roots, and signed buckets of words and of pairs of words.
DIM = 2 * BASE + 2 * LEXICAL
RIDGE = 1e-3
#: Precision of the buckets' weights, shared by the positives: few positives say little about words.
DOUBT = 20.0
BINS = 400
UPPER, DIGITS, STOPS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!|"


def features(w: Words) -> list[float]:
    """Shares and means over the whole text."""
    text = w.text
    n_words, chars, symbols, dup, rep = w.stats()
    size, n, lines = max(len(text), 1), max(n_words, 1), max(text.count(b"\n") + 1, 1)
    count = lambda which: len(text) - len(text.translate(None, which))
    return [
        float(np.log1p(n_words)) / 10, chars / n / 10, symbols / size, dup / lines, rep / n,
        count(UPPER) / size, count(DIGITS) / size, w.distinct / n, count(STOPS) / n, count(MARKS) / size,
    ]


def lexical(words: Words) -> np.ndarray:
    """Signed sums of hashed words and of hashed pairs of words, over the root of the words' number."""
    h = words.hashes() * _MIX
    out = []
    for x in (h, ((h[:-1] >> np.uint64(7)) ^ h[1:]) * _MIX):
        sign = 1.0 - 2.0 * ((x >> np.uint64(40)) & np.uint64(1)).astype(float)
        out.append(np.bincount((x >> np.uint64(59)).astype(np.int64), weights=sign, minlength=LEXICAL) / np.sqrt(max(len(h), 1)))
    return np.concatenate(out)


def vector(text: bytes) -> np.ndarray:
    """All that a score depends on."""
    words = Words(text)
    x = np.array(features(words))
    return np.concatenate([x, np.sqrt(x), lexical(words)])


def feature_table(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """doc_id, held_out, x: ``vector`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            x = np.array([vector(t) for t in b.column("t").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), lists], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), (fold(quoted(id_col), folds) == 0).alias("held_out"), utf8(quoted(text_col)).alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(np.float64)


def sums(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of part(x, positive), a vector of ``size`` numbers a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += part(_matrix(b.column("x")), b.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "positive").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


class Scale:
    """Standardises the statistics and adds a constant one."""

    def __init__(self, total: np.ndarray):
        n = max(total[0], 1)
        self.mean = total[1 : DIM + 1] / n
        self.sd = np.sqrt(np.maximum(total[DIM + 1 :] / n - self.mean**2, 0)) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.sd, -6, 6), np.ones((len(x), 1))], 1)


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def penalty(positives: float) -> np.ndarray:
    """Ridge by weight."""
    out = np.full(DIM + 1, RIDGE)
    out[2 * BASE : DIM] += DOUBT / max(positives, 1)
    return out


class Sums:
    """Sums that a Newton step at weights w needs: of all rows (unlabelled) and of the positive ones."""

    def __init__(self, rows: DataFrame, scale: Scale, w: np.ndarray):
        d = len(w)

        def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            z = scale(x)
            out = []
            for y in (z, z[positive]):
                g = y @ w
                s = _sig(g)
                out += [[len(y), _soft(g).sum()], y.sum(0), y.T @ s, ((y * (s * (1 - s))[:, None]).T @ y).ravel()]
            return np.concatenate(out)

        one = 2 + 2 * d + d * d
        v = sums(rows, part, 2 * one)
        self.u, self.p = ({"n": max(a[0], 1), "soft": a[1], "x": a[2 : 2 + d], "sx": a[2 + d : 2 + 2 * d], "h": a[2 + 2 * d :].reshape(d, d)} for a in (v[:one], v[one:]))
        self.positives = v[one]


def tell_apart(rows: DataFrame, scale: Scale, steps: int = 8) -> np.ndarray:
    """Logistic weights of positives against unlabelled text, both samples weighing the same."""
    w = np.zeros(DIM + 1)
    for _ in range(steps):
        s = Sums(rows, scale, w)
        ridge = penalty(s.positives)
        grad = (s.p["sx"] - s.p["x"]) / s.p["n"] + s.u["sx"] / s.u["n"] + ridge * w
        step = np.linalg.solve(s.p["h"] / s.p["n"] + s.u["h"] / s.u["n"] + np.diag(ridge), grad)
        w = w - step
        if np.abs(step).max() < 1e-2:
            break
    return w


def estimate_prior(rows: DataFrame, scale: Scale, w: np.ndarray) -> float:
    """Least ratio of the unlabelled to the positive share above a bin, of bins with a tenth of the positives above."""

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((_sig(scale(x) @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    v = sums(rows, part, 2 * BINS).reshape(2, BINS)
    above = np.cumsum(v[:, ::-1], 1) / np.maximum(v.sum(1, keepdims=True), 1)
    far = above[1] >= 0.1
    slack = np.sqrt(np.log(2 * BINS) / 2) * (1 / np.sqrt(max(v[0].sum(), 1)) + 1 / np.sqrt(max(v[1].sum(), 1)))
    share = np.maximum(above[1], 1e-9)
    best = int(np.argmin(np.where(far, (above[0] + slack) / share, np.inf)))  # the bin that bounds the prior most tightly
    return float(np.clip(above[0][best] / share[best], 0.01, 0.99))


def _newton(rows: DataFrame, scale: Scale, prior: float, t: float, w: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights of least A + t B with the ridge, from w on, and B there."""
    old, last = w, np.inf
    for _ in range(steps):
        s = Sums(rows, scale, w)
        a, b = prior * (s.p["soft"] - s.p["x"] @ w) / s.p["n"], s.u["soft"] / s.u["n"] - prior * s.p["soft"] / s.p["n"]
        ridge = penalty(s.positives)
        value = a + t * b + ridge * w @ w / 2
        if value > last + 1e-12:
            w = (w + old) / 2
            continue
        grad = prior * ((1 - t) * s.p["sx"] - s.p["x"]) / s.p["n"] + t * s.u["sx"] / s.u["n"] + ridge * w
        step = np.linalg.solve((1 - t) * prior * s.p["h"] / s.p["n"] + t * s.u["h"] / s.u["n"] + np.diag(ridge), grad)
        if np.abs(step).max() < 1e-3:
            break
        old, last, w = w, value, w - step
    return w, float(b)


def minimise(rows: DataFrame, scale: Scale, prior: float, halvings: int = 12) -> np.ndarray:
    """Weights of least non-negative risk."""
    w, b = _newton(rows, scale, prior, 1.0, np.zeros(DIM + 1))
    if b >= 0:
        return w
    low, high = 0.0, 1.0  # B falls with t
    for _ in range(halvings):
        t = (low + high) / 2
        w, b = _newton(rows, scale, prior, t, w)
        if abs(b) < 1e-4:
            break
        low, high = (t, high) if b > 0 else (low, t)
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, cut: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, class_prior."""
    scratch = Scratch(docs.sparkSession, "pu")
    table = scratch.write(feature_table(docs, id_col, text_col, folds))
    trusted = labels.where(F.col(label) == 1).select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.lit(True).alias("trusted")).where("doc_id is not null").distinct()
    rows = scratch.write(table.where("not held_out").join(trusted, "doc_id", "left").select("x", F.coalesce("trusted", F.lit(False)).alias("positive")))
    scale = Scale(sums(rows, lambda x, _: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * DIM))
    w, prior = np.zeros(DIM + 1), 0.5
    if rows.where("positive").limit(1).count():
        prior = estimate_prior(rows, scale, tell_apart(rows, scale))
        w = minimise(rows, scale, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _sig(scale(_matrix(b.column("x"))) @ w)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int").withColumn("class_prior", F.lit(prior))
