"""Language-model scoring with Brown classes: a class bigram times a word emission.

Exchange clustering assigns every training word to a class, in two stages. At the core, units move one after another to the class that gives the
training text the highest likelihood, until none moves; units are the END token, the ``words`` most frequent words, and the endings (last two
characters) of all others, which serve as their first classes. Then every other training word, from the most frequent to those that occur once,
is exchanged: from the classes before and after its own occurrences it moves to the class of highest likelihood, the others standing still.
Only words that training never saw keep the class of their ending.

    P(w_i | w_i-1) = P(class_i | class_i-1) * (c(w_i) + 0.1) / (N_class + 0.1 * (V_class + 1))

with N_class the tokens and V_class the distinct words of a class in training, and class transitions, counted anew after the exchange, smoothed by
the class unigram. A text starts after an END.

Each text is read twice: to count words, and to encode it as numbers of the ``head`` most frequent words, which are broadcast, and the
spelling of all others. Those meet by word in one shuffle: there a word's contexts give its class and count, which go back to its places.
What a task holds of a word outside the head is its places: a part of 1 / ``head`` of all tokens at most (words of over ``LONGEST`` bytes are
never in the head; a place of those is so many bytes of text). Class sequences are kept as a byte a token; the driver holds tables of
units, of classes and of the head.

Null and empty texts have the END token only. A null id counts as empty text for the fold. Repeated rows are scored each and count as often as
they occur. Very long texts are scored whole. Ties: of equally frequent words the smaller is the more frequent, and a word moves only to a class
that is better than its own. Without training texts every word is unknown. Extra columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import fold, quoted, slices, utf8

CLASSES = 48
WORDS, ENDINGS, HEAD = 1536, 510, 65_000
#: Bytes of a word that may be in the head.
LONGEST = 4096
END, RARE = 0, 1
#: Codes of END and of a word outside the head; what is at least _OUT is _OUT more than a unit.
_END, _TAIL, _OUT = 65_534, 65_535, 65_536
ADD = 0.1


@dataclass
class Model:
    classes: int
    head: dict[bytes, int]
    """Number of each word of the head, by frequency."""
    head_count: np.ndarray
    head_unit: np.ndarray
    endings: dict[str, int]
    unit_class: np.ndarray
    head_class: np.ndarray
    moves: np.ndarray
    """Class transitions [class before, class] before the second stage."""
    tokens: int
    kinds: int
    ends: int
    step: np.ndarray | None = None
    """log10 P(class | class before)."""
    room: np.ndarray | None = None
    """log10 (N_class + 0.1 (V_class + 1))."""


def ending(word: bytes) -> str:
    return word[-8:].decode(errors="ignore")[-2:]


class Code(dict):
    """Number of each word: that in the head, or _OUT and the unit of its ending."""

    def __init__(self, head: dict[bytes, int], endings: dict[str, int]):
        super().__init__(head)
        self.head, self.endings = head, endings

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.head) + 150_000 or len(word) > 256:
            self.clear()
            self.update(self.head)
        self[word] = code = _OUT + self.endings.get(ending(word), RARE)
        return code


def word_counts(texts: DataFrame) -> DataFrame:
    """t binary -> word, c: every word of every text, lower-cased, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches, "t"):
            for t in b.column("t").to_pylist():
                seen.update(t.lower().split())
                if len(seen) > 200_000:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])


def _ragged(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and how many each row has."""
    if not len(column):
        return np.empty(0, dtype), np.empty(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat.view(dtype), np.diff(at) // np.dtype(dtype).itemsize


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(rows: DataFrame, head: dict[bytes, int], endings: dict[str, int]) -> DataFrame:
    """rows: rid, doc_id, held_out, t -> rid, doc_id, held_out, codes (16 bits a token, END last), tail (words outside the head, in order) and
    units (16 bits each, by their endings)."""
    sent = rows.sparkSession.sparkContext.broadcast((head, endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*sent.value)
        for b in slices(batches, "t", 1 << 20):
            each = [t.lower().split() for t in b.column("t").to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = [w for ws in each for w in ws]
            e = np.fromiter(map(code.__getitem__, flat), np.int32, len(flat))
            doc = np.repeat(np.arange(len(each)), sizes)
            codes = np.full(len(flat) + len(each), _END, np.uint16)
            out = e >= _OUT
            codes[np.arange(len(flat)) + doc] = np.where(out, _TAIL, e)
            at = np.nonzero(out)[0]
            n = np.bincount(doc[at], minlength=len(each))
            words = pa.array([flat[k] for k in at.tolist()], pa.binary()).cast(pa.string())
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), b.column("held_out"), _binary(codes, sizes + 1), tail, _binary((e[at] - _OUT).astype(np.uint16), n)],
                ["rid", "doc_id", "held_out", "codes", "tail", "units"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, codes binary, tail array<string>, units binary")


def _sequence(b: pa.RecordBatch, of_head: np.ndarray, of_unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all tokens of a batch, their codes, and how many each text has. of_head: by number of a word of the head, END's last."""
    codes, sizes = _ragged(b.column("codes"), np.uint16)
    out = codes == _TAIL
    value = of_head[np.where(codes >= _END, len(of_head) - 1, codes)]
    value[out] = of_unit[_ragged(b.column("units"), np.uint16)[0]]
    return value, codes, sizes


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of rows k, v by k."""
    got = rows.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def _sparse(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.nonzero(total)[0]
    for k in range(0, len(at), 100_000):
        some = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["k", "v"])


def unit_pairs(encoded: DataFrame, head_unit: np.ndarray, units: int) -> np.ndarray:
    """Counts [unit before, unit] over all texts."""
    of_head, same = np.append(head_unit, END), np.arange(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, np.int64)
        for b in batches:
            flat = np.concatenate([[END], _sequence(b, of_head, same)[0]])
            total += np.bincount(flat[:-1] * units + flat[1:], minlength=units * units)
        yield from _sparse(total)

    return _sums(encoded.select("codes", "units").mapInArrow(run, "k int, v long"), units * units).reshape(units, units)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = 10) -> np.ndarray:
    """Class of each unit: every unit in turn moves to the class that gives the training text the highest likelihood under
    the class bigram, until none moves. END keeps class 0 for itself."""
    n = len(pairs)
    freq = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-freq, kind="stable") if u != END and freq[u]]
    cls = np.ones(n, np.int64)
    for k, u in enumerate(order):
        cls[u] = 1 + k % (classes - 1)
    cls[END] = 0
    hot = np.eye(classes)[cls]
    after, before = pairs @ hot, pairs.T @ hot  # by unit: classes that follow, classes that precede
    c = hot.T @ after
    diag = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = cls[u], pairs[u, u]
            s, p = after[u].copy(), before[u].copy()
            s[a] -= own
            p[a] -= own
            c[a] -= s
            c[:, a] -= p
            c[a, a] -= own
            rows = _f(c + s) - _f(c)
            cols = _f(c + p[:, None]) - _f(c)
            gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag]
            d = c[diag, diag]
            gain += _f(d + s + p + own) - _f(d)
            r, q = c.sum(1), c.sum(0)
            gain -= _f(r + s.sum() + own) - _f(r) + _f(q + p.sum() + own) - _f(q)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = int(a)
            c[b] += s
            c[:, b] += p
            c[b, b] += own
            if b != a:
                cls[u] = b
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
                moved += 1
        if not moved:
            break
    return cls

def _added(base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows f(base + n) - f(base) of the distinct numbers n, and the row of each n."""
    distinct, which = np.unique(n, return_inverse=True)
    return _f(base + distinct[:, None]) - _f(base), which


def best_class(moves: np.ndarray, following: np.ndarray, preceding: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of highest likelihood for each of many words, as each is taken out of its own class and all else stands still. moves: class
    transitions with the words in their own classes; following, preceding: [word, class] counts around each word."""
    words, classes = following.shape
    gain = np.zeros((words, classes))
    stay = np.zeros(words)
    for counts, cells in ((following, moves), (preceding, moves.T)):  # cells[class of the word, class beside it]
        w, c = np.nonzero(counts)
        n = counts[w, c]
        pair, which = np.unique(c * (1 << 40) + n.astype(np.int64), return_inverse=True)
        beside, times = pair >> 40, (pair & ((1 << 40) - 1)).astype(float)
        table = _f(cells[:, beside].T + times[:, None]) - _f(cells[:, beside].T)
        starts = np.nonzero(np.diff(w, prepend=-1))[0]
        if len(starts):
            gain[w[starts]] += np.add.reduceat(table[which], starts)
        there = cells[own[w], c]
        stay += np.bincount(w, _f(there) - _f(np.maximum(there - n, 0)), minlength=words)
        total, row = counts.sum(1), cells.sum(1)
        table, which = _added(row, total)
        gain -= table[which]
        stay -= _f(row[own]) - _f(np.maximum(row[own] - total, 0))
    gain[:, 0] = -np.inf
    every = np.arange(words)
    gain[every, own] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[every, best] > stay + 1e-6, best, own)


def head_classes(encoded: DataFrame, model: Model, first: int) -> np.ndarray:
    """Classes of the words of the head, those from the ``first`` on by their contexts."""
    c, unit_class, n_head = model.classes, model.unit_class, len(model.head)
    own = unit_class[model.head_unit]
    if n_head <= first:
        return own
    of_head, moves = np.append(own, unit_class[END]), model.moves

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["k", "v"])

        for b in batches:
            cls, codes, _ = _sequence(b, of_head, unit_class)
            cls = np.concatenate([[unit_class[END]], cls])
            at = np.nonzero((codes >= first) & (codes < _END))[0]
            word = codes[at].astype(np.int64) * (2 * c)
            held += [word + cls[at], word + c + cls[at + 2]]  # a text ends with END, so a word has a follower
            if sum(map(len, held)) > 2_000_000:
                yield from counted()
        if held:
            yield from counted()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, lists = b.column("word").to_numpy(), b.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            at = np.repeat(np.arange(len(word)), sizes) * (2 * c) + flat.field(0).to_numpy()
            both = np.bincount(at, flat.field(1).to_numpy(), minlength=len(word) * 2 * c).reshape(len(word), 2, c)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(best_class(moves, both[:, 1], both[:, 0], own[word]))], ["word", "class"])

    sums = encoded.select("codes", "units").mapInArrow(contexts, "k long, v long").groupBy("k").agg(F.sum("v").alias("v"))
    by_word = sums.groupBy(F.expr(f"k div {2 * c}").alias("word")).agg(F.collect_list(F.struct(F.expr(f"k % {2 * c}").alias("c"), "v")).alias("x"))
    out = own.copy()
    for r in by_word.mapInArrow(settle, "word long, class long").collect():  # a row a word of the head
        out[r.word] = r["class"]
    return out


def fit(encoded: DataFrame, model: Model, units: int, words: int) -> None:
    """Classes of the core and of the head."""
    train = encoded.where("not held_out")
    pairs = unit_pairs(train, model.head_unit, units)
    model.unit_class = exchange(pairs, model.classes)
    hot = np.eye(model.classes)[model.unit_class]
    model.moves = hot.T @ pairs @ hot
    model.head_class = head_classes(train, model, words)


def places(encoded: DataFrame, model: Model) -> DataFrame:
    """word, rid, pos, context: the places of the words outside the head. context: whether it is a training text, the word's first class, and
    the classes before and after, as one number."""
    c, unit_class = model.classes, model.unit_class
    of_head = np.append(unit_class[model.head_unit], unit_class[END])  # the classes that ``moves`` counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, codes, sizes = _sequence(b, of_head, unit_class)
            at = np.nonzero(codes == _TAIL)[0]
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            around = np.concatenate([[unit_class[END]], cls])
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            context = ((train[doc] * c + cls[at]) * c + around[at]) * c + around[at + 2] if len(at) else np.empty(0, np.int64)
            cols = [b.column("tail").flatten(), pa.array(b.column("rid").to_numpy()[doc]), pa.array((at - (np.cumsum(sizes) - sizes)[doc]).astype(np.int32)), pa.array(context.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays(cols, ["word", "rid", "pos", "context"])
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)

    return encoded.select("rid", "held_out", "codes", "tail", "units").mapInArrow(run, "word string, rid long, pos int, context int")


def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word, in batches that hold whole words."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        word = b.column("word")
        if held and held[0].column("word")[0].as_py() != word[0].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        new = np.nonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))[0] + 1
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, new[-1])]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(new[-1] if len(new) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def settled(rows: DataFrame, model: Model, lexicon: bool = False) -> DataFrame:
    """rows: ``places`` -> rid, v, c: place (from bit 16), whether it is the word's first in training (bit 8), class, and count of the word; for
    the lexicon word, c, class."""
    c, moves = model.classes, model.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_word(batches):
            word, context = b.column("word"), b.column("context").to_numpy().astype(np.int64)
            start = np.concatenate([[0], np.nonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))[0] + 1])
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, b.num_rows)))
            train, own = np.nonzero(context // c**3)[0], (context // c**2 % c)[start]
            g = group[train]
            count = np.bincount(g, minlength=len(start))
            beside = lambda x: np.bincount(g * c + x[train], minlength=len(start) * c).reshape(-1, c).astype(float)
            cls = np.concatenate(
                [best_class(moves, s, p, o) for s, p, o in zip(*(np.array_split(x, max(1, len(start) // 20_000)) for x in (beside(context % c), beside(context // c % c), own)), strict=True)]
            )
            if lexicon:
                known = count > 0
                yield pa.RecordBatch.from_arrays([word.take(pa.array(start[known])), pa.array(count[known]), pa.array(cls[known])], ["word", "c", "class"])
                continue
            first = np.zeros(b.num_rows, np.int64)
            first[train[np.nonzero(np.diff(g, prepend=-1))[0]]] = 1
            v = b.column("pos").to_numpy().astype(np.int64) << 16 | first << 8 | cls[group]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(v), pa.array(count[group])], ["rid", "v", "c"])

    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, c long, class long" if lexicon else "rid long, v long, c long")


def sequences(encoded: DataFrame, places_: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs (sum of log10 (c + 0.1)), classes (a byte a token; bit 7: first place of a word outside the head)."""
    of_class = np.append(model.head_class, model.unit_class[END]).astype(np.uint8)
    of_log = np.log10(np.append(model.head_count, model.ends) + ADD)
    of_known = np.append(model.head_count, model.ends) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, sizes = _ragged(b.column("codes"), np.uint16)
            start = np.cumsum(sizes) - sizes
            entry = np.where(codes >= _END, len(of_class) - 1, codes)
            cls, log, known = of_class[entry], of_log[entry], of_known[entry]
            lists = b.column("x")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            v, count = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            at = np.repeat(start, n) + (v >> 16)
            if len(at) != int((codes == _TAIL).sum()):
                raise ValueError("places were lost")
            cls[at] = (v & 0x7F) | (v >> 8 & 1) << 7
            log[at], known[at] = np.log10(count + ADD), count > 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), start)), pa.array(np.add.reduceat(log, start)), _binary(cls, sizes)],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"],
            )

    lists = places_.groupBy("rid").agg(F.collect_list(F.struct("v", "c")).alias("x"))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("rid", "doc_id", "held_out", "codes").join(lists, "rid", "left")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, classes binary")


def count_classes(sequences_: DataFrame, model: Model) -> None:
    """Transitions and sizes of the classes, over all training texts."""
    c = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c * c + c, np.int64)
        for b in batches:
            flat = np.concatenate([[0], _ragged(b.column("classes"), np.uint8)[0]]).astype(np.int64)
            plain = flat & 0x7F
            total[: c * c] += np.bincount(plain[:-1] * c + plain[1:], minlength=c * c)
            total[c * c :] += np.bincount(plain[flat > 0x7F], minlength=c)
        yield from _sparse(total)

    sums = _sums(sequences_.where("not held_out").select("classes").mapInArrow(run, "k int, v long"), c * c + c)
    moves, kinds = sums[: c * c].reshape(c, c), sums[c * c :]
    kinds += np.bincount(model.head_class[model.head_count > 0], minlength=c)
    kinds[model.unit_class[END]] += model.ends > 0
    size = moves.sum(0)
    prior = (size + 1) / (size.sum() + c)
    model.step = np.log10((moves + 5 * prior) / (moves.sum(1, keepdims=True) + 5))
    model.room = np.log10(size + ADD * (kinds + 1))


def _prepare(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, folds: int, classes: int, words: int, endings: int, head: int) -> tuple[DataFrame, Model]:
    """The encoded texts, written, and the model with the classes of core and head."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("doc_id"), (fold(quoted(id_col), folds) == 0).alias("held_out"), utf8(quoted(text_col)).alias("t")
    )
    train = rows.where("not held_out").select("t")
    counts = scratch.write(word_counts(train))
    ends = train.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    top = [(r.word, r.c) for r in counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(head).collect()]
    core = spark.createDataFrame([(w,) for w, _ in top[:words]], "word string")
    rest = counts.join(F.broadcast(core), "word", "left_anti").groupBy(F.substring("word", -2, 2).alias("ending"))
    common = rest.agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(endings).collect()
    scratch.drop(counts)
    of_ending = {r.ending: k + 2 + words for k, r in enumerate(common)}
    names = [w.encode() for w, _ in top]
    head_unit = np.array([k + 2 if k < words else of_ending.get(ending(w), RARE) for k, w in enumerate(names)], np.int64)
    empty = np.empty(0, np.int64)
    model = Model(
        classes, {w: k for k, w in enumerate(names)}, np.array([c for _, c in top], np.int64), head_unit, of_ending, empty, empty, empty, total.n + ends, total.v + (ends > 0), ends
    )
    encoded = scratch.write(encode(rows, model.head, of_ending))
    fit(encoded, model, words + endings + 2, words)
    return encoded, model


def word_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, classes: int = CLASSES, words: int = WORDS, endings: int = ENDINGS, head: int = HEAD) -> DataFrame:
    """word, c, class of every training word."""
    scratch = Scratch(docs.sparkSession, "brown")
    encoded, model = _prepare(docs, scratch, id_col, text_col, folds, classes, words, endings, head)
    top = [(w.decode(), int(n), int(k)) for w, n, k in zip(model.head, model.head_count, model.head_class, strict=True)]
    return docs.sparkSession.createDataFrame(top, "word string, c long, class long").unionByName(settled(places(encoded, model), model, True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, classes: int = CLASSES, words: int = WORDS, endings: int = ENDINGS, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the class model).

    classes: at most 127, END having one for itself; words, endings: units of the core; head: words that are broadcast, at most ``HEAD``."""
    scratch = Scratch(docs.sparkSession, "brown")
    encoded, model = _prepare(docs, scratch, id_col, text_col, folds, classes, words, endings, head)
    scored = scratch.write(sequences(encoded, settled(places(encoded, model), model), model))
    scratch.drop(encoded)
    count_classes(scored, model)
    step, room, end_class = model.step, model.room, int(model.unit_class[END])
    all_room = float(np.log10(model.tokens + ADD * (model.kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = _ragged(b.column("classes"), np.uint8)
            cls = np.concatenate([[end_class], flat & 0x7F])
            moved = np.add.reduceat(step[cls[:-1], cls[1:]] - room[cls[1:]], np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
            logs, n = b.column("logs").to_numpy(), b.column("n_tokens").to_numpy()
            full = logs + moved
            with np.errstate(over="ignore"):
                perplexity = 10.0 ** (-full / n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), b.column("n_known"), pa.array(logs - n * all_room), pa.array(full), pa.array(perplexity)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    kind = scored.schema["doc_id"].dataType.simpleString()
    out = scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
