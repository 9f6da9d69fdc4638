"""SentencePiece segmentations sampled without replacement, and their decoding.

A text's lattice has an edge for each vocabulary piece that matches at a place; a character that no piece covers is spelled by
its byte pieces. A piece of rank r weighs ``(r + 10) ** -alpha``, and a segmentation's probability is the product of its
weights over the lattice's total. Pieces never reach over the beginning of a run of spaces or a line feed, so the lattice is a chain of
small ones, one a chunk, and equal chunks of a batch share theirs.

Gumbel top-k by perturbed A*-search: the search's regions are sets of segmentations that share a prefix and leave it at one
place. A region's bound is a Gumbel variable at the logarithm of its mass, truncated at its parent's. The best region gives the next
segmentation and is split at every place where the rest may leave it; the best bounds in turn give k distinct segmentations in
the order of their perturbed log probabilities. The bound after them, kappa, gives each one's inclusion score,
1 - exp(-exp(log p - kappa)). Nothing is enumerated: a round costs a text's length.

Random numbers come from a hash of the row's key, so reruns agree. Null and empty texts have one, empty, segmentation; a
text with fewer than k segmentations gives all it has. A literal U+2581 decodes to a space, as with the library. Rows of one key and text agree. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a chunk whose path sums fit a double without scaling.
LONG = 60
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys, by the splitmix finaliser."""
    x = (key ^ (key >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


#: Bits of a slot of the transition table, and of a character's number in a key.
BITS, CHAR = 19, 13


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


class Pieces:
    """A vocabulary: prefixes with the piece that they are, weights, and the bytes that each piece stands for."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.trie: dict[str, int] = {}
        self.weight: list[float] = []
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        n = sp.get_piece_size()
        first = next(i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.weight.append(float(max(i - first, 0) + 10) ** -alpha)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                for k in range(1, len(piece)):
                    self.trie.setdefault(piece[:k], -1)
                self.trie[piece] = i
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.trie):
            raise ValueError("pieces of this vocabulary reach over chunks")
        # the trie as a hash table of transitions: state and number of a character (0: in no piece) to state; state 0 is the empty prefix
        state = {"": 0} | {p: k + 1 for k, p in enumerate(self.trie)}
        chars = sorted({c for p in self.trie for c in p})
        if len(chars) >= 1 << CHAR or len(state) >= 1 << (31 - CHAR):
            raise ValueError("this vocabulary has too many prefixes or characters")
        self.char_of = np.zeros(0x110000, np.int32)
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.keys, self.to = np.full(1 << BITS, -1, np.int32), np.zeros(1 << BITS, np.int32)
        keys = np.array([state[p[:-1]] << CHAR | self.char_of[ord(p[-1])] for p in state if p], np.int32)
        for slot, key, k in zip(_slot(keys).tolist(), keys.tolist(), range(1, len(state)), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << BITS) - 1)
            self.keys[slot], self.to[slot] = key, k
        #: state after the first character, 0 where no piece begins so
        self.start_of = np.zeros(len(chars) + 1, np.int32)
        self.start_of[[self.char_of[ord(p)] for p in self.trie if len(p) == 1]] = [state[p] for p in self.trie if len(p) == 1]
        self.piece_of = np.array([-1, *self.trie.values()], np.int32)
        self.size, self.alpha, self._weights = n, alpha, np.empty(0)
        self.spelled: list[list[int]] = [[i] for i in range(n)]
        self.spelling: dict[str, int] = {}

    def follow(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which transitions there are, and the states that they lead to."""
        slot = _slot(key)
        held = self.keys[slot]
        late = np.nonzero((held != key) & (held >= 0))[0]
        while len(late):  # the next slots, while they are taken by others
            slot[late] = (slot[late] + np.uint32(1)) & np.uint32((1 << BITS) - 1)
            held[late] = self.keys[slot[late]]
            late = late[(held[late] != key[late]) & (held[late] >= 0)]
        hit = held == key
        return hit, self.to[slot[hit]]

    def weights(self) -> np.ndarray:
        if len(self._weights) != len(self.weight):
            self._weights = np.array(self.weight)
        return self._weights

    def spell(self, char: str) -> int:
        """Number of the byte pieces of a character, past the vocabulary unless it is one byte."""
        if char not in self.spelling:
            ids = [self.byte_ids[b] for b in char.encode()]
            if len(ids) == 1:
                self.spelling[char] = ids[0]
            else:
                self.spelling[char] = len(self.spelled)
                self.spelled.append(ids)
                self.bytes.append(char.replace(SPACE, " ").encode())
                self.weight.append(math.prod(self.weight[i] for i in ids))
        return self.spelling[char]


@lru_cache(2)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


class Lattices:
    """Lattices of the distinct chunks of a batch, built together. A node is a character of a chunk; the edges of a node stand together, the
    longest first: piece, node that follows (-1 at the chunk's end), log probability and cumulative probability."""

    def __init__(self, vocab: Pieces):
        self.vocab = vocab

    def build(self, chunks: list[str]) -> np.ndarray:
        """Start node of each of the distinct chunks."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes > LONG, kind="stable")
        sizes = sizes[order]
        n_short = int(np.searchsorted(sizes > LONG, True))
        if n_short < len(chunks):
            chunks = [chunks[k] for k in order]
        offsets = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        cp = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        end = np.repeat((offsets + sizes).astype(np.int32), sizes)
        first, at, to, piece = self._edges(cp, end)
        weight = self.vocab.weights().take(piece)
        far = end.take(at)
        last = to == far
        far -= at
        self.a_first, self.a_piece, self.a_next = first, piece, np.where(last, np.int32(-1), to)
        # backward sums of the paths to the chunk's end, by distance from it
        plain = int(first[offsets[n_short]]) if n_short < len(order) else len(at)
        far = far[:plain].astype(np.uint8)
        by_far = np.argsort(far, kind="stable")
        stops = np.searchsorted(far[by_far], np.arange(1, LONG + 2))
        back, value = np.zeros(total + 1), np.empty(plain)
        here, follow = at[by_far], np.where(last[:plain], np.int32(total), to[:plain])[by_far]
        back[total], heavy = 1.0, weight[by_far]
        group = np.nonzero(np.concatenate([np.ones(min(plain, 1), bool), here[1:] != here[:-1]]))[0]  # where the edges of a place begin
        place, parts = here[group], np.searchsorted(group, stops)
        for lo, hi, g, h in zip(stops.tolist(), stops[1:].tolist(), parts.tolist(), parts[1:].tolist(), strict=False):
            if lo < hi:
                np.multiply(heavy[lo:hi], back.take(follow[lo:hi]), out=value[lo:hi])
                back[place[g:h]] = np.add.reduceat(value[lo:hi], group[g:h] - lo)
        q = np.empty(len(at))
        value /= back.take(here)
        q[by_far] = value
        for k in range(n_short, len(order)):  # few; sums are scaled as they would underflow
            lo, hi = first[offsets[k]], first[offsets[k] + sizes[k]]
            q[lo:hi] = np.exp(self._long(at[lo:hi] - offsets[k], to[lo:hi] - offsets[k], weight[lo:hi], int(sizes[k])))
        upto = np.cumsum(q)
        head = first[:-1]
        self.a_cum = upto - (upto.take(head) - q.take(head)).take(at)
        self.a_cum[first[1:] - 1] = 2.0
        self.a_logq = np.log(np.maximum(q, 1e-300))
        start = np.empty(len(chunks), np.int64)
        start[order] = offsets
        return start

    def _edges(self, cp: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first edge of each place, from, to, piece) of every piece that matches at a place; a place's longest piece is first, as
        the likeliest mostly is."""
        v, places = self.vocab, np.arange(len(cp), dtype=np.int32)
        char, end = v.char_of[cp], end.astype(np.int32)
        live, found, n = places, [], 0
        counts = np.zeros(len(cp), np.int32)
        while len(live):
            if n:
                on = np.nonzero(live + np.int32(n) < end.take(live))[0]
                live, state = live.take(on), state.take(on)
                hit, state = v.follow((state << np.int32(CHAR)) | char[live + np.int32(n)])
                live = live[hit]
            else:
                state = v.start_of.take(char)
                live = np.nonzero(state)[0].astype(np.int32)
                state = state.take(live)
            n += 1
            piece = v.piece_of[state]
            is_piece = piece >= 0
            which = np.nonzero(is_piece)[0]
            place = live.take(which)
            shorter = counts.take(place)
            counts[place] = shorter + np.int32(1)
            found.append((place, n, piece.take(which), shorter))
        bare = np.nonzero(counts == 0)[0]
        chars, which = np.unique(cp[bare], return_inverse=True)
        spelled = np.array([v.spell(chr(c)) for c in chars], np.int64)[which] if len(bare) else np.empty(0, np.int64)
        found.append((bare, 1, spelled, np.int32(0)))
        counts[bare] = 1
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        final, to, piece = first[1:] - np.int32(1), np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        for place, n, which_piece, shorter in found:
            at = final.take(place) - shorter
            to[at], piece[at] = place + n, which_piece
        return first, np.repeat(places, counts), to, piece

    @staticmethod
    def _long(at: np.ndarray, to: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of one long chunk's edges, given in the order of places."""
        log, back = np.log(weight), np.zeros(n + 1)
        first = np.searchsorted(at, np.arange(n + 1))
        for k in range(n - 1, -1, -1):
            x = log[first[k] : first[k + 1]] + back[to[first[k] : first[k + 1]]]
            top = x.max()
            back[k] = top + np.log(np.exp(x - top).sum())
        return log + back[to] - back[at]

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path from each node to its chunk's end (-1: none), one after another, and their counts."""
        live = np.nonzero(nodes >= 0)[0]
        at, key, counts, steps = nodes.take(live), keys.take(live), np.zeros(len(nodes), np.int64), []
        while len(live):
            key = key + _STEP
            u, e = uniform(key), self.a_first.take(at)
            late = np.nonzero(u >= self.a_cum.take(e))[0]
            while len(late):
                now = e.take(late) + np.int32(1)
                e[late] = now
                late = late.compress(u.take(late) >= self.a_cum.take(now))
            steps.append((live, e))
            counts[live] += 1
            at = self.a_next.take(e)
            on = np.nonzero(at >= 0)[0]
            live, at, key = live.take(on), at.take(on), key.take(on)
        start = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for k, (i, e) in enumerate(steps):
            flat[start.take(i) + k] = e
        return flat, counts


class Path:
    """A sampled segmentation of a text: its edges, and of the first of them (``head``) the chunks and the bounds of the regions that leave the
    path there."""

    __slots__ = ("edges", "chunk", "bound", "branch", "barred", "value", "logp", "top")

    def __init__(self, edges: np.ndarray, chunk: np.ndarray, branch: int, barred: tuple[int, ...], value: float, logp: float):
        self.edges, self.chunk, self.branch, self.barred, self.value, self.logp = edges, chunk, branch, barred, value, logp

    def bounded(self, bound: np.ndarray) -> None:
        self.bound = bound
        self.top = float(bound.max(initial=-np.inf))

    def take(self, j: int) -> None:
        """The region at j is no longer this path's."""
        self.bound[j] = -np.inf
        self.top = float(self.bound.max(initial=-np.inf))


def bounds(phi: np.ndarray, top: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at phi, truncated at top."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = phi - np.log(-np.log(u) + np.exp(phi - top))
    return np.where(np.isfinite(phi), np.minimum(out, top), -np.inf)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, whose spaces are written as U+2581."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " ":
        return _CHUNKS.findall(SPACE + text.replace(" ", SPACE))
    return list(filter(None, (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ")))


def sample(texts: list[str], keys: list[int], lattices: Lattices, k: int) -> Iterator[tuple[list[Path], float]]:
    """Of each text, up to k distinct segmentations and the bound after the last (kappa)."""
    chunks = [chunks_of(t) for t in texts]
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    number: dict[str, int] = {}
    which = np.array([number.setdefault(c, len(number)) for c in chain.from_iterable(chunks)], np.int64)
    starts = lattices.build(list(number))[which]
    key = np.array(keys, np.int64).view(np.uint64)
    ends = np.cumsum(sizes)
    began = ends - sizes
    item_key = uniform_key(np.repeat(key, sizes), np.arange(len(starts)) - np.repeat(began, sizes))
    flat, counts = lattices.walk(starts, item_key)
    where = np.concatenate([[0], np.cumsum(counts)])
    chunk_of = np.repeat((np.arange(len(starts)) - np.repeat(began, sizes)).astype(np.int32), counts)
    total = np.concatenate([[0.0], np.cumsum(lattices.a_logq[flat])])
    tops = -np.log(-np.log(uniform(key * _M1 + _STEP)))
    first = []
    for lo, hi, top in zip(where[began].tolist(), where[ends].tolist(), tops.tolist(), strict=True):
        first.append(Path(flat[lo:hi], chunk_of[lo:hi], 0, (), top, float(total[hi] - total[lo])))
    _bound(lattices, first, key, k)
    done = [[p] for p in first]
    for r in range(1, k):
        nodes, node_keys, picked = [], [], []
        draws = uniform(uniform_key(key, np.full(len(key), (1 << 51) + r))).tolist()
        for d, paths in enumerate(done):
            best = paths[0] if len(paths) == 1 else max(paths, key=lambda p: p.top)
            if len(paths) < r or best.top == -np.inf:
                continue
            j = int(best.bound.argmax())
            value, barred = best.top, (int(best.edges[j]), *(best.barred if j == best.branch else ()))
            c = int(best.chunk[j])
            e = _other(lattices, _node(lattices, int(best.edges[j])), barred, draws[d])
            best.take(j)
            own = starts[began[d] + c : ends[d]].copy()
            own[0] = lattices.a_next[e]
            nodes.append(own)
            picked.append((d, best, j, e, c, barred, value, len(own)))
        if not picked:
            break
        n = np.array([x[-1] for x in picked])
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat, counts = lattices.walk(np.concatenate(nodes), uniform_key(np.repeat(key[[x[0] for x in picked]], n), at + (r << 40)))
        where = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0.0], np.cumsum(lattices.a_logq[flat])])
        chunk_of = np.repeat((at + np.repeat([x[4] for x in picked], n)).astype(np.int32), counts)
        cuts = where[np.concatenate([[0], np.cumsum(n)])].tolist()
        new = []
        for (d, best, j, e, c, barred, value, _), lo, hi in zip(picked, cuts, cuts[1:], strict=False):
            edges = np.concatenate([best.edges[:j], np.array([e], np.int32), flat[lo:hi]])
            of = np.concatenate([best.chunk[:j], np.array([c], np.int32), chunk_of[lo:hi]])
            logp = float(lattices.a_logq[edges[: j + 1]].sum() + total[hi] - total[lo])
            new.append(Path(edges, of, j, barred, value, logp))
            done[d].append(new[-1])
        _bound(lattices, new, uniform_key(key, np.full(len(key), (1 << 52) + r))[[x[0] for x in picked]], k)
    for paths in done:
        yield paths, max(p.top for p in paths)


def uniform_key(key: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A key per item of a row."""
    x = (key + item.astype(np.uint64) * _M2) * _M1
    return x ^ (x >> np.uint64(29))


#: Edges of a path whose regions are bounded at first: later ones mostly have too little mass to be among the best.
HEAD = 64


def _bound(lat: Lattices, paths: list[Path], key: np.ndarray, k: int, head: int = HEAD) -> None:
    """Give paths the bounds of the regions that leave them, from the branch on, where the edges ``barred`` belong to others."""
    if not paths:
        return
    n = np.array([min(len(p.edges), max(head, p.branch + 1)) for p in paths])
    start, total = np.cumsum(n) - n, int(n.sum())
    flat = np.concatenate([p.edges[:m] for p, m in zip(paths, n.tolist(), strict=True)])
    at = np.arange(total) - np.repeat(start, n)
    logq = lat.a_logq[flat]
    after = np.cumsum(logq)
    before = after - logq
    before -= np.repeat(before[np.minimum(start, max(total - 1, 0))], n) if total else 0
    taken = np.exp(logq)
    barred = [(start[i] + p.branch, e) for i, p in enumerate(paths) for e in p.barred]
    if barred:
        place, edge = np.array(barred).T
        np.add.at(taken, place, np.exp(lat.a_logq[edge]))
    with np.errstate(divide="ignore"):
        left = np.where(taken < 1 - 1e-12, np.log1p(-np.minimum(taken, 1)), -np.inf)
    u = uniform(uniform_key(np.repeat(key, n), at + (1 << 50)))
    bound = bounds(before + left, np.repeat([p.value for p in paths], n), u)
    bound[at < np.repeat([p.branch for p in paths], n)] = -np.inf
    again = []
    for i, (p, lo, m) in enumerate(zip(paths, start.tolist(), n.tolist(), strict=True)):
        own = bound[lo : lo + m].copy()
        # a bound is at most 37 over its region's mass, so regions of much less mass than the k-th bound so far cannot be among the best k
        if m < len(p.edges) and (m <= k or np.partition(own, -k)[-k] <= before[lo + m - 1] + logq[lo + m - 1] + 37):
            again.append(i)
        p.bounded(own)
    if again:
        _bound(lat, [paths[i] for i in again], key[again], k, 1 << 62 if head > HEAD else 16 * head)


def _node(lat: Lattices, edge: int) -> int:
    return int(np.searchsorted(lat.a_first, np.int32(edge), side="right")) - 1


def _other(lat: Lattices, node: int, barred: tuple[int, ...], u: float) -> int:
    """An edge of the node other than the barred ones, by probability."""
    free = [e for e in range(int(lat.a_first[node]), int(lat.a_first[node + 1])) if e not in barred]
    q = np.exp(lat.a_logq[free])
    return free[min(int(np.searchsorted(np.cumsum(q) / q.sum(), u, side="right")), len(free) - 1)]


class Spelling:
    """What pieces stand for, as one array."""

    def __init__(self, vocab: Pieces):
        self.n = len(vocab.bytes)
        self.of = pa.array(vocab.bytes, pa.large_binary())

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """Bytes of runs of pieces, which end at ``cuts``."""
        if not len(ids):
            return [b""] * len(cuts)
        _, ends, data = self.of.take(pa.array(ids)).buffers()
        at = np.frombuffer(ends, np.int64)[np.concatenate([[0], cuts])].tolist()
        data = data.to_pybytes() if data is not None else b""
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def ids_of(vocab: Pieces, numbers: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids of runs of piece numbers that end at ``cuts``, and where they end: spelled characters become their byte pieces."""
    numbers = numbers.astype(np.int32)
    late = np.nonzero(numbers >= vocab.size)[0]
    if not len(late):
        return numbers, cuts
    parts, at, longer = [], 0, np.zeros(len(numbers) + 1, np.int64)
    for k in late.tolist():
        spelled = vocab.spelled[numbers[k]]
        parts += [numbers[at:k], np.array(spelled, np.int32)]
        at, longer[k + 1] = k + 1, len(spelled) - 1
    return np.concatenate([*parts, numbers[at:]]), cuts + np.cumsum(longer)[cuts]


def decode_ids(vocab: Pieces, ids: np.ndarray) -> str:
    """Text of vocabulary ids."""
    return b"".join(vocab.bytes[i] for i in ids)[1:].decode()


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, alpha: float = 1.0, seed: int = 17, model: str = MODEL, ids: int = 1 << 30) -> DataFrame:
    """Per document: doc_id, n_samples, kappa, samples (log_prob, perturbed, inclusion, n_ids, ids_sha256, ids), decoded (all
    samples decode to the text). ids: the first so many samples carry their vocabulary ids, the others null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model, alpha)
        lattices, spelling = Lattices(vocab), Spelling(vocab)
        for b in slices(batches, "t", 512 << 10):
            texts = [t or "" for t in b.column("t").to_pylist()]
            found = list(sample(texts, b.column("key").to_pylist(), lattices, k))
            paths = [p for ps, _ in found for p in ps]
            numbers = lattices.a_piece[np.concatenate([p.edges for p in paths])] if paths else np.empty(0, np.int32)
            if len(vocab.bytes) != spelling.n:
                spelling = Spelling(vocab)
            cuts = np.cumsum([len(p.edges) for p in paths])
            plain = spelling.decode(numbers, cuts)
            flat, upto = ids_of(vocab, numbers, cuts)
            edge = [0, *upto.tolist()]
            sizes, kappas, good, inclusion, at = [], [], [], [], 0
            for text, (ps, kappa) in zip(texts, found, strict=True):
                want = b" " + text.replace(SPACE, " ").encode() if text else b""
                good.append(all(x == want for x in plain[at : at + len(ps)]))
                at += len(ps)
                sizes.append(len(ps))
                kappas.append(kappa if kappa > -math.inf else None)
                inclusion += [-math.expm1(-math.exp(min(p.logp - kappa, 50.0))) if kappa > -math.inf else 1.0 for p in ps]
            raw = memoryview(flat.astype("<i4", copy=False)).cast("B")
            lists = pa.ListArray.from_arrays(pa.array(np.array(edge, np.int32)), pa.array(flat))
            if ids < k:
                which = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, int)
                lists = pc.if_else(pa.array(which < ids), lists, pa.scalar(None, lists.type))
            samples = pa.StructArray.from_arrays(
                [pa.array([p.logp for p in paths], pa.float64()), pa.array([p.value for p in paths], pa.float64()), pa.array(inclusion, pa.float64()),
                 pa.array(np.diff(edge).astype(np.int32)), pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(edge, edge[1:], strict=False)], pa.string()), lists],
                ["log_prob", "perturbed", "inclusion", "n_ids", "ids_sha256", "ids"],
            )
            upto = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(kappas, pa.float64()), pa.ListArray.from_arrays(upto, samples), pa.array(good, pa.bool_())],
                ["doc_id", "n_samples", "kappa", "samples", "decoded"],
            )

    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = "array<struct<log_prob:double,perturbed:double,inclusion:double,n_ids:int,ids_sha256:string,ids:array<int>>>"
    return rows.mapInArrow(run, f"doc_id long, n_samples int, kappa double, samples {kind}, decoded boolean")
