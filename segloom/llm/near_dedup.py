"""SimHash near-dedup with vantage-point trees.

A text's fingerprint is the 64-bit SimHash of its word shingles. Two fingerprints link at ``radius`` or fewer differing bits,
and such links are found exactly:

- Of two fingerprints that differ in at most 3 bits, one half differs in at most 1. So one tree is built for each half, whose
  metric is the Hamming distance of that half and whose search radius is 1; a pair is missed by no tree that holds its closer half.
- A tree's vantage points and median radii come from a bounded sample (``SAMPLE`` fingerprints at most, so that shards hold about ``SHARD``
  fingerprints up to 10^9 of them and 80,000 at 2 * 10^10). Each fingerprint is stored
  in one shard and is also sent as a query to the shards that its ball overlaps, by the triangle bound.
- In a shard the same splitting goes on, at first with the half's metric and, where that cannot split, with the whole
  fingerprint's, until blocks are small enough to compare. A shard returns a star per group that it finds, so output is
  linear in its rows however dense a group is.
- Stars are joined to components over all shards (``components``).

Only distinct fingerprints enter the trees, so equal texts cost nothing there.

Null, empty and wordless texts have fingerprint zero and link like any other; very long texts are read whole, their shingles in steps of
``_STEP`` words. A null id counts for no component; a group with null ids only has a null component_id. Repeated rows and equal
fingerprints each get their row, with the component they share. Extra columns are ignored or, by ``keep_first``, passed on, whatever their
names; an empty table gives an empty result.

The pipeline's stage (``keep_first``) asks for a similarity of the sets of five-word shingles. At Jaccard 0.8 a SimHash bit differs with
probability 0.15, so it takes longer fingerprints and more trees, one a piece of their bits, and checks what they find by all shingles: see
``similar_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .scratch import Scratch
from .text import numbered, quoted, slices, utf8

#: Fingerprints that the shards' vantage points are chosen from: one of ``SPARSE``, but this many at least and at most.
LEAST, SAMPLE, SPARSE = 1 << 16, 1 << 20, 1 << 10
#: Fingerprints that a shard should hold.
SHARD = 4096
#: Fingerprints that are compared block by block.
BLOCK = 256
FULL = 0xFFFFFFFFFFFFFFFF
_STEP = 1 << 17
#: The pipeline's stage: fingerprints that a shard should hold at most, the greatest share of bits in which texts of the asked similarity
#: mostly differ, and the share of them that all trees may miss.
WIDE_SHARD, DIFFER, MISS = 2048, 0.1515, 1e-4
#: Words of a fingerprint that shards compare, and the differing bits at which two link: of the first word, of all of these.
FRONT, NEAR = 3, (22, 50)
#: A shard of more fingerprints first looks for vantage points that many of them are near to.
CROWD = 4 * WIDE_SHARD
#: Bytes of candidate texts that are compared in one task.
LIMIT = 8 << 20
SLACK = 1e-9
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of the whole text: a bit is set where over half of the shingles' XXH64 (seed 42) have it set."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    n, total = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, len(part) - width + 1)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            fp = np.fromiter((simhash(t, width) for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return ids.mapInArrow(run, "doc_id long, fp long")


# --- vantage-point trees -------------------------------------------------------------------------------------------------


def split(points: np.ndarray, mask: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point among ``points`` and a median radius that leaves points on both sides; None if all look alike."""
    for k in (0, len(points) // 2, len(points) - 1):
        d = np.bitwise_count((points ^ points[k]) & np.uint64(mask))
        low, high = int(d.min()), int(d.max())
        if low < high:
            return points[k], min(max(int(np.median(d)), low), high - 1), d
    return None


def grow(sample: np.ndarray, metrics: list[tuple[int, int]], leaf: int) -> tuple | None:
    """Tree over the sample: (vantage point, mask, search radius, median radius, inner, outer), None for a shard.
    metrics: masks with their search radii; a later one serves where an earlier one cannot split."""
    if len(sample) > leaf:
        for mask, r in metrics:
            if (found := split(sample, mask)) is not None:
                p, m, d = found
                return p, mask, r, m, grow(sample[d <= m], metrics, leaf), grow(sample[d > m], metrics, leaf)
    return None


def route(tree: tuple | None, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indices of points, stored there or asking there), shards numbered in the tree's order. Every point is stored
    once. Of two points that part, the outer one asks the inner side, so that each near pair meets."""
    count = 0
    todo = [(tree, np.arange(len(points)), np.empty(0, np.int64))]
    while todo:
        node, own, asks = todo.pop()
        if node is None:
            if len(own):
                yield count, own, True
            if len(asks):
                yield count, asks, False
            count += 1
            continue
        p, mask, r, m, inner, outer = node
        d, e = (np.bitwise_count((points[x] ^ p) & np.uint64(mask)).astype(np.int16) for x in (own, asks))
        todo.append((outer, own[d > m], asks[e > m - r]))
        todo.append((inner, own[d <= m], np.concatenate([own[(d > m) & (d <= m + r)], asks[e <= m + r]])))


class Groups:
    """Union-find over indices, many unions at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while (x != (y := self.up[x])).any():
            x = y
        return x

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link(points: np.ndarray, own: np.ndarray, asks: np.ndarray, metrics: list[tuple[int, int]], radius: int, groups: Groups) -> None:
    """Unite what is within ``radius``: stored points with each other and with the asking ones."""
    todo = [(own, asks, metrics)]
    while todo:
        own, asks, left = todo.pop()
        if not len(own) or len(own) + len(asks) < 2:
            continue
        found = None
        if len(own) > BLOCK:
            while left and (found := split(points[own], left[0][0])) is None:
                left = left[1:]
        if found is None:
            both = np.concatenate([own, asks])
            for at in range(0, len(own), BLOCK):
                some = own[at : at + BLOCK]
                for to in range(at, len(both), 1 << 13):
                    other = both[to : to + (1 << 13)]
                    i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[other][None, :]) <= radius)
                    groups.union(some[i], other[j])
            continue
        p, m, d = found
        mask, r = left[0]
        e = np.bitwise_count((points[asks] ^ p) & np.uint64(mask)).astype(np.int16)
        d = d.astype(np.int16)
        todo.append((own[d > m], asks[e > m - r], left))
        todo.append((own[d <= m], np.concatenate([own[(d > m) & (d <= m + r)], asks[e <= m + r]]), left))


def halves(radius: int) -> list[list[tuple[int, int]]]:
    """Metrics of each tree: a half of the bits with half the radius, then all bits with the whole one."""
    return [[(half, radius // 2), (FULL, radius)] for half in (0xFFFFFFFF, 0xFFFFFFFF00000000)]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, width))
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    count = nodes.count()
    most = min(max(LEAST, count // SPARSE), SAMPLE)
    chosen = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most) if count > most else nodes.select("fp")
    sample = np.sort(np.array([r.fp for r in chosen.collect()], np.int64).view(np.uint64))
    np.random.default_rng(7).shuffle(sample)
    trees = [(m, grow(sample, m, max(4, SHARD * len(sample) // max(count, 1)))) for m in halves(radius)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("fp").to_numpy().view(np.uint64)
            for k, (_, tree) in enumerate(trees):
                for shard, at, stored in route(tree, points):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), 2 * shard + k)), pa.array(points[at].view(np.int64)), pa.array(np.full(len(at), stored))], ["shard", "fp", "stored"]
                    )

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        points, stored = table.column("fp").to_numpy().view(np.uint64), table.column("stored").to_numpy()
        groups, every = Groups(len(points)), np.arange(len(points))
        link(points, every[stored], every[~stored], trees[key[0].as_py() % 2][0], radius, groups)
        root = groups.find(every)
        at = root != every
        return pa.table({"a": points[at].view(np.int64), "b": points[root[at]].view(np.int64)})

    shards = nodes.select("fp").mapInArrow(send, "shard long, fp long, stored boolean")
    links = shards.groupBy("shard").applyInArrow(meet, "a long, b long")
    roots = components(links, scratch)
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- documents by the similarity of their shingles -----------------------------------------------------------------------


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """XXH64 of the distinct word shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, len(words) - width + 1))


def wide_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 bits a word of a set of shingles: the first word from their XXH64, each further one from another hash of that."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # counts up to 255 fit a byte, eight of which are summed as one number
        x = hashes[at : at + 255, None] + _GOLDEN * np.arange(words, dtype=np.uint64)
        rest = x[:, 1:]
        rest = (rest ^ (rest >> np.uint64(30))) * _MIX1
        rest = (rest ^ (rest >> np.uint64(27))) * _MIX2
        x[:, 1:] = rest ^ (rest >> np.uint64(31))
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def forest(count: int) -> tuple[int, int, int]:
    """Bits of a piece, pieces (each has its tree) and words of the fingerprints, for so many fingerprints. Two that differ in a share
    ``DIFFER`` of their bits agree in one of the pieces at least, except for ``MISS`` of them."""
    bits = max(0, (max(count, 1) - 1) // WIDE_SHARD).bit_length()
    trees = max(1, int(np.ceil(np.log(MISS) / np.log1p(-((1 - DIFFER) ** bits))))) if bits else 1
    return bits, trees, max(FRONT, -(-bits * trees // 64))


def piece(points: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Bits k * bits and on of fingerprints, which are rows of words."""
    if not bits:
        return np.zeros(len(points), np.uint64)
    word, shift = divmod(k * bits, 64)
    value = points[:, word] >> np.uint64(shift)
    if shift + bits > 64:
        value = value | (points[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << bits) - 1)


class Shards:
    """A vantage-point tree over pieces of ``bits`` bits, walked once for each value that a piece can have: the shard that stores the value
    and those that its ball of the search radius overlaps besides."""

    def __init__(self, sample: np.ndarray, bits: int, radius: int, leaf: int):
        values = np.arange(1 << bits, dtype=np.uint64)
        self.stored, asks = np.zeros(1 << bits, np.int64), []
        for shard, at, own in route(grow(sample, [((1 << bits) - 1, radius)], leaf), values):
            if own:
                self.stored[at] = shard
            else:
                asks.append((at, np.full(len(at), shard)))
        value = np.concatenate([x for x, _ in asks]) if asks else np.empty(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.asked = np.concatenate([x for _, x in asks])[order] if asks else value
        self.many = np.bincount(value, minlength=1 << bits)
        self.first = np.cumsum(self.many) - self.many

    def send(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(shards, indices of values, stored there or asking there)."""
        yield self.stored[values], np.arange(len(values)), True
        n = self.many[values]
        if n.any():
            where = np.repeat(self.first[values] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield self.asked[where], np.repeat(np.arange(len(values)), n), False


def close_pairs(points: np.ndarray, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``some`` and of ``others`` that are within ``NEAR``, pair by pair."""
    first = np.ascontiguousarray(points[:, 0])
    i, j = np.nonzero(np.bitwise_count(first[some][:, None] ^ first[others][None, :]) <= NEAR[0])
    i, j = some[i], others[j]
    near = np.bitwise_count(points[i] ^ points[j]).sum(1, dtype=np.int16) <= NEAR[1]
    return i[near], j[near]


def link_prints(points: np.ndarray, own: np.ndarray, asks: np.ndarray, groups: Groups, crowd: int = CROWD) -> None:
    """Unite what is within ``NEAR``: stored fingerprints with each other and with the asking ones. In a crowd, what is near to a vantage point
    is one group and leaves, compared with all others but not within itself."""
    while len(own) > crowd:
        vantage = own[:: -(-len(own) // 8)]
        near, p = max(((close_pairs(points, v, own)[1], v) for v in vantage.reshape(-1, 1)), key=lambda x: len(x[0]))
        if 16 * len(near) < len(own):
            break
        groups.union(near, np.full(len(near), p[0]))
        own = np.setdiff1d(own, near)
        others = np.concatenate([own, asks])
        for at in range(0, len(near), BLOCK):
            others = others[groups.find(others) != groups.find(p)]
            for to in range(0, len(others), 1 << 13):
                groups.union(*close_pairs(points, near[at : at + BLOCK], others[to : to + (1 << 13)]))
    both = np.concatenate([own, asks])
    for at in range(0, len(own), BLOCK):
        for to in range(at, len(both), 1 << 13):
            groups.union(*close_pairs(points, own[at : at + BLOCK], both[to : to + (1 << 13)]))


def near_prints(nodes: DataFrame, count: int, bits: int, trees: int, radius: int) -> DataFrame:
    """a, b: links of fingerprints, nodes being rid, fp (distinct): a star for each group that a shard finds."""
    most = min(max(LEAST, count // SPARSE), 4 * LEAST)
    chosen = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most) if count > most else nodes.select("fp")
    sample = _words([r.fp for r in chosen.collect()]) if bits else np.empty((0, 1), np.uint64)
    leaf = max(4, WIDE_SHARD * len(sample) // max(count, 1))
    grown = [Shards(np.random.default_rng(7).permutation(np.sort(piece(sample, k, bits))), bits, radius, leaf) for k in range(trees)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, rids = _words(b.column("fp").to_pylist()), b.column("rid").to_numpy()
            front = [points[:, w].view(np.int64) for w in range(FRONT)]
            for k, tree in enumerate(grown):
                for shard, at, stored in tree.send(piece(points, k, bits)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard * trees + k), pa.array(rids[at]), pa.array(np.full(len(at), stored)), *(pa.array(f[at]) for f in front)],
                        ["shard", "rid", "stored", *(f"w{w}" for w in range(FRONT))],
                    )

    def meet(table: pa.Table) -> pa.Table:
        points = np.stack([table.column(f"w{w}").to_numpy().view(np.uint64) for w in range(FRONT)], 1)
        rids, stored = table.column("rid").to_numpy(), table.column("stored").to_numpy()
        groups, every = Groups(len(rids)), np.arange(len(rids))
        link_prints(points, every[stored], every[~stored], groups)
        root = groups.find(every)
        at = root != every
        return pa.table({"a": rids[at], "b": rids[root[at]]})

    shards = nodes.select("rid", "fp").mapInArrow(send, "shard long, rid long, stored boolean, " + ", ".join(f"w{w} long" for w in range(FRONT)))
    return shards.groupBy("shard").applyInArrow(meet, "a long, b long")


def _words(prints: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of words."""
    return np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1) if prints else np.empty((0, FRONT), np.uint64)


class Index:
    """Sets of hashes, with the sets that hold each hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.holder = np.repeat(np.arange(len(sets)), self.size)[np.argsort(flat, kind="stable")]
        self.many = np.bincount(flat)
        self.first = np.cumsum(self.many) - self.many

    def like(self, own: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a set to each of these."""
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        n = self.many[at]
        where = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(self.holder[where], minlength=len(self.size))
        return both / (self.size + len(own) - both)


def link_sets(sets: list[np.ndarray], similarity: float, groups: Groups) -> None:
    """Unite the sets that a chain of pairs of at least ``similarity`` (Jaccard) connects. 1 - similarity is a metric: sets
    close to a vantage point have no pair with those over twice the distance from it."""
    index = Index(sets)
    block = np.arange(len(sets))
    while len(block) > 1 and (groups.find(block) != groups.find(block[:1])).any():
        p, rest = block[:1], block[1:]
        s = index.like(sets[p[0]])[rest]
        near = s >= similarity
        groups.union(rest[near], np.repeat(p, int(near.sum())))
        between = rest[~near & (s >= 2 * similarity - 1 - SLACK)]
        for x in rest[near]:
            between = between[groups.find(between) != groups.find(p)]
            if not len(between):
                break
            close = between[index.like(sets[x])[between] >= similarity]
            groups.union(close, np.full(len(close), x))
        block = rest[~near]


def links_in(rids: list[int], texts: list[bytes], width: int, similarity: float) -> pa.RecordBatch:
    """a, b: a star for each group that links some of the texts."""
    groups, every = Groups(len(rids)), np.arange(len(rids))
    link_sets([shingles(t, width) for t in texts], similarity, groups)
    at, root = np.array(rids, np.int64), groups.find(every)
    part = root != every
    return pa.RecordBatch.from_arrays([pa.array(at[part]), pa.array(at[root[part]])], ["a", "b"])


def links_across(rids: list[int], texts: list[bytes], sides: list[int], width: int, similarity: float) -> pa.RecordBatch:
    """a, b: the text of side 0 that each text of side 1 is most similar to, if it links. Side 0 is a part of what one vantage point is near
    to, so one link to it is as good as all."""
    side, sets = np.array(sides), [shingles(t, width) for t in texts]
    own, asks = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    found: list[tuple[int, int]] = []
    if len(own) and len(asks):
        index = Index([sets[i] for i in own])
        for i in asks:
            s = index.like(sets[i])
            if s.max() >= similarity:
                found.append((rids[i], rids[own[int(s.argmax())]]))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """The columns of each run of rows that agree in ``keys``."""
    held, now = None, None
    for b in slices(batches, "t"):
        for key, *values in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in columns), strict=True):
            if key != now:
                if held:
                    yield held
                held, now = tuple([] for _ in columns), key
            for column, v in zip(held, values, strict=True):
                column.append(v)
    if held:
        yield held


class Similar:
    """Links between the texts of candidate groups, rows being rid, doc_id, t, written.

    Groups of up to ``limit`` bytes are compared in one task each. A larger one is split by vantage points, one a round: what is within the
    similarity of it is one component and leaves; what is between it and twice the distance is compared with that, slice by slice;
    what is left, the texts between included, goes on as the groups that its fingerprints still hold together. What ``rounds`` rounds leave larger than
    ``limit`` is compared block by block, so no pair is lost and no task holds more than two slices."""

    def __init__(self, rows: DataFrame, prints: DataFrame, scratch: Scratch, width: int, similarity: float, limit: int, rounds: int, forest: tuple[int, int], radius: int):
        self.rows, self.prints, self.scratch, self.width, self.similarity, self.limit, self.rounds = rows, prints, scratch, width, similarity, limit, rounds
        self.forest, self.radius = forest, radius
        self.texts = rows.select("rid", "t")

    def candidates(self, prints: DataFrame) -> DataFrame:
        """rid, root, written: rows that a chain of near fingerprints holds together, of prints (rid, fp)."""
        nodes = self.scratch.write(prints.groupBy("fp").agg(F.min("rid").alias("rid")))
        links = near_prints(nodes, nodes.count(), *self.forest, self.radius)
        same = prints.join(_star(prints, "fp"), "fp").select(F.col("rid").alias("a"), "b")
        found = components(links.unionByName(same), self.scratch)
        return self.scratch.write(found.select(F.col("node").alias("rid"), "root"))

    def sizes(self, groups: DataFrame) -> DataFrame:
        """root, n_slices, written, of the groups that are larger than the limit."""
        weights = self.prints.select("rid", "n").join(groups, "rid").groupBy("root").agg(F.sum("n").alias("n"))
        return self.scratch.write(weights.where(F.col("n") > self.limit).select("root", F.ceil(F.col("n") / self.limit).alias("n_slices")))

    def small(self, groups: DataFrame, large: DataFrame) -> DataFrame:
        """Links of the groups that are not large."""
        width, similarity = self.width, self.similarity

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rids, texts in by_group(batches, ["root"], ["rid", "t"]):
                if len(rids) > 1:
                    yield links_in(rids, texts, width, similarity)

        rows = self.texts.join(groups.join(large, "root", "left_anti"), "rid").select("root", "rid", "t")
        return rows.repartition("root").sortWithinPartitions("root").mapInArrow(meet, "a long, b long")

    def distances(self, groups: DataFrame) -> DataFrame:
        """root, rid, pivot, s, written: similarity of every row of a group to the group's vantage point, the first of the most rows that agree in
        16 bits at one place of the fingerprint."""
        width = self.width
        places = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("fp", 2 * k + 1, 2).alias("v")) for k in range(4 * FRONT)))
        banded = self.prints.select("rid", F.explode(places).alias("key")).join(groups, "rid")
        bands = banded.groupBy("root", "key").agg(F.count("*").alias("n"), F.min("rid").alias("rid"))
        pivots = bands.groupBy("root").agg(F.max_by("rid", F.struct("n", F.col("rid"))).alias("pivot"))
        points = self.scratch.write(pivots.join(self.texts.toDF("pivot", "p"), "pivot"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: tuple[int | None, Index | None] = None, None
            for b in slices(batches, "t"):
                out = []
                for pivot, p, t in zip(b.column("pivot").to_pylist(), b.column("p"), b.column("t").to_pylist(), strict=True):
                    if known[0] != pivot:
                        known = pivot, Index([shingles(p.as_py(), width)])
                    out.append(float(known[1].like(shingles(t, width))[0]))
                yield pa.RecordBatch.from_arrays([b.column("root"), b.column("rid"), b.column("pivot"), pa.array(out)], ["root", "rid", "pivot", "s"])

        rows = self.texts.join(groups, "rid").join(points, "root").select("root", "rid", "pivot", "p", "t")
        return self.scratch.write(rows.mapInArrow(compare, "root long, rid long, pivot long, s double"))

    def across(self, near: DataFrame, asks: DataFrame, slices_of: DataFrame) -> DataFrame:
        """Links between rows (root, rid) of two sides: each slice of one meets each slice of the other."""
        width, similarity, one = self.width, self.similarity, F.xxhash64("rid")
        every = F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1)
        cut = lambda rows: rows.join(slices_of, "root").withColumn("own", F.pmod(one, F.col("n_slices")))
        # asking rows come in slices of their own number, which mostly is one
        weights = asks.join(self.prints.select("rid", "n"), "rid").groupBy("root").agg(F.ceil(F.sum("n") / self.limit).alias("n_asks"))
        left = cut(near).join(weights, "root").select("root", "rid", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asks") - 1)).alias("other"), F.lit(0).alias("side"))
        right = cut(asks).join(weights, "root").select("root", "rid", F.explode(every).alias("own"), F.pmod(one, F.col("n_asks")).alias("other"), F.lit(1).alias("side"))
        rows = left.unionByName(right).join(self.texts, "rid")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rids, texts, sides in by_group(batches, ["root", "own", "other"], ["rid", "t", "side"]):
                yield links_across(rids, texts, sides, width, similarity)

        return rows.repartition("root", "own", "other").sortWithinPartitions("root", "own", "other").mapInArrow(meet, "a long, b long")

    def blocks(self, groups: DataFrame, slices_of: DataFrame) -> DataFrame:
        """All links of groups (root, rid): every two slices meet, a slice also by itself."""
        width, similarity = self.width, self.similarity
        own = groups.join(slices_of, "root").withColumn("k", F.pmod(F.xxhash64("rid"), F.col("n_slices")))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1), lambda j: F.struct(F.least(j, "k").alias("own"), F.greatest(j, "k").alias("other")))
        rows = own.select("root", "rid", F.explode(meets).alias("m")).select("root", "rid", "m.own", "m.other").join(self.texts, "rid")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rids, texts in by_group(batches, ["root", "own", "other"], ["rid", "t"]):
                if len(rids) > 1:
                    yield links_in(rids, texts, width, similarity)

        return rows.repartition("root", "own", "other").sortWithinPartitions("root", "own", "other").mapInArrow(meet, "a long, b long")

    def links(self) -> DataFrame:
        groups = self.candidates(self.prints)
        large = self.sizes(groups)
        found = [self.small(groups, large)]
        for _ in range(self.rounds):
            if large.isEmpty():
                return _union(found)
            hot = groups.join(large, "root", "left_semi")
            far = self.distances(hot)
            is_near, between = F.col("s") >= self.similarity, (F.col("s") < self.similarity) & (F.col("s") >= 2 * self.similarity - 1 - SLACK)
            found.append(far.where(is_near & (F.col("rid") != F.col("pivot"))).select(F.col("rid").alias("a"), F.col("pivot").alias("b")))
            found.append(self.across(far.where(is_near).select("root", "rid"), far.where(between).select("root", "rid"), large))
            left = far.where(~is_near & (F.col("rid") != F.col("pivot"))).select("rid")
            groups = self.candidates(self.prints.join(left, "rid", "left_semi"))
            large = self.sizes(groups)
            found.append(self.small(groups, large))
        found.append(self.blocks(groups.join(large, "root", "left_semi"), large))
        return _union(found)


def _star(rows: DataFrame, key: str) -> DataFrame:
    """key, b: the first row of each key that several rows share."""
    return rows.groupBy(key).agg(F.min("rid").alias("b"), F.count("*").alias("n")).where("n > 1").select(key, "b")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _similar(rows: DataFrame, scratch: Scratch, width: int, similarity: float, limit: int, rounds: int, radius: int) -> DataFrame:
    """rows: rid, doc_id, t, written -> rid, doc_id, component_id of those that have links."""
    bits, trees, words = forest(rows.count())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            texts = b.column("t").to_pylist()
            prints = pa.array([wide_simhash(shingles(t, width), words).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([len(t) for t in texts], pa.int64()), prints], ["rid", "n", "fp"])

    prints = scratch.write(rows.select("rid", "t").mapInArrow(sketch, "rid long, n long, fp binary"))
    named = rows.where("doc_id is not null").select("rid", "doc_id")
    same = named.join(_star(named, "doc_id"), "doc_id").select(F.col("rid").alias("a"), "b")
    roots = components(Similar(rows, prints, scratch, width, similarity, limit, rounds, (bits, trees), radius).links().unionByName(same), scratch)
    found = scratch.write(rows.select("rid", "doc_id").join(roots, F.col("rid") == F.col("node")).select("rid", "doc_id", "root"))
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("rid", "doc_id", "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, limit: int = LIMIT, rounds: int = 16, radius: int = 0) -> DataFrame:
    """rid, doc_id, component_id of the rows that a chain of pairs of at least ``similarity`` links to others; rows of one id
    are linked. component_id is the smallest id of the chain.

    Candidates come from vantage-point trees over the texts' SimHash fingerprints. As ``near_groups`` has a tree for each half of the bits, here each
    of disjoint pieces has one (``forest``: 25 pieces of 7 bits for 200,000 texts, 74 of 13 for 10^7), and two fingerprints that agree in a piece
    share the shard of its tree, in which they are compared by whole words (``NEAR``). A pair at 0.8 is found with probability 0.9998, by
    formula (texts of 4 and 5 shingles: 0.99), more above. ``radius`` is the trees' search radius; with more than 0 the shards
    overlap, by the triangle bound, at the cost of more copies than further trees have. The texts that a chain of candidates holds together
    are then compared by all their shingles (see ``Similar``)."""
    scratch = Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).cast("long").alias("doc_id"), utf8(quoted(text_col)).alias("t"))
    return _similar(scratch.write(rows), scratch, width, similarity, limit, rounds, radius)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, limit: int = LIMIT, rounds: int = 16, radius: int = 0) -> DataFrame:
    """The document with the smallest id of each group of ``similar_groups``, with all its columns. Rows of one id count as one
    document; a row with a null id cannot be told from others of its kind and stays."""
    scratch = Scratch(docs.sparkSession, "similar")
    rows = scratch.write(numbered(docs))
    plain = rows.select("rid", F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), utf8(f"row.{quoted(text_col)}").alias("t"))
    gone = scratch.write(_similar(plain, scratch, width, similarity, limit, rounds, radius).where("doc_id <> component_id").select("rid"))
    return rows.join(gone, "rid", "left_anti").select("row.*")
