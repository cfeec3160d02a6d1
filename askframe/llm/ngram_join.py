"""Documents whose word n-gram sets have a high Jaccard similarity, joined exactly by T-occurrence search.

1. Each row's set of n-grams is hashed. Rows of a chunk (what a map task holds at once) with equal sets are one class, which
   its first row represents.
2. Classes that could be similar are brought together without a loss: two sets of sizes a <= b with similarity s differ in
   at most a * (1 - s) / s n-grams, so, dealt by hash into one part more than that, some part is equal in both. Sizes fall
   into bands such that linked sets lie in one band or in neighbours; a class signs every part at its own band's and the
   lower band's number of parts. A map task joins equal signatures itself and sends one of each on, packed: a row a bucket,
   with 5 bytes a signature and 2 for the place in the chunk of the first class that it is joined with. Common words and
   shared passages bring nothing together here: a whole random part of the set must agree.
   Similar sets share many signatures, and a task that meets some of them knows nothing of the others. So a sample, some
   HOME signatures of each class chosen by their hashes, meets first; in the pass over all signatures classes stand under
   the least class that the sample has connected them with, and tasks send only what that leaves apart. The links sent are
   thus some HOME a class, however many tasks there are, and not one a class and task.
   So that passages that many texts share don't either, frequent n-grams are counted first, and classes sign with those that
   are rare, and with ever more frequent ones only where the rare ones don't fill more parts than may differ. As both sets
   of a linked pair then sign at the first step at which one of them has parts enough, no link is lost, whatever is counted
   as frequent.
3. Classes connected by signatures form a block. Its classes sign anew with their n-grams dealt into other parts, for their
   block alone, and what that doesn't connect falls apart; no link is lost, as a linked pair agrees in any dealing. Blocks
   are cut into cells of bounded size. Until a cell is searched its sets travel as texts, which take a third of the
   n-grams' room and aren't kept. In a cell DivideSkip finds each set's partners: of its inverted lists the short ones are
   merged, candidates that occur often enough are probed in the long ones by binary search (or these are merged too, where
   that is less work), and who reaches the overlap is linked.
4. For the number of links every two cells of a block meet. For components alone a block's first class is in each of its
   cells, and only classes outside the block's largest component then meet its other cells.
5. Links give components; every row gets its class's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, kept, lookup, mix64, most_frequent, numbered, raw, shuffle_width, slices, tidy, words

#: N-grams that a cell of a block holds, about; a class with more makes a cell of its own.
CELL = 1 << 19
#: Signatures, and rows, of a chunk; bytes of text for which there is a bucket of signatures.
CHUNK, CHUNK_ROWS, BUCKET = 1 << 20, 1 << 16, 64 << 20
#: Classes to look at that are broadcast; more are joined by a shuffle, for which a Bloom filter spares other texts.
FEW = 1 << 18
#: Signatures of a class that meet first, about, and how many classes connected by them are broadcast. Neither alters results.
HOME, LABELS = 12, 1 << 21
#: Edges whose components one task finds; more take rounds of joins.
ONE_TASK = 1 << 17
#: Occurrences from which an n-gram counts as frequent, steps of eight times as many each, and how many of the most frequent
#: n-grams are broadcast. Sets, and n-grams, within which occurrences are counted. How often blocks sign anew. None alters results.
TIER, TIERS, FREQUENT = 8, 6, 1 << 20
COUNTED, COUNTED_GRAMS, AGAIN = 8192, 1 << 21, 2
SIGNED = "kind int, a long, b long, c long, d long, e long, w long, x binary, y binary"


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words, hashed, sorted within each row, and each row's offsets. Fewer words: all as one."""
    row, h = words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    first = np.cumsum(count) - count
    total = h.copy()
    for k in range(1, n):
        total[: len(h) - k] = mix64(total[: len(h) - k] * np.uint64(3) + np.uint64(k)) + h[k:] if len(h) > k else total[:0]
    whole = np.arange(len(h)) + n <= (first + count)[row] if len(h) else np.zeros(0, bool)
    grams, of = [total[whole]], [row[whole]]
    for m in range(1, n):  # rows of m words
        few = first[count == m]
        if len(few):
            t = h[few].copy()
            for k in range(1, m):
                t = mix64(t * np.uint64(3) + np.uint64(k)) + h[few + k]
            grams.append(mix64(t + np.uint64(m)))
            of.append(row[few])
    gram, of_ = np.concatenate(grams), np.concatenate(of)
    order = np.lexsort((gram, of_))
    gram, of_ = gram[order], of_[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of_[1:] != of_[:-1])
    return gram[new], np.concatenate([[0], np.cumsum(np.bincount(of_[new], minlength=rows))])


def bands(size: int, num: int, den: int) -> list[int]:
    """Lower ends of the size bands up to size: a band's sets are linked with its own and the next band's at most."""
    ends = [1]
    while ends[-1] <= size:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num + 1))
    return ends


def _signatures(gram: np.ndarray, offsets: np.ndarray, num: int, den: int, tier: np.ndarray | None = None, deal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the parts of each row's set, and their rows. deal: which of the ways to deal n-grams into parts.

    A band has a few parts more than may differ. Of the parts that agree in a linked pair some may be empty in both; a set that
    fills more parts than may differ has one among them that isn't. If neither does, both sign their prefix, the smallest
    hashes of which linked sets must share one. With tier, a small number of each n-gram, the parts are first those of the
    n-grams of tier 0, and a set that these don't fill enough goes on with the next tier added, up to the whole set.
    """
    size = np.diff(offsets)
    if not size.max(initial=0):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.array(bands(int(size.max()), num, den))
    differ = (ends[1:] - 1) * (den - num) // num
    agree = 1 + (differ + 15) // 16 + (differ > 0)
    band = np.searchsorted(ends, size, "right") - 1
    row = np.repeat(np.arange(len(size)), size)
    spread = mix64(gram + np.uint64(0x5851F42D4C957F2D))
    dealt = mix64(gram + np.uint64(deal)) if deal else gram
    out, of = [], []
    for lower in (0, 1):
        own = band - lower
        active = (own >= 0) & (size > 0)
        m = np.where(active, (differ + agree)[np.maximum(own, 0)], 0)
        base = np.cumsum(m) - m
        part_row = np.repeat(np.arange(len(m)), m)
        for step in range(1 if tier is None else TIERS):
            mine = np.flatnonzero(active[row] if tier is None else active[row] & (tier <= step))
            at = base[row[mine]] + (dealt[mine] % m[row[mine]].astype(np.uint64)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, value = at[order], spread[mine][order]
            filled = np.zeros(len(m), np.int64)
            if len(at):
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                r = part_row[at[starts]]
                label = (own[r].astype(np.uint64) << np.uint64(32)) + (at[starts] - base[r]).astype(np.uint64) + np.uint64(step << 56)
                out.append(mix64(np.add.reduceat(value, starts)) + mix64(label))
                of.append(r)
                filled = np.bincount(r, minlength=len(m))
            active &= filled <= differ[np.maximum(own, 0)]
            if not active.any():
                break
        for k in np.flatnonzero(active):
            n = int(size[k])
            out.append(mix64(gram[offsets[k] : offsets[k] + n - -(-num * n // den) + 1] + np.uint64(1 + own[k])))
            of.append(np.full(len(out[-1]), k))
    return np.concatenate(out), np.concatenate(of)


def _batch(kind: int, *cols, x: pa.Array | None = None, y: pa.Array | None = None) -> pa.RecordBatch:
    n = len(cols[0])
    longs = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in cols] + [pa.nulls(n, pa.int64())] * (6 - len(cols))
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *longs, none if x is None else x, none if y is None else y], [f.split()[0] for f in SIGNED.split(", ")])


def _packed(sig: np.ndarray, of: np.ndarray, buckets: int, base: int | None):
    """Signatures of a chunk as rows of kinds 1 (all) and 3 (those that meet first). Classes with equal signatures are joined,
    which rows of kind 2 tell, and stand under the least of them. of: classes; with base, they are below base plus CHUNK_ROWS
    and their distance to it is kept; else they are kept whole, and base is null."""
    own, _ = pd.factorize(of)
    part = np.minimum(HOME / np.bincount(own), 1.0)[own]
    home = (mix64(sig) >> np.uint64(11)).astype(np.float64) < part * 2.0**53
    bucket = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    key = bucket << np.uint64(40) | sig & np.uint64((1 << 40) - 1)
    order = np.lexsort((of, key))
    key, of, home = key[order], of[order], home[order]
    new = np.append(True, key[1:] != key[:-1])
    leader = of[new][np.cumsum(new) - 1]
    pairs = forest(np.stack([of, leader], 1)[of != leader])
    if len(pairs):
        yield _batch(2, pairs[:, 0], pairs[:, 1])
    home = np.logical_or.reduceat(home, np.flatnonzero(new))
    key, of = key[new], _labelled(of[new], pairs[:, 0], pairs[:, 1])
    for kind, k in ((1, slice(None)), (3, home)):
        if len(key[k]):
            yield _bucketed(kind, key[k], of[k], base)


def _bucketed(kind: int, key: np.ndarray, of: np.ndarray, base: int | None) -> pa.RecordBatch:
    low, high, of = key.astype("<u4"), (key >> np.uint64(32)).astype(np.uint8), of.astype("<i8") if base is None else (of - base).astype("<u2")
    edge = np.append(np.flatnonzero(np.append(True, key[1:] >> np.uint64(40) != key[:-1] >> np.uint64(40))), len(key))
    own = key[edge[:-1]] >> np.uint64(40)
    x = pa.array([low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
    y = pa.array([of[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
    return _batch(kind, own.astype(np.int64), pa.nulls(len(own), pa.int64()) if base is None else np.full(len(own), base), x=x, y=y)


def _labelled(of: np.ndarray, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """of, with those that are among nodes (ascending) replaced by their labels."""
    if not len(nodes):
        return of
    k = np.minimum(np.searchsorted(nodes, of), len(nodes) - 1)
    return np.where(nodes[k] == of, labels[k], of)


class _Chunk:
    """Rows of a map task whose classes and signatures are joined before they leave it."""

    def __init__(self, buckets: int):
        self.buckets, self.base, self.held = buckets, None, 0
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.signatures: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.seen = np.zeros(0, np.int64)

    def add(self, rid: np.ndarray, ids: pa.Array, gram: np.ndarray, at: np.ndarray, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> None:
        size = np.diff(at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(gram), dtype=np.uint64)])
        digest = mix64((sums[at[1:]] - sums[at[:-1]]) ^ (size.astype(np.uint64) << np.uint64(40))).view(np.int64)
        self.base = int(rid[0]) if self.base is None else self.base
        self.rows.append((rid, size, digest, ids))
        _, one = np.unique(digest, return_index=True)
        new = np.sort(one[(size[one] > 0) & ~np.isin(digest[one], self.seen)])
        self.seen = np.concatenate([self.seen, digest[new]])
        if len(new):
            pick = np.concatenate([np.arange(at[k], at[k + 1]) for k in new])
            sig, of = _signatures(gram[pick], np.concatenate([[0], np.cumsum(size[new])]), num, den, _tier(gram[pick], frequent))
            self.signatures.append(sig)
            self.of.append(rid[new][of])
            self.held += len(sig)

    def out(self):
        rid, size, digest = (np.concatenate([x[k] for x in self.rows]) for k in range(3))
        form, _ = pd.factorize(digest)
        first = np.zeros(form.max(initial=-1) + 1, np.int64)
        first[form[::-1]] = np.arange(len(form))[::-1]
        rep = np.where(size > 0, rid[first[form]], rid)
        weight = np.where(size > 0, np.bincount(form, minlength=len(first))[form], 1)
        yield _batch(0, rid, rep, size, digest, pa.concat_arrays([x[3] for x in self.rows]), weight)
        if self.held:
            yield from _packed(np.concatenate(self.signatures), np.concatenate(self.of), self.buckets, self.base)


def _frequent(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of rows (text) that are frequent, as far as they repeat within some thousand sets, sorted, and each one's tier."""

    def run(batches):
        grams, sets, size = [], 0, 0

        def counted():
            gram, n = np.unique(np.concatenate(grams), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

        for batch in batches:
            data, offsets = raw(batch.column(0))
            for a, b in slices(offsets):
                grams.append(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)[0])
                sets, size = sets + b - a, size + len(grams[-1])
                if sets >= COUNTED or size >= COUNTED_GRAMS:
                    yield counted()
                    grams, sets, size = [], 0, 0
        if grams:
            yield counted()

    counts = rows.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= TIER)
    counts = kept(counts)
    found = most_frequent(counts, "n", F.col("gram"), FREQUENT).toPandas()
    discard(counts)
    known = found["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.minimum(np.log2(found["n"].to_numpy()[order] / TIER + 1e-9) // 3 + 1, TIERS - 1).astype(np.int8)


def _tier(gram: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, tiers = frequent
    if not len(known):
        return np.zeros(len(gram), np.int8)
    k = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return np.where(known[k] == gram, tiers[k], 0)


def _sign(rows: DataFrame, n: int, num: int, den: int, buckets: int, frequent: Broadcast) -> DataFrame:
    """rows: rid, id, text. Rows of four kinds: 0 a row (a: rid, b: its class, c: set size, d: the set's digest, e: id, w:
    rows of the class in the chunk), 1 and 3 signatures (a: bucket, b: first rid of the chunk, x, y), 2 a link to look into (a, b)."""

    def run(batches):
        chunk = _Chunk(buckets)
        for batch in batches:
            rids = batch.column(0).to_numpy()
            data, offsets = raw(batch.column(2))
            for a, b in slices(offsets):
                while a < b:
                    if chunk.base is not None and (chunk.held > CHUNK or not chunk.base <= rids[a] < chunk.base + CHUNK_ROWS):
                        yield from chunk.out()
                        chunk = _Chunk(buckets)
                    base = rids[a] if chunk.base is None else chunk.base
                    far = (rids[a:b] < base) | (rids[a:b] >= base + CHUNK_ROWS)  # rids ascend within a file, files may not
                    to = a + int(far.argmax()) if far.any() else b
                    gram, at = shingles(data[offsets[a] : offsets[to]], offsets[a : to + 1] - offsets[a], n)
                    chunk.add(rids[a:to], batch.column(1).slice(a, to - a), gram, at, num, den, frequent.value)
                    a = to
        if chunk.base is not None:
            yield from chunk.out()

    return rows.select("rid", "id", "text").mapInArrow(run, SIGNED)


def _sign_again(sets: DataFrame, n: int, num: int, den: int, buckets: int, frequent: Broadcast, deal: int) -> DataFrame:
    """Rows of kinds 1 to 3 of sets (rid, text, block), whose signatures agree within a block alone."""

    def run(batches):
        signatures, classes, held = [], [], 0
        for batch in batches:
            rids, blocks = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            data, offsets = raw(batch.column(1))
            for a, b in slices(offsets):
                gram, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sig, of = _signatures(gram, at, num, den, _tier(gram, frequent.value), deal)
                signatures.append(sig ^ mix64(blocks[a:b][of] + np.uint64(7)))
                classes.append(rids[a:b][of])
                held += len(sig)
                if held > CHUNK:
                    yield from _packed(np.concatenate(signatures), np.concatenate(classes), buckets, None)
                    signatures, classes, held = [], [], 0
        if held:
            yield from _packed(np.concatenate(signatures), np.concatenate(classes), buckets, None)

    return sets.select("rid", "text", "block").mapInArrow(run, SIGNED)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs, fewer than there are nodes, that connect what pairs (rows of two nodes) connect: each node with its least."""
    if not len(pairs):
        return pairs
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        own = label[at]
        if (own[:, 0] == own[:, 1]).all():
            break
        least = own.min(1)
        np.minimum.at(label, own[:, 0], least)
        np.minimum.at(label, own[:, 1], least)
        while (label != (up := label[label])).any():
            label = up
    mine = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[mine], nodes[label[mine]]], 1)


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _meet(signed: DataFrame, kind: int, labels: Broadcast | None = None) -> DataFrame:
    """a, b: pairs of classes that connect all that share a signature of that kind, and labels beyond what they connect."""

    def run(batches):
        bucket, held, met, size = None, [], [], 0

        def finish():
            value = np.concatenate([np.frombuffer(x, "<u4", len(x) // 5).astype(np.uint64) | np.frombuffer(x, np.uint8, -1, len(x) // 5 * 4).astype(np.uint64) << np.uint64(32) for _, x, _ in held])
            rid = np.concatenate([np.frombuffer(y, "<i8") if base is None else base + np.frombuffer(y, "<u2").astype(np.int64) for base, _, y in held])
            order = np.argsort(value, kind="stable")
            value = value[order]
            again = np.append(False, value[1:] == value[:-1])
            again[:-1] |= again[1:]
            value, rid = value[again], rid[order][again]
            if labels is not None:
                rid = _labelled(rid, *labels.value)
            if not len(value):
                return np.zeros((0, 2), np.int64)
            start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            leader = np.repeat(np.minimum.reduceat(rid, start), np.diff(np.append(start, len(rid))))
            return forest(np.stack([rid, leader], 1)[rid != leader])

        for batch in batches:
            for own, base, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    if held:
                        met.append(finish())
                        size += len(met[-1])
                    if size > CHUNK:  # what connects the same classes is sent once
                        met = [forest(np.concatenate(met))]
                        size = len(met[0])
                    if size > CHUNK:
                        yield _links(met.pop())
                        size = 0
                    bucket, held = own, []
                held.append((base, x, y))
        if held:
            yield _links(forest(np.concatenate([*met, finish()])))

    packed = signed.where(F.col("kind") == kind).select(F.col("a").alias("bucket"), "b", "x", "y")
    dealt = packed.repartition(shuffle_width(signed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long")


def _blocks(signed: DataFrame) -> DataFrame:
    """rid, block (the least rid of it) of all classes that signatures connect with others."""
    near = cut(components(_meet(signed, 3).union(signed.where("kind = 2").select("a", "b"))))
    known = near.where("node != root").limit(LABELS).toPandas().sort_values("node")
    labels = signed.sparkSession.sparkContext.broadcast((known["node"].to_numpy(np.int64), known["root"].to_numpy(np.int64)))
    found = cut(components(_meet(signed, 1, labels).union(near)))
    labels.unpersist()
    return found.select(F.col("node").alias("rid"), F.col("root").alias("block"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node in edges (a, b), by alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    if e.count() <= ONE_TASK:

        def run(batches):
            pairs = forest(np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches)]))
            roots = np.unique(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], roots])), pa.array(np.concatenate([pairs[:, 1], roots]))], ["node", "root"])

        return e.coalesce(1).mapInArrow(run, "node long, root long")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(turned.union(low.select("a", "m")).distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those from start[1], and so on."""
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(total[-1] if len(total) else 0)


def divide_skip(sets: list[np.ndarray], num: int, den: int, same: np.ndarray, weight: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (positions) that connect all linked sets (sorted distinct hashes) beyond what the labels in same connect already,
    and, if weight is given, the weight of all sets that each is linked with.

    A set looks for partners of its size or larger, with part only for those of another part. Without weights, partners that
    are already connected with it are left out, so that of a dense group only a tree of links is counted through.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    n = len(order)
    element, _ = pd.factorize(np.concatenate([sets[k] for k in order]))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    key = np.sort(element.astype(np.int64) * n + np.repeat(np.arange(n), sizes))  # inverted lists, one after the other
    lists, member = key // n, key % n
    start = np.searchsorted(lists, np.arange(element.max(initial=-1) + 2))
    parent = pd.factorize(same[order])[0]
    linked = np.zeros(n, np.int64)
    own_weight = None if weight is None else weight[order]
    own_part = None if part is None else part[order]
    links = []
    for r in range(n):
        size = int(sizes[r])
        to = int(np.searchsorted(sizes, size * den // num, "right"))
        if to <= r + 1 or (weight is None and (parent[r + 1 : to] == parent[r]).all()):
            continue
        own = element[begin[r] : begin[r + 1]]
        length = start[own + 1] - start[own]
        own, length = own[length > 1], length[length > 1]
        need = -(-2 * num * size // (num + den))
        if len(own) < need:
            continue
        n_long = min(int(need / (0.0085 * np.log2(max(int(length.max()), 2)) + 1)), need - 1)
        by_length = np.argsort(length, kind="stable")
        own, length = own[by_length], length[by_length]
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        times, candidates = _merged(member, start, short, length[: len(short)], n)
        candidates = candidates[(times[candidates] >= need - n_long) & (candidates > r) & (candidates < to)]
        if own_part is not None:
            candidates = candidates[own_part[candidates] != own_part[r]]
        if weight is None:
            candidates = candidates[parent[candidates] != parent[r]]
        if not len(candidates):
            continue
        found = times[candidates]
        if len(long) * len(candidates) * 32 < int(length[len(short) :].sum()):
            probe = long[:, None] * n + candidates[None, :]
            at = np.minimum(np.searchsorted(key, probe), len(key) - 1)
            found = found + (key[at] == probe).sum(0)
        elif len(long):
            found = found + _merged(member, start, long, length[len(short) :], n)[0][candidates]
        partners = candidates[found * (num + den) >= num * (size + sizes[candidates])]
        if weight is not None:
            linked[r] += own_weight[partners].sum()
            linked[partners] += own_weight[r]
        for k in partners[parent[partners] != parent[r]].tolist():
            if parent[k] != parent[r]:
                links.append((int(order[r]), int(order[k])))
                parent[parent == parent[k]] = parent[r]
    out = np.zeros(n, np.int64)
    out[order] = linked
    return links, out


def _merged(member: np.ndarray, start: np.ndarray, lists: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each set occurs in the sorted lists (as an array of n), and the sets that do."""
    all_ = member[_ranges(start[lists], length)]
    if len(all_) * 4 > n:
        times = np.bincount(all_, minlength=n)
        return times, np.flatnonzero(times)
    all_ = np.sort(all_, kind="stable")  # merges the sorted runs
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.zeros(0, np.int64)
    times = np.zeros(n, np.int64)
    times[all_[first]] = np.diff(np.append(first, len(all_)))
    return times, all_[first]


def _search(cells: DataFrame, n: int, num: int, den: int, count: bool) -> DataFrame:
    """Links a, b of classes within every cell (root, lo, hi); with count also rows without b: w rows are linked with a's.

    cells has root, lo, hi, part, rid, same (label of what is connected), weight and text. Where lo and hi differ, only
    classes of different parts meet.
    """

    def run(batches):
        held, cell = {}, None

        def finish():
            sets = [np.frombuffer(x, np.uint64) for x in held]
            own = list(held.values())
            a, b, w = [], [], []
            cross = cell[1] != cell[2]
            total = np.array([sum(x[2] for x in members) for members in own], np.int64)
            for members in own:
                for x in members[1:]:
                    a.append(members[0][0])
                    b.append(x[0])
            linked = np.zeros(len(own), np.int64)
            if len(own) > 1:
                links, linked = divide_skip(sets, num, den, np.array([x[0][1] for x in own], np.int64), total if count else None, np.array([x[0][3] for x in own]) if cross else None)
                a += [own[k][0][0] for k, _ in links]
                b += [own[k][0][0] for _, k in links]
            w += [None] * len(a)
            if count:
                for members, others, more in zip(own, linked.tolist(), total.tolist(), strict=True):
                    a += [x[0] for x in members]
                    b += [None] * len(members)
                    w += [others if cross else others + more - 1] * len(members)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, w)], ["a", "b", "w"])

        for batch in batches:
            data, offsets = raw(batch.column(7))
            for start, end in slices(offsets):
                gram, at = shingles(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], n)
                for x, y, root, lo, hi, part, rid, same, weight in zip(at, at[1:], *(c.slice(start, end - start).to_pylist() for c in batch.columns[:7]), strict=False):
                    if (root, lo, hi) != cell:
                        if held:
                            yield finish()
                        held, cell = {}, (root, lo, hi)
                    held.setdefault(gram[x:y].tobytes(), []).append((rid, same, weight, part))
        if held:
            yield finish()

    dealt = cells.repartition(shuffle_width(cells.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "rid")
    return dealt.select("root", "lo", "hi", "part", "rid", "same", "weight", "text").mapInArrow(run, "a long, b long, w long")


def _with_texts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (by rid) with each row's text, read anew."""
    wanted = placed.count()
    if wanted <= FEW:
        return rows.select("rid", "text").join(F.broadcast(placed), "rid")
    return _passing(rows, placed, wanted).join(placed, "rid")


def _passing(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows that a Bloom filter of wanted's rid lets pass: all wanted and few others. It has 16 bits a rid up to 2**27 bits;
    beyond, it lets more pass, which costs shuffle alone."""
    bits = 1 << min(27, max(16, (16 * n - 1).bit_length()))
    spots = [F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(bits)) for k in range(3)]
    ones = wanted.select(F.explode(F.array(*spots)).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p & 31)))").alias("v")).toPandas()
    filled = np.zeros(bits // 32, np.uint32)
    filled[ones["w"].to_numpy()] = ones["v"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        bloom = shared.value
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in (2, 3, 4)])
            hit = ((bloom[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(0)
            yield batch.filter(pa.array(hit)).select([0, 1])

    return rows.select("rid", "text", *(c.alias(f"p{k}") for k, c in enumerate(spots))).mapInArrow(run, "rid long, text string")


def _found(rows: DataFrame, n: int, num: int, den: int, count: bool) -> DataFrame:
    """rid, id, size, root (a rid that the rows of a component share) and n_links (null unless counted) of each row of rows
    (rid, id, text), as a kept table."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_width(rows.sparkSession), size // BUCKET)
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, n))
    signed = kept(_sign(rows, n, num, den, buckets, frequent))
    classes = signed.where("kind = 0").select(F.col("a").alias("rid"), F.col("e").alias("id"), F.col("b").alias("rep"), F.col("c").alias("size"), F.col("d").alias("digest"), F.col("w").alias("weight"))
    classes = kept(classes)
    blocks = _blocks(signed)
    discard(signed)
    for deal in range(1, AGAIN + 1):
        signed = kept(_sign_again(_with_texts(rows, blocks), n, num, den, buckets, frequent, deal))
        blocks = _blocks(signed)
        discard(signed)
    reps = classes.where("rid = rep").select("rid", "size", "digest", "weight")
    sized = cut(blocks.join(reps, "rid"))
    cells = sized.groupBy("block").agg(F.ceil(F.sum("size") / CELL).alias("cells"))
    placed = cut(lookup(sized, cells, ["block"]).select("rid", "block", "cells", F.pmod("digest", "cells").alias("part"), "weight"))
    many = bool(placed.where("cells > 1").take(1))
    sets = _with_texts(rows, placed)
    place, other = F.col("part"), F.col("other")
    if count:
        spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        met = spread.select(F.col("block").alias("root"), F.least(place, other).alias("lo"), F.greatest(place, other).alias("hi"), "part", "rid", F.col("rid").alias("same"), "weight", "text")
        links = kept(_search(met, n, num, den, True))
    else:
        everywhere = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
        spread = sets.withColumn("lo", F.explode(F.when(F.col("rid") == F.col("block"), everywhere).otherwise(F.array("part"))))
        links = kept(_search(spread.select(F.col("block").alias("root"), "lo", F.col("lo").alias("hi"), "part", "rid", F.col("rid").alias("same"), "weight", "text"), n, num, den, False))
        if many:
            links = kept(links.union(_across(placed.where("cells > 1"), rows, links, n, num, den)))
    linked = components(links.where("b is not null").select("a", "b"))
    own = classes.join(linked.withColumnsRenamed({"node": "rep"}), "rep", "left")
    n_links = F.lit(None).cast("long")
    if count:
        sums = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("more"))
        own, n_links = own.join(sums, "rep", "left"), F.when(F.col("size") == 0, 0).otherwise(F.coalesce("more", F.col("weight") - 1)).cast("long")
    out = kept(own.select("rid", "id", "size", F.coalesce("root", "rep").alias("root"), n_links.alias("n_links")))
    discard(classes, links)
    return out


def _across(placed: DataFrame, rows: DataFrame, links: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between cells of a block: what its largest component lacks meets every cell, so no pair but those inside that
    component stays unseen."""
    known = cut(placed.join(components(links.select("a", "b")).withColumnsRenamed({"node": "rid", "root": "same"}), "rid", "left").withColumn("same", F.coalesce("same", "rid")))
    counts = known.groupBy("block", "same").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("block").agg(F.max(F.struct("n", "same"))["same"].alias("main"))
    outside = known.join(main, "block").where("same != main")
    chunks = outside.select("block", F.col("part").alias("hi")).distinct()
    base = known.join(chunks, "block").select("block", F.col("part").alias("lo"), "hi", F.lit(0).alias("part"), "rid", "same", "weight")
    more = outside.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("lo"), F.col("part").alias("hi"), F.lit(1).alias("part"), "rid", "same", "weight")
    # in its own part an outsider has met all; in another it meets all of that part
    apart = cut(base.union(more).where("lo != hi"))
    return _search(_with_texts(rows, apart).withColumnRenamed("block", "root"), n, num, den, False)


def _first(found: DataFrame) -> DataFrame:
    """root and first (none, id, rid): of each component's rows the one with the smallest id, without one only if none has."""
    return found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))


@tidy
def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """doc_id, n_shingles (the set's size) and component_id, the smallest id reachable by links of similarity num / den, of
    every row; with links also n_links, how many other rows it is linked with, for which all pairs of a block are counted.

    Words are runs of other characters than U+0020 and U+0009 to U+000D, lower-cased A-Z; n-grams are hashed to 64 bits. A
    text of fewer than n words has its whole sequence as one n-gram. A null, empty or blank text has no n-gram, is linked
    with nothing and is its own component. Rows, not ids, are joined: rows that repeat an id with different texts each have
    their own links, and rows without an id take part, link others, and come back with a null doc_id; a component in which
    no row has an id has a null component_id. An empty table gives no rows; other columns are not read.
    """
    rows, row = numbered(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")))
    found = _found(rows.withColumnRenamed(row, "rid"), n, num, den, links)
    discard(rows)
    out = lookup(found, _first(found), ["root"])
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("first.id")).alias("component_id"), *(["n_links"] if links else []))


@tidy
def repeats(rows: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """rid of all rows of rows (rid, id, text) but one of each component: that with the smallest id, then rid."""
    found = _found(rows, n, num, den, False)
    return lookup(found, _first(found), ["root"]).where("rid != first.rid").select("rid")


def links_by_brute_force(texts: dict[int, str], n: int, num: int, den: int) -> dict[int, tuple[int, int, int]]:
    """n_shingles, component and number of links of each key, by comparing all pairs; for tests."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for k, w in found.items()}
    root, links = {k: k for k in texts}, dict.fromkeys(texts, 0)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
                links[a] += 1
                links[b] += 1
    return {k: (len(sets[k]), top(k), links[k]) for k in ids}
