"""SimHash near-duplicates at a Jaccard similarity of word shingles.

Three differing bits of 64 (`simhash`) find copies with hardly an edit; texts of
a similarity of 0.8 differ in about 15 of 100 bits.  So fingerprints here are
wide, cut into many blocks: as wide a block as the number of texts asks for, so
that strangers rarely share one, and as many as it takes for a pair of the least
similarity to share one with a probability of RECALL.  Texts that share a block
are compared by Hamming distance and verified by the exact Jaccard similarity of
their whole sets (64-bit hashes of shingles).  A block of many texts tests each
against its leaders only.  Texts of blocks that the links so found leave in
several pieces, and sets too small for bits to tell, are joined by what a pair
of the least similarity must share: a shingle among the rarest of both."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import Tables, components, parts, returning, sent, stored
from tablescout.llm.dealing import mix

SHINGLE, SIMILARITY = 5, 0.8
#: Probability that a pair of the least similarity shares a block; similar pairs share more.
RECALL = 0.99
#: Bits of a block at least.
NARROW = 16
#: Bits that are compared in a block, and how many may differ: five deviations above what the least similarity gives.
COMPARED = 128
#: Shingles whose bits are counted at once.
STEP = 1 << 12
#: Texts of blocks of more than this are compared with so many leaders and go with the nearest.
LARGE, LEADERS = 8, 2
#: Rows of one block that a task holds before all but the leaders are let go.
HELD = 1 << 18
#: Sets of fewer shingles are joined exactly, whatever their blocks; sizes of one class differ by less than this factor.
FEW, CLASS = 10, 1.05


def differing(similarity: float) -> float:
    """Share of bits in which two sets of equal size and this Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def layout(texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(blocks, bits of each)."""
    bits = min(40, max(NARROW, ceil(log2(texts + 1))))
    shared = (1 - differing(similarity)) ** bits
    return ceil(log(1 - recall) / log(1 - shared)), bits


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes.  ASCII letters lower-cased; fewer words than a shingle are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        out = mix(out ^ hashes[k : k + n]) + np.uint64(k + 1)
    return np.unique(out)


def _node(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def wide_fingerprint(s: np.ndarray, bits: int) -> np.ndarray:
    """bits (rounded up to 64) zeros and ones: one if set in over half of the shingles' hashes."""
    seeds = mix(np.arange(1, -(-bits // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ones = np.zeros(len(seeds) * 64, np.int64)
    for lo in range(0, len(s), STEP):
        hashes = mix(s[lo : lo + STEP, None] ^ seeds)
        each = np.unpackbits(hashes.view(np.uint8), axis=1)
        for k in range(0, len(each), 255):
            ones += np.add.reduce(each[k : k + 255], axis=0, dtype=np.uint8)
    return (2 * ones > len(s)).astype(np.uint8)


def block_keys(fingerprint: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """The number and the bits of each block as one long."""
    values = fingerprint[: blocks * bits].reshape(blocks, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return (np.arange(blocks, dtype=np.int64) << 40) | values


def features(docs: DataFrame, blocks: int, bits: int, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version, other, node (a hash of the set), size, p0, p1 (the first bits), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, first, keys = [], [], [], []
            for t in b.column(3):
                s = shingle_set(t.as_py(), shingle)
                f = wide_fingerprint(s, max(blocks * bits, COMPARED))
                node.append(_node(s))
                size.append(len(s))
                first.append(np.packbits(f[:COMPARED]).view(np.int64))
                keys.append(block_keys(f, blocks, bits) if len(s) else np.zeros(0, np.int64))
            both = np.array(first).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            cols = [*b.columns[:3], pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), listed]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "version", "other", "node", "size", "p0", "p1", "keys"])

    return docs.select("doc_id", "version", "other", "text").mapInArrow(returning(run), "doc_id long, version long, other long, node long, size int, p0 long, p1 long, keys array<long>")


def _apart(c: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distance of the compared bits."""
    return sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in c[3:5])


def _possible(c: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows could link: by size and Hamming distance."""
    size, root = c[2], c[5]
    a, b = size[i].astype(np.int64), size[j].astype(np.int64)
    p = differing(similarity)
    most = COMPARED * p + 5 * (COMPARED * p * (1 - p)) ** 0.5
    return (root[i] != root[j]) & (np.minimum(a, b) + 1e-9 >= similarity * np.maximum(a, b)) & (_apart(c, i, j) <= most)


def _candidates(c: tuple[np.ndarray, ...], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes to verify, from rows sorted by block; rows of blocks that were thinned.  A large block's first rows are its leaders."""
    key, node = c[0], c[1]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    sizes = np.diff(starts)
    small = np.repeat(sizes <= LARGE, sizes)
    out, thinned = [], []
    for d in range(1, min(LARGE, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[d:])
        i = i[_possible(c, i, i + d, similarity)]
        out.append(np.stack([node[i], node[i + d]], 1))
    for g in np.flatnonzero(sizes > LARGE).tolist():
        rows = np.arange(starts[g], starts[g + 1])
        thinned.append(rows)
        fine = np.stack([_possible(c, np.full(len(rows), i), rows, similarity) for i in rows[:LEADERS].tolist()])
        near = np.where(fine, np.stack([_apart(c, np.full(len(rows), i), rows) for i in rows[:LEADERS].tolist()]), COMPARED + 1)
        which = near.argmin(axis=0)
        some = fine.any(axis=0)
        out.append(np.stack([node[rows[which[some]]], node[rows[some]]], 1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
    return np.unique(np.sort(pairs, axis=1), axis=0), np.concatenate([np.zeros(0, np.int64), *thinned])


MET = "thinned boolean, a long, b long, size int, p0 long, p1 long"


def _meet(keyed: DataFrame, n: int, similarity: float) -> DataFrame:
    """MET: candidate pairs (a, b); or, thinned, a block in a and a node of it in b."""

    def rows(c: list[tuple[np.ndarray, ...]], fresh: int = 0) -> Iterator[pa.RecordBatch]:
        """fresh: how many rows of the first block are here for the second time."""
        c = tuple(np.concatenate(x) for x in zip(*c, strict=True))
        pairs, thinned = _candidates(c, similarity)
        thinned = thinned[thinned >= fresh]
        m, t = len(pairs), len(thinned)
        if m + t:
            none = np.zeros(m, np.int64)
            cols = [np.arange(m + t) >= m, np.concatenate((pairs[:, 0], c[0][thinned])), np.concatenate((pairs[:, 1], c[1][thinned])), np.concatenate((none.astype(np.int32), c[2][thinned])), np.concatenate((none, c[3][thinned])), np.concatenate((none, c[4][thinned]))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["thinned", "a", "b", "size", "p0", "p1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        fresh = 0
        for b in batches:
            c = tuple(x.to_numpy() for x in b.columns[:6])
            if not len(c[0]):
                continue
            at = int(np.searchsorted(c[0], c[0][-1]))  # the last key may go on
            if at or (held and held[-1][0][-1] != c[0][-1]):
                yield from rows([*held, tuple(x[:at] for x in c)], fresh)
                held, fresh = [], 0
            held.append(tuple(x[at:] for x in c))
            if sum(len(h[0]) for h in held) > HELD:
                yield from rows(held, fresh)
                held = [tuple(np.concatenate(x)[:LEADERS] for x in zip(*held, strict=True))]
                fresh = LEADERS
        if held:
            yield from rows(held, fresh)

    dealt = keyed.select("key", "node", "size", "p0", "p1", "root", F.xxhash64("node").alias("turn"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "turn").mapInArrow(returning(run), MET)


def size_class(n: np.ndarray | int) -> np.ndarray:
    return np.floor(np.log(n) / log(CLASS) + 1e-9).astype(np.int64)


def prefixes(n: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(length, smaller class, larger class, side) for a set of n shingles:
    against sets of each class, a pair as similar as asked shares one of the
    first `length` shingles of both, in any order that all sets follow.  side: 0
    where it is of the smaller class, 1 of the larger, 2 if both are of one."""
    own = int(size_class(n))
    out = []
    for other in range(int(size_class(max(1, ceil(similarity * n - 1e-9)))), int(size_class(int(n / similarity + 1e-9))) + 1):
        least = max(int(CLASS**other), ceil(similarity * n - 1e-9))
        both = ceil(similarity / (1 + similarity) * (n + least) - 1e-9)
        if n - both + 1 > 0:
            out.append((n - both + 1, min(own, other), max(own, other), 2 if other == own else int(other < own)))
    return out


RARE = "key long, side int, node long, size int, p0 long, p1 long, root long"


def _rare_keys(similarity: float):
    """RARE rows of nodes with their shingles that another node has too, rarest first; the others are rarer still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, size, p0, p1, root, hashes in zip(*b.columns, strict=True):
                n, h = size.as_py(), np.array(hashes.values, np.int64).view(np.uint64)
                alone = n - len(h)
                keys, sides = [], []
                for length, low, high, side in prefixes(n, similarity):
                    if length > alone:
                        of = mix(h[: length - alone] ^ mix(np.array([low << 32 | high << 2 | 1], np.uint64)))
                        keys.append(of)
                        sides.append(np.full(len(of), side, np.int32))
                if keys:
                    k = np.concatenate(keys).view(np.int64)
                    rest = [pa.repeat(x, len(k)) for x in (node, size, p0, p1, root)]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.concatenate(sides)), *rest], ["key", "side", "node", "size", "p0", "p1", "root"])

    return run


def _rare_pairs(keyed: DataFrame, n: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a key, one of each side, and could link."""

    def pairs(c: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        side = c[6]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(c[0])) + 1, [len(c[0])]))
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            right = np.arange(lo, hi)[side[lo:hi] == 1]
            for i in range(lo, hi):
                j = np.arange(i + 1, hi) if side[i] == 2 else right if side[i] == 0 else right[:0]
                j = j[_possible(c, np.full(len(j), i), j, similarity)] if len(j) else j
                if len(j):
                    out.append(np.stack([np.full(len(j), c[1][i]), c[1][j]], 1))
        if out:
            got = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            c = tuple(x.to_numpy() for x in b.columns)
            if not len(c[0]):
                continue
            at = int(np.searchsorted(c[0], c[0][-1]))  # the last key may go on
            if at or (held and held[-1][0][-1] != c[0][-1]):
                yield from pairs(tuple(np.concatenate(x) for x in zip(*[*held, tuple(x[:at] for x in c)], strict=True)))
                held = []
            held.append(tuple(x[at:] for x in c))
        if held:
            yield from pairs(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = keyed.select("key", "node", "size", "p0", "p1", "root", "side")
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(returning(run), "a long, b long")


def _sets(nodes: DataFrame, at: DataFrame, docs: DataFrame, shingle: int, tables: Tables) -> DataFrame:
    """node, s: the hashes of its set.  at: node, doc_id, version of one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["node", "s"])

    wanted = sent(tables.stored(at.join(nodes, "node", "left_semi"), "neardup-wanted"), 32)
    texts = docs.select("doc_id", "version", "text").join(wanted, ["doc_id", "version"]).select("node", "text")
    return tables.stored(texts.mapInArrow(returning(run), "node long, s binary").dropDuplicates(["node"]), "neardup-sets")


def _rare_candidates(open_: DataFrame, sets: DataFrame, n: int, similarity: float) -> DataFrame:
    """Pairs (a, b) that could link among open nodes (node, size, p0, p1, root): every pair as similar as asked is one of them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, s in zip(*b.columns, strict=True):
                h = np.frombuffer(s.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(node, len(h)), pa.array(h)], ["node", "h"])

    each = sets.mapInArrow(returning(hashes), "node long, h long")
    shared = each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    order = F.transform(F.array_sort(F.collect_list(F.struct("times", "h"))), lambda x: x["h"]).alias("hashes")
    ranked = each.join(shared, "h").groupBy("node").agg(order)  # a node's own shingles
    keyed = open_.join(ranked, "node").select("node", "size", "p0", "p1", "root", "hashes").mapInArrow(_rare_keys(similarity), RARE)
    return _rare_pairs(keyed, n, similarity)


def _verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (known: node, s) have at least this similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                held.append(both + 1e-9 >= similarity * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    joined = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(returning(run), "a long, b long")


def one_of_each(docs: DataFrame, columns: list[str], shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Of each component of linked texts, the first row by (doc_id, text's hash,
    hash of its other columns).

    A pair of exactly `similarity` is found with probability `recall`, and the
    more similar, the surer, pairs of sets under FEW shingles always; no pair
    below it links.  Texts without words are
    alike, null ones too.  Rows without an id stay and link nothing.  Of equal
    rows one stays; rows of one doc_id and different texts are texts of their
    own.  An empty table gives no rows.  Other columns than `columns` (which
    must hold doc_id and text) are dropped."""
    other = F.xxhash64(*[c for c in columns if c not in ("doc_id", "text")], F.lit(0)).alias("other")
    whole = docs.select(*columns, F.xxhash64("text").alias("version"), other)
    known = whole.where("doc_id is not null")
    blocks, bits = layout(known.count(), similarity, recall)
    tables = Tables()
    found = tables.stored(features(known, blocks, bits, shingle), "neardup")
    # equal sets are one node from here on
    nodes = tables.stored(found.dropDuplicates(["node"]), "neardup-nodes")
    at = nodes.select("node", "doc_id", "version")
    n = parts(nodes)
    keyed = nodes.select("node", "size", "p0", "p1", F.explode("keys").alias("key")).withColumn("root", F.col("node"))
    met = tables.stored(_meet(keyed, n, similarity), "neardup-pairs")
    pairs = tables.stored(met.where("not thinned").select("a", "b").distinct(), "neardup-candidates")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = tables.stored(_verified(pairs, _sets(ends, at, known, shingle, tables), similarity), "neardup-links")
    roots = components(links, "neardup-roots", tables)
    rooted = lambda rows: rows.join(sent(roots, 16), "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = tables.stored(rooted(met.where("thinned").select(F.col("a").alias("key"), F.col("b").alias("node"))), "neardup-left")
    # blocks whose texts are connected already have nothing to find
    split = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    parted = left.join(sent(tables.stored(split, "neardup-blocks"), 16), "key", "left_semi").select("node")
    some = parted.unionByName(nodes.where(F.col("size").between(1, FEW - 1)).select("node")).distinct()
    open_ = tables.stored(rooted(nodes.select("node", "size", "p0", "p1").join(some, "node", "left_semi")), "neardup-open")
    if open_.limit(1).count():
        sets = _sets(open_.select("node"), at, known, shingle, tables)
        pairs = tables.stored(_rare_candidates(open_, sets, n, similarity).distinct(), "neardup-candidates")
        links = links.unionByName(tables.stored(_verified(pairs, sets, similarity), "neardup-links"))
        roots = components(links, "neardup-roots", tables)
    place_of = F.struct("doc_id", "version", "other").alias("at")
    place = found.select("node", place_of).join(sent(roots, 16), "node", "left").groupBy(F.coalesce("root", "node").alias("root"), "at").agg(F.count("*").alias("copies"))
    first = stored(place.groupBy("root").agg(F.min(F.struct("at", "copies")).alias("m")).select("m.at.*", "m.copies"), "neardup-first")
    tables.clear()
    kept = known.join(sent(first, 40), ["doc_id", "version", "other"])
    alone = kept.where("copies = 1").select(columns).unionByName(kept.where("copies > 1").select(columns).dropDuplicates(columns))
    return alone.unionByName(whole.where("doc_id is null").select(columns))
