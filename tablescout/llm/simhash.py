"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits; two texts link at `distance` or fewer
differing bits.  Cut into six blocks, fingerprints that differ in at most three
bits agree on three blocks at least, so every linked pair meets under one of
the 20 choices of three blocks, a key of 32 bits or more; the Hamming distance
is verified there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import components, parts, sent, stored

DISTANCE = 3
BLOCKS = 6
SHINGLE = 3
SEED = 42
#: Groups up to this size are compared pair by pair, larger ones are cut by their other bits first.
PAIRWISE = 512
#: Shingles whose bits are counted at once.
STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """ASCII letters lower-cased; a bit is 1 if set in over half the shingles' XXH64, repeats included.
    Fewer words than a shingle are one shingle; a text without words (or null) has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - distance)]


def _forest(fps: np.ndarray, distance: int, free: int) -> Iterator[tuple[int, int]]:
    """Links (indices) that span every component of the given distinct
    fingerprints; free: mask of the bits in which they can differ.  A large
    group is cut again: bits split into distance + 1 parts, of which a linked
    pair shares one."""
    n = len(fps)
    bits = [1 << i for i in range(64) if free >> i & 1]
    if n > PAIRWISE and len(bits) > distance:
        for part in range(distance + 1):
            mask = np.uint64(sum(bits[part :: distance + 1]))
            order = np.argsort(fps & mask, kind="stable")
            cuts = np.flatnonzero(np.diff(fps[order] & mask)) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    for a, b in _forest(fps[group], distance, free & ~int(mask)):
                        yield int(group[a]), int(group[b])
        return
    root = np.arange(n)
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= distance)
        if len(near):
            roots, first = np.unique(root[near], return_index=True)
            for j in near[first]:
                yield int(j), i
            root[np.isin(root, roots)] = i
            root[i] = i


def block_links(reps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between representatives (fp, rep) of different fingerprints.
    Within a key a spanning forest of the linked pairs is enough; all pairs are
    never written.  A key's group is held as 16 bytes a fingerprint."""
    masks = block_masks(blocks, distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(masks)])).alias("k")
    keyed = reps.select("fp", "rep", keys).select("k.choice", "k.bits", "fp", "rep")
    dealt = keyed.repartition(parts(reps), "choice", "bits").sortWithinPartitions("choice", "bits")

    def flush(choice: int, fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
        return [(int(rep[a]), int(rep[b])) for a, b in _forest(fp, distance, ((1 << 64) - 1) & ~masks[choice])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def link(cols: tuple[np.ndarray, ...], whole: bool) -> tuple[list[tuple[int, int]], tuple[np.ndarray, ...]]:
            choice, bits, fp, rep = cols
            cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1
            edges = [0, *cuts.tolist(), len(choice)]
            out: list[tuple[int, int]] = []
            last = len(edges) - 1 if whole else len(edges) - 2
            starts, stops = np.array(edges[:-1])[:last], np.array(edges[1:])[:last]
            big = stops - starts > 1
            for a, b in zip(starts[big].tolist(), stops[big].tolist(), strict=True):
                out += flush(int(choice[a]), fp[a:b], rep[a:b])
            at = edges[last] if not whole else len(choice)
            return out, tuple(c[at:] for c in cols)

        for b in batches:
            cols = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy())
            if held and cols[0].size and (held[-1][0][-1] == cols[0][-1]) and held[-1][1][-1] == cols[1][-1]:
                held.append(cols)  # still the same key: joined once, when it ends
                continue
            held.append(cols)
            out, rest = link(tuple(np.concatenate(c) for c in zip(*held, strict=True)), False)
            held = [rest]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if held:
            out, _ = link(tuple(np.concatenate(c) for c in zip(*held, strict=True)), True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, a row for each row of docs.

    component_id is the smallest doc_id that links reach.  Null and empty texts
    have fingerprint zero and link like any other.  Rows with a null id get a
    fingerprint; they join the component of their fingerprint if another row
    has it, else theirs is null.  An empty table gives no rows.  Other columns
    of docs are not looked at."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # a doc_id may stand for several fingerprints if ids repeat; links are between ids, as reachability is
    roots = components(block_links(reps, distance), "simhash-links")
    ids = fps.where("doc_id is not null").select(F.col("doc_id").alias("a"), "fp").join(reps, "fp").select("a", F.col("rep").alias("b"))
    repeated = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").limit(1).count() > 0
    if repeated:
        roots = components(block_links(reps, distance).unionByName(ids), "simhash-links")
    # written, so that it is sent to all executors if small, or else Spark can split a hot fingerprint's rows
    named = stored(reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "simhash-names")
    named = sent(named, 24)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp", "left").select("doc_id", hexed, "component_id")
