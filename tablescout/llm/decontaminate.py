"""Benchmark items inside documents: MinHash containment search by item size.

An item's MinHash sketch holds its least shingle hashes.  Items are partitioned
by their number of shingles, each partition an index of its own; items of up to
u shingles take sketches of floor((1 - threshold) * u) + 1 hashes, so that a
document that holds `threshold` of an item's shingles misses too few to miss the
whole sketch: at least one of its hashes is in the document, however long that
is.  Documents that hit a sketch are verified by exact containment of shingles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import plan_bytes, returning, stored
from tablescout.llm.dealing import BASE, mix
from tablescout.llm.substrings import word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Items of up to so many bytes are searched for in one pass; more go in several passes.
PASS_BYTES = 16 << 20


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """Distinct runs of n words; fewer words: the whole sequence; none: none."""
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def gram_hashes(joined: bytes, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of all runs of so many words, and where words start."""
    offsets = np.concatenate(([0], np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1, [len(joined) + 1]))
    h = word_hashes(joined, offsets)
    out = {}
    for n in sizes:
        if len(h) >= n:
            g = h[: len(h) - n + 1]
            for i in range(1, n):
                g = g * np.uint64(BASE) + h[i : len(h) - n + 1 + i]
            out[n] = (mix(g + np.uint64(n)), offsets)
    return out


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


class Partition:
    """Sketches of the items of one range of sizes: the `kept` least hashes of
    each.  Hashes above the largest of them can't hit, so few of a text's are looked up."""

    def __init__(self, words: int, upper: int, threshold: float):
        self.words, self.kept = words, floor((1 - threshold) * upper + 1e-9) + 1
        self.members: dict[int, list[int]] = defaultdict(list)
        self.keys = np.zeros(0, np.uint64)

    def add(self, item: int, hashes: np.ndarray) -> None:
        for h in hashes[: self.kept].tolist():
            self.members[h].append(item)

    def close(self) -> None:
        self.keys = np.array(sorted(self.members), np.uint64)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items of which a sketch hash is among the given sorted ones."""
        low = hashes[: np.searchsorted(hashes, self.keys[-1], side="right")]
        at = np.searchsorted(self.keys, low)
        return {i for h in low[self.keys[np.minimum(at, len(self.keys) - 1)] == low].tolist() for i in self.members[h]}


class ItemIndex:
    """Partitions by an item's words a shingle and its number of shingles, up to the next power of two."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold, self.ids, self.sets = threshold, [], []
        parts: dict[tuple[int, int], Partition] = {}
        for item, text in items:
            words = normal(text).split()
            if not words:
                continue
            n = min(shingle, len(words))
            hashes = np.unique(gram_hashes(b" ".join(words), [n])[n][0])
            upper = 1 << (len(hashes) - 1).bit_length()
            if (n, upper) not in parts:
                parts[n, upper] = Partition(n, upper, threshold)
            parts[n, upper].add(len(self.ids), hashes)
            self.ids.append(item)
            self.sets.append(shingles(words, shingle))
        self.partitions: dict[int, list[Partition]] = defaultdict(list)
        for (n, _), part in sorted(parts.items()):
            part.close()
            self.partitions[n].append(part)

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item's index, shared shingles) of the items that the text contains."""
        joined = normal(text)
        if not joined or not self.ids:
            return []
        found = []
        for n, (hashes, _) in gram_hashes(joined, list(self.partitions)).items():
            hashes = np.sort(hashes)
            candidates = set().union(*(part.candidates(hashes) for part in self.partitions[n]))
            if not candidates:
                continue
            words = joined.split(b" ")
            have = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            for i in sorted(candidates):
                shared = len(self.sets[i] & have)
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    found.append((i, shared))
        return found


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, doc_id, n_shingles, n_shared, containment: a row for each item
    and document that holds at least `threshold` of its distinct word shingles.

    Texts are lower-cased.  Items of fewer words than a shingle are one shingle
    of all their words; empty and null items are in no document, and empty and
    null documents hold none.  Repeated rows on either side give repeated rows.
    Ids may be null.  Other columns are not looked at.  Items are sent to all
    executors in passes of PASS_BYTES each (by a hash of the item), so any
    number of them is searched for."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index, several in _indexes(items, item_col, item_text, shingle, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            it = index.value
            for b in batches:
                rows = [(it.ids[i], doc.as_py(), len(it.sets[i]), n, n / len(it.sets[i])) for doc, text in zip(b.column(0), b.column(1), strict=True) for i, n in it.search(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], ["item_id", "doc_id", "n_shingles", "n_shared", "containment"])

        found = given.mapInArrow(returning(run), "item_id long, doc_id long, n_shingles long, n_shared long, containment double")
        if several:  # one index at a time
            found = stored(found, "contained")
            index.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(items: DataFrame, item_col: str, item_text: str, shingle: int, threshold: float) -> Iterator:
    """A broadcast index of bounded size for each pass over the documents, and whether there are several."""
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    passes = max(1, -(-plan_bytes(wanted) * 3 // PASS_BYTES))
    for p in range(passes):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else wanted
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([(r.item_id, r.text) for r in mine.collect()], shingle, threshold)), passes > 1


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that contain no item (see
    `contained_items`): empty and null texts stay, repeated rows are treated
    alike, an empty table of items keeps all rows."""
    at = docs.columns.index(text_col)
    for index, several in _indexes(items, item_col, item_text, shingle, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not index.value.search(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(returning(run), docs.schema)
        if several:  # one index at a time
            docs = stored(docs, "without-items")
            index.unpersist()
    return docs
