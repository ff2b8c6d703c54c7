"""Repeated byte strings by a hash-compared suffix sort.

Every string of `length` bytes is assigned to the least-hashed gram within it;
consecutive strings with the same least gram travel to that gram's bucket as one
piece of text with the gram as its anchor, so equal strings always meet, aligned
at their anchors.  In a bucket, the suffixes that start at equal anchors, and
the reversed prefixes that end there, are mergesorted; two of them are compared
by prefix polynomial hashes, a binary search for their common extension taking
logarithmic steps.  How far a piece's text is shared follows from its sorted
neighbours, and what they leave open from the hashes of whole strings.  Equal
hashes are always verified on the bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.dealing import Doc, ask_and_answer, least_positions, mix, power_table, prefix_hashes

LENGTH = 200
GRAM = 32
#: Strings that are looked at together; longer texts go in several steps.
STEP = 1 << 19
#: Bytes of pieces that are sorted together; a group of one anchor stays whole.
SORTED = 1 << 21


# ------------------------------------------------------------ suffix sort


class Text:
    """Bytes with prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = prefix_hashes(data.tobytes())
        self.inverse = power_table(len(data) + 1)[1]

    def hashes(self, a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.prefix[a + n] - self.prefix[a]) * self.inverse[a]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from a and b, up to most, by binary search."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hashes(a, mid) == self.hashes(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        # a collision can only make it too long: the last common byte tells for polynomial hashes, the caller verifies what it uses
        return lo

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n, cut at the first byte that differs in fact."""
        d, out = self.data, n.copy()
        for k, (x, y, m) in enumerate(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)):
            if m and not np.array_equal(d[x : x + m], d[y : y + m]):
                out[k] = np.flatnonzero(d[x : x + m] != d[y : y + m])[0]
        return out

    def less(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether suffix a of na bytes sorts before suffix b of nb bytes."""
        most = np.minimum(na, nb)
        k = self.common(a, b, most)
        ended, top = k == most, len(self.data) - 1
        return np.where(ended, na < nb, self.data[np.minimum(a + k, top)] < self.data[np.minimum(b + k, top)])


def sort_suffixes(text: Text, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes within their groups (group ascends): bottom-up mergesort, all merges of a level at once."""
    n = len(start)
    begin = np.searchsorted(group, group, side="left")
    count = np.searchsorted(group, group, side="right") - begin
    order, width = np.arange(n), 1
    while True:
        active = np.flatnonzero(count > width)
        if not len(active):
            return order
        place = active - begin[active]
        run = place // width
        other = begin[active] + (run ^ 1) * width
        stop = np.minimum(other + width, begin[active] + count[active])
        keep = other < begin[active] + count[active]
        active, place, run, lo, stop = active[keep], place[keep], run[keep], other[keep], stop[keep]
        own, first, hi = order[active], lo.copy(), stop.copy()
        left = (run & 1) == 0
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            me, it = own[open_], order[mid]
            # a left run's equal comes first
            before = np.where(left[open_], text.less(start[it], size[it], start[me], size[me]), ~text.less(start[me], size[me], start[it], size[it]))
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = begin[active] + (run >> 1) * (2 * width) + place % width + (lo - first)
        new = order.copy()
        new[to] = own
        order, width = new, width * 2


# ------------------------------------------------------------ buckets


def equal_strings(data: np.ndarray, start: np.ndarray, length: int, h: np.ndarray) -> np.ndarray:
    """Which of the strings data[start : start + length] equal another, by hash;
    strings that differ from the first of their hash are hashed anew."""
    while True:
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(order) else np.zeros(0, bool)
        first = np.empty(len(order), np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        again = np.flatnonzero(first != np.arange(len(first)))
        wrong = [k for k in again.tolist() if not np.array_equal(data[start[k] : start[k] + length], data[start[first[k]] : start[first[k]] + length])]
        if not wrong:
            return np.union1d(again, first[again])
        h = h.copy()
        h[wrong] = [xxhash.xxh64_intdigest(data[start[k] : start[k] + length].tobytes(), 1) for k in wrong]


def shared_spans(pieces: list[bytes], anchors: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces, equal ones too, aligned at their anchors within their groups:
    from where to where each is covered by strings that another has too (0, 0: none)."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ahead, back = Text(data), Text(data[::-1])
    at, right, left = begin + anchors, size - anchors, anchors
    at_back = len(data) - at
    reach_r, reach_l = np.zeros(n, np.int64), np.zeros(n, np.int64)  # as far as any other goes with it
    best_r, best_l = np.zeros(n, np.int64), np.zeros(n, np.int64)  # as far as one goes that shares a whole string
    for text, start, limit in ((ahead, at, right), (back, at_back, left)):
        order = sort_suffixes(text, start, limit, group)
        near = np.flatnonzero(group[order][1:] == group[order][:-1])
        i, j = order[near], order[near + 1]
        r = ahead.common(at[i], at[j], np.minimum(right[i], right[j]))
        l = back.common(at_back[i], at_back[j], np.minimum(left[i], left[j]))  # noqa: E741
        reach, extent = (reach_r, r) if text is ahead else (reach_l, l)
        np.maximum.at(reach, i, extent)
        np.maximum.at(reach, j, extent)
        whole = np.flatnonzero(r + l >= length)
        i, j, r, l = i[whole], j[whole], r[whole], l[whole]  # noqa: E741
        r, l = ahead.verified(at[i], at[j], r), back.verified(at_back[i], at_back[j], l)  # noqa: E741
        sure = r + l >= length
        for k in (i, j):
            np.maximum.at(best_r, k[sure], r[sure])
            np.maximum.at(best_l, k[sure], l[sure])
    unclear = (reach_r + reach_l >= length) & ((best_r < reach_r) | (best_l < reach_l))
    if unclear.any():
        groups = np.unique(group[unclear])
        member = np.flatnonzero(np.isin(group, groups) & (reach_r + reach_l >= length))
        low, high = np.maximum(0, length - reach_r[member]), reach_l[member]  # strings that start so far before the anchor
        many = high - low + 1
        which = np.repeat(member, many)
        x = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        start = at[which] - x
        h = mix(ahead.hashes(start, length)) ^ mix(group[which].astype(np.uint64) * np.uint64(512) + x.astype(np.uint64))
        k = equal_strings(data, start, length, h)
        np.maximum.at(best_l, which[k], x[k])
        np.maximum.at(best_r, which[k], length - x[k])
    some = (best_l + best_r) >= length
    return np.where(some, anchors - best_l, 0), np.where(some, anchors + best_r, 0)


# ------------------------------------------------------------ blocks


class _Block:
    """The pieces of a block's documents: at (first byte, in the block's text),
    n (strings), anchor (the gram's place in the piece), key, number (equal
    pieces have the same), times (how often a number occurs here)."""

    def __init__(self, docs: list[Doc], length: int, gram: int):
        self.length = length
        self.ends = np.cumsum([len(t) for _, t in docs]) if docs else np.zeros(0, np.int64)
        self.text = b"".join([t for _, t in docs])
        found = list(self._find(gram))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.at, self.n, self.anchor, self.key, self.hash = columns
        self._number()

    def _find(self, gram: int):
        length, total = self.length, len(self.text)
        for lo in range(0, total - length + 1, STEP):
            hi = min(lo + STEP, total - length + 1)
            part = self.text[lo : hi + length - 1]
            prefix, inverse = prefix_hashes(part), power_table(len(part) + 1)[1]
            grams = mix((prefix[gram:] - prefix[: len(prefix) - gram]) * inverse[: len(prefix) - gram])
            where = least_positions(grams, length - gram + 1)
            inside = np.ones(hi - lo, bool)
            for e in self.ends[np.searchsorted(self.ends, lo, side="right") :].tolist():  # strings that would cross an end
                if e - length + 1 >= hi:
                    break
                inside[max(0, e - length + 1 - lo) : max(0, e - lo)] = False
            change = np.concatenate(([True], where[1:] != where[:-1])) | np.concatenate(([True], inside[1:] != inside[:-1]))
            new = np.flatnonzero(change)
            n = np.diff(np.append(new, hi - lo))
            good = inside[new]
            new, n = new[good], n[good]
            size = n + length - 1
            whole = (prefix[new + size] - prefix[new]) * inverse[new]
            yield new + lo, n, where[new] - new, grams[where[new]], mix(whole + n.astype(np.uint64))

    def strings(self, which: np.ndarray) -> list[bytes]:
        a = self.at[which]
        return [self.text[x:y] for x, y in zip(a.tolist(), (a + self.n[which] + self.length - 1).tolist(), strict=True)]

    def _number(self) -> None:
        while True:
            order = np.lexsort((self.at, self.hash))
            same = np.concatenate(([False], self.hash[order][1:] == self.hash[order][:-1])) if len(order) else np.zeros(0, bool)
            self.number = np.empty(len(order), np.int64)
            self.number[order] = np.cumsum(~same) - 1
            self.first = order[~same]
            self.times = np.bincount(self.number, minlength=len(self.first))
            again = np.sort(order[same])
            wrong = [k for k, x, y in zip(again.tolist(), self.strings(again), self.strings(self.first[self.number[again]]), strict=True) if x != y]
            if not wrong:
                return
            self.hash[wrong] = [xxhash.xxh64_intdigest(x, 1) for x in self.strings(np.array(wrong))]

    def by_bucket(self, buckets: int) -> dict[int, np.ndarray]:
        bucket = (self.key[self.first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return {int(bucket[g[0]]): g for g in np.split(order, cuts) if len(g)}


def _ask(length: int, gram: int):
    def ask(docs: list[Doc], buckets: int) -> Iterator[tuple[int, Any]]:
        block = _Block(docs, length, gram)
        for bucket, numbers in block.by_bucket(buckets).items():
            who = block.first[numbers]
            yield bucket, (block.key[who], b"".join(block.strings(who)), block.n[who].astype(np.int32), block.anchor[who].astype(np.int32), np.minimum(block.times[numbers], 2).astype(np.int8))

    return ask


def _answer(length: int):
    def answer(parcels: list[Any]) -> list[Any]:
        """For each asked piece that shares a string with a piece of another block
        or with a different one: (index, from, to)."""
        keys = np.concatenate([p[0] for p in parcels])
        who = np.repeat(np.arange(len(parcels)), [len(p[0]) for p in parcels])
        index = np.concatenate([np.arange(len(p[0])) for p in parcels])
        size = np.concatenate([p[2] for p in parcels]).astype(np.int64) + length - 1
        begin = np.concatenate([np.cumsum(p[2].astype(np.int64) + length - 1) - p[2] - length + 1 for p in parcels])
        anchor = np.concatenate([p[3] for p in parcels]).astype(np.int64)
        times = np.concatenate([p[4] for p in parcels])
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[back] > 1)
        several = several[np.argsort(back[several], kind="stable")]
        low, high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        held: list[tuple[int, bytes, int]] = []
        held_bytes = 0

        def settle() -> None:
            nonlocal held_bytes
            if held:
                which = np.array([k for _, _, k in held])
                a, b = shared_spans([p for _, p, _ in held], anchor[which], np.array([g for g, _, _ in held]), length)
                low[which], high[which] = a, b
            held.clear()
            held_bytes = 0

        cuts = np.flatnonzero(np.diff(back[several])) + 1
        for g, entries in enumerate(np.split(several, cuts) if len(several) else []):
            held += [(g, parcels[who[k]][1][begin[k] : begin[k] + size[k]], k) for k in entries.tolist()]
            held_bytes += int(size[entries].sum())
            if held_bytes > SORTED:
                settle()
        settle()
        twice = times > 1
        low[twice], high[twice] = 0, size[twice]
        out = []
        for w in range(len(parcels)):
            mine = np.flatnonzero((who == w) & (high > 0))
            out.append((index[mine].astype(np.int32), low[mine].astype(np.int32), high[mine].astype(np.int32)) if len(mine) else None)
        return out

    return answer


def _apply(length: int, gram: int, with_text: bool):
    def apply(docs: list[Doc], replies: dict[int, Any], buckets: int) -> pa.Table:
        block = _Block(docs, length, gram)
        low = np.zeros(len(block.first), np.int64)
        high = np.where(block.times > 1, block.n[block.first] + length - 1, 0)
        numbers_of = block.by_bucket(buckets)
        for bucket, (asked, a, b) in replies.items():
            numbers = numbers_of[bucket][asked]
            low[numbers], high[numbers] = np.where(high[numbers] > 0, np.minimum(low[numbers], a), a), np.maximum(high[numbers], b)
        a, b = block.at + low[block.number], block.at + high[block.number]
        some = b > a
        covered = np.zeros(len(block.text) + 1, np.int32)
        np.add.at(covered, a[some], 1)
        np.add.at(covered, b[some], -1)
        lost = np.cumsum(covered[:-1], dtype=np.int32) > 0
        data, out, begin = np.frombuffer(block.text, np.uint8), [], 0
        for (doc, text), end in zip(docs, block.ends.tolist(), strict=True):
            gone = lost[begin:end]
            m, spans = int(gone.sum()), 0
            if m:
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                text = data[begin:end][~gone].tobytes()
            out.append((doc, end - begin, m, spans, hashlib.sha256(text).hexdigest(), text if with_text else None))
            begin = end
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return apply


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept
    (binary: what stays, which may cut a UTF-8 character); a row for each row.

    A byte goes if a string of `length` bytes that covers it also starts
    anywhere else, in any row, the same included, overlaps too.  Strings never
    cross rows and are judged on the input.  Null and empty texts have no bytes;
    repeated rows are different places, so all of a long enough repeated text
    goes.  Null ids stay null.  Other columns of docs are not looked at."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ask_and_answer(given, _ask(length, gram), _answer(length), _apply(length, gram, with_text), schema)


