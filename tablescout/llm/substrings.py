"""Repeated word windows by super-k-mer partitioning.

A window is `window` consecutive words of one document.  Its minimiser is the
least hash among its grams of `gram` words; consecutive windows whose minimiser
is the same gram form a super-k-mer and travel as one packed string of words to
the minimiser's bucket.  Equal windows have equal minimisers, so they meet in
one bucket, where sorted windows are compared as strings and counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.dealing import BASE, BYTES, Doc, ask_and_answer, least_positions, mix, power_table

WINDOW = 20
GRAM = 3
#: Windows that are looked at together; longer texts go in several steps.
STEP = 1 << 18
#: Bytes whose words are hashed at once.
HASHED = 1 << 20


_NONE = -(1 << 63)  # a null id counts as the smallest


def word_hashes(joined: bytes, offsets: np.ndarray) -> np.ndarray:
    """Hashes of the words of `joined`, of about HASHED bytes at a time; offsets:
    where each starts, and one past the end plus one."""
    out = np.empty(len(offsets) - 1, np.uint64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + HASHED)) - 1)
        begin = int(offsets[lo])
        at = offsets[lo : hi + 1] - begin
        values = BYTES[np.frombuffer(joined, np.uint8, int(at[-1]) - 1, begin)]
        powers, inverse = power_table(len(values) + 2)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)])))
        out[lo:hi] = mix((prefix[at[1:] - 1] - prefix[at[:-1]]) * inverse[at[:-1]])
        lo = hi
    return out


class _Block:
    """The super-k-mers of a block's documents, in document order.  Arrays with
    an entry each: row (document), at (first word, counted in `words` of its
    piece), place (first word in its document), n (windows), key (minimiser),
    number (equal super-k-mers have the same).  `strings` cuts the packed
    strings of given ones."""

    def __init__(self, docs: list[Doc], window: int, gram: int):
        self.docs, self.window, self.gram = docs, window, gram
        self.doc_of = np.array([_NONE if d is None else d for d, _ in docs], np.int64)
        self.pieces: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []  # first row, joined words, offsets of words, first word of rows
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(docs):
            texts: list[bytes] = []
            begin, first = [0], at
            while at < len(docs) and begin[-1] < STEP:
                texts.append(b" ".join(docs[at][1].split()))
                begin.append(begin[-1] + (texts[-1].count(b" ") + 1 if texts[-1] else 0))
                at += 1
            joined = b" ".join([t for t in texts if t])
            offsets = np.concatenate(([0], np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1, [len(joined) + 1]))
            self.pieces.append((first, joined, offsets, np.array(begin)))
            found += self._find(joined, offsets, np.array(begin), first, len(self.pieces) - 1)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)] * 2
        self.piece, self.row, self.at, self.place, self.n, self.key, self.hash = columns
        self._number()

    def _find(self, joined: bytes, offsets: np.ndarray, begin: np.ndarray, first: int, piece: int):
        window, gram, ends, starts = self.window, self.gram, begin[1:], begin[:-1]
        total = int(begin[-1])
        for lo in range(0, total - window + 1, STEP):
            hi = min(lo + STEP, total - window + 1)  # windows lo .. hi
            cut = offsets[lo : hi + window]
            part = word_hashes(joined[cut[0] : cut[-1] - 1], cut - cut[0])
            grams = part[: len(part) - gram + 1]
            for i in range(1, gram):
                grams = grams * np.uint64(BASE) + part[i : len(part) - gram + 1 + i]
            grams = mix(grams)
            where = least_positions(grams, window - gram + 1)
            index = np.arange(lo, hi)
            row = np.searchsorted(ends, index, side="right")
            inside = index + window <= ends[np.minimum(row, len(ends) - 1)]
            index, where, row = index[inside], where[inside], row[inside]
            if not len(index):
                continue
            new = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(index) != 1) | (np.diff(row) != 0))))
            n, at, row = np.diff(np.append(new, len(index))), index[new], row[new]
            powers, inverse = power_table(len(part) + 1)
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(part) * powers[: len(part)])))
            whole = (prefix[at - lo + n + window - 1] - prefix[at - lo]) * inverse[at - lo]
            yield np.full(len(at), piece), row + first, at, at - starts[row], n, grams[where[new]], mix(whole + n.astype(np.uint64))

    def strings(self, which: np.ndarray) -> list[bytes]:
        out: list[bytes] = []
        for p in range(len(self.pieces)):  # `which` ascends, and so do pieces
            mine = which[self.piece[which] == p]
            _, joined, offsets, _ = self.pieces[p]
            a, b = offsets[self.at[mine]], offsets[self.at[mine] + self.n[mine] + self.window - 1] - 1
            out += [joined[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return out

    def _number(self) -> None:
        """Numbers by 64-bit hash; equal hashes are compared as strings, and hashed anew if those differ."""
        rank = np.unique(self.doc_of, return_inverse=True)[1][self.row] if len(self.row) else self.row
        while True:
            order = np.lexsort((self.place, rank, self.hash))
            same = np.concatenate(([False], self.hash[order][1:] == self.hash[order][:-1])) if len(order) else np.zeros(0, bool)
            self.number = np.empty(len(order), np.int64)
            self.number[order] = np.cumsum(~same) - 1
            self.first = order[~same]  # of each number, the earliest
            again = np.sort(order[same])
            origin = self.first[self.number[again]]
            uniq, back = np.unique(origin, return_inverse=True)
            kept = self.strings(uniq)
            if all(x == kept[y] for x, y in zip(self.strings(again), back.tolist(), strict=True)):
                return
            wrong = [k for k, x, y in zip(again.tolist(), self.strings(again), back.tolist(), strict=True) if x != kept[y]]
            self.hash[wrong] = [xxhash.xxh64_intdigest(x, 1) for x in self.strings(np.array(wrong))]

    def by_bucket(self, buckets: int) -> dict[int, np.ndarray]:
        """bucket -> numbers, in the order in which they are asked."""
        bucket = (self.key[self.first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return {int(bucket[g[0]]): g for g in np.split(order, cuts) if len(g)}


def _ask(window: int, gram: int):
    def ask(docs: list[Doc], buckets: int) -> Iterator[tuple[int, Any]]:
        block = _Block(docs, window, gram)
        every = np.sort(block.first)
        text = dict(zip(every.tolist(), block.strings(every), strict=True))
        for bucket, numbers in block.by_bucket(buckets).items():
            who = block.first[numbers]
            yield bucket, (block.key[who], b"\n".join([text[i] for i in who.tolist()]), block.doc_of[block.row[who]], block.place[who])

    return ask


def _shared_windows(members: list[bytes], begin: list[tuple[int, int]], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For super-k-mers of one minimiser: the first (document, place) of each window, by sorting the windows' strings."""
    rows = []
    for k, p in enumerate(members):
        words = p.split(b" ")
        d, a = begin[k]
        rows += [(b" ".join(words[i : i + window]), d, a + i, k, i) for i in range(len(words) - window + 1)]
    rows.sort()
    found = [(np.empty(n, np.int64), np.empty(n, np.int64)) for n in (m.count(b" ") + 2 - window for m in members)]
    for _, same in groupby(rows, key=lambda r: r[0]):
        d0 = None
        for _, d, a, k, i in same:
            d0, a0 = (d, a) if d0 is None else (d0, a0)
            found[k][0][i], found[k][1][i] = d0, a0
    return found


def _answer(window: int):
    def answer(parcels: list[Any]) -> list[Any]:
        """For each asked string that shares a window with another: the first (document, place) of each of its windows."""
        keys = np.concatenate([p[0] for p in parcels])
        who = np.repeat(np.arange(len(parcels)), [len(p[0]) for p in parcels])
        index = np.concatenate([np.arange(len(p[0])) for p in parcels])
        doc, at = np.concatenate([p[2] for p in parcels]), np.concatenate([p[3] for p in parcels])
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[back] > 1)
        several = several[np.argsort(back[several], kind="stable")]
        text = [p[1].split(b"\n") for p in parcels]
        replies: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in parcels]
        group, cuts = back[several], np.flatnonzero(np.diff(back[several])) + 1
        entries = list(zip(who[several].tolist(), index[several].tolist(), doc[several].tolist(), at[several].tolist(), strict=True))
        edges = [0, *cuts.tolist(), len(group)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            whole: dict[bytes, list] = {}
            for w, j, d, a in entries[lo:hi]:
                if (x := whole.get(text[w][j])) is None:
                    whole[text[w][j]] = [(d, a), (w, j)]
                else:
                    x[0] = min(x[0], (d, a))
                    x.append((w, j))
            if not whole:
                continue
            members = list(whole)
            if len(members) == 1:
                (d, a), *asked = whole[members[0]]
                n = members[0].count(b" ") + 2 - window
                reply = (np.full(n, d), np.arange(a, a + n))
                for w, j in asked:
                    replies[w].append((j, *reply))
                continue
            found = _shared_windows(members, [whole[m][0] for m in members], window)
            for m, (docs, places) in zip(members, found, strict=True):
                (d, a), *asked = whole[m]
                if len(asked) > 1 or not ((docs == d) & (places == np.arange(a, a + len(places)))).all():
                    for w, j in asked:
                        replies[w].append((j, docs, places))
        return [(np.array([r[0] for r in rs]), np.concatenate([r[1] for r in rs]), np.concatenate([r[2] for r in rs])) if rs else None for rs in replies]

    return answer


def _apply(window: int, gram: int, with_text: bool):
    def apply(docs: list[Doc], replies: dict[int, Any], buckets: int) -> pa.Table:
        block = _Block(docs, window, gram)
        many = block.n[block.first]
        offset = np.concatenate(([0], np.cumsum(many)))
        first_doc = np.repeat(block.doc_of[block.row[block.first]], many)
        first_at = np.repeat(block.place[block.first] - offset[:-1], many) + np.arange(offset[-1])
        numbers_of = block.by_bucket(buckets)
        for bucket, (asked, doc, at) in replies.items():
            numbers = numbers_of[bucket][asked]
            size = many[numbers]
            to = np.repeat(offset[numbers] - np.cumsum(size) + size, size) + np.arange(size.sum())
            first_doc[to], first_at[to] = doc, at
        out = []
        for k, (first, joined, offsets, begin) in enumerate(block.pieces):
            mine = np.flatnonzero(block.piece == k)
            n = block.n[mine]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = np.repeat(offset[block.number[mine]], n) + step
            doc, place = np.repeat(block.doc_of[block.row[mine]], n), np.repeat(block.place[mine], n) + step
            gone = (first_doc[flat] < doc) | ((first_doc[flat] == doc) & (first_at[flat] < place))
            start = (np.repeat(block.at[mine], n) + step)[gone]
            length = int(begin[-1])
            covered = np.bincount(start, minlength=length + 1) - np.bincount(start + window, minlength=length + 1)
            lost = np.cumsum(covered)[:length] > 0
            for r, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                m = int(lost[a:b].sum())
                kept = joined[offsets[a] : max(offsets[a], offsets[b] - 1)] if b > a else b""
                if m:
                    words = kept.split(b" ")
                    kept = b" ".join([words[i] for i in np.flatnonzero(~lost[a:b]).tolist()])
                out.append((docs[first + r][0], b - a, m, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return apply


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (the words
    that stay, joined by one space); a row for each row of docs.

    A word goes if a window that covers it also starts earlier: at a smaller
    doc_id, or earlier in the same document.  Windows are judged on the input.
    Null and empty texts have no words.  Rows of one doc_id count as the same
    place, so repeated rows get equal results and none hides the other; a null
    id comes before all others.  Other columns of docs are not looked at."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ask_and_answer(given, _ask(window, gram), _answer(window), _apply(window, gram, with_text), schema)
