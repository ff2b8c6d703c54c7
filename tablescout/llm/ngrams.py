"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | u, v) mixes 1 / (V + 1), c(w) / N, c(v, w) / c(v) and so on up to ORDER:
from the longest context down, a share goes to each order, by how often its
context was seen (a bucket for each power of two).  The shares are learned by
expectation-maximisation: counts from one part of the training texts predict the
tokens of the rest, which those counts don't hold.  Scores then use the counts
of all training texts.  All counts cover the whole corpus; they are summed in
buckets of n-grams and answered to each block.  Words are told apart by their
bytes; longer n-grams by hashes of their words' XXH64, as wide as the corpus
asks for: one of its n-grams meets another's hash once in 2**SPARE times."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import plan_bytes, stored
from tablescout.llm.dealing import BASE, Doc, ask_and_answer, mix, pack, unpack

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Longest n-grams that are counted.
ORDER = 3
#: Bits of an n-gram's hash beyond those that number the corpus's bytes as stored; at least LEAST_BITS, at most 64.
SPARE, LEAST_BITS = 18, 40
#: Tokens that are scored at once.
STEP = 1 << 18
#: Rounds of expectation-maximisation at most; they end when no share moves by TOLERANCE.
ROUNDS, TOLERANCE = 30, 1e-3
#: Context-frequency buckets: 0 for contexts never seen, then powers of two.
BUCKETS = 64
#: Tokens and distinct tokens of all training texts, and of those that don't tune.
TOTALS = ["n_whole", "v_whole", "n_some", "v_some"]


def fold(doc_id: int | None, folds: int = FOLDS) -> int:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def closed(data: bytes) -> pa.Array:
    """The tokens of a string in which each is closed by a space, the space included."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _laid(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all words, one after another, and where each begins; and the end."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return data.to_pybytes() if data else b"", offsets


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique of 64-bit hashes, with the inverse.  What is sorted are the
    upper bits of each with its place below them: values, which sort several times
    as fast as places.  If keys differ in lower bits alone, a second pass over
    the nearly sorted keys puts them right."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    least, places = keys.min(), np.uint64((len(keys) - 1).bit_length())
    dropped = np.uint64(max(0, int(keys.max() - least).bit_length() + int(places) - 64))
    packed = keys - least
    packed >>= dropped
    packed <<= places
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << int(places)) - 1)).astype(np.int64)
    keys = keys[order]
    if dropped and (keys[1:] < keys[:-1]).any():
        again = np.argsort(keys, kind="stable")
        order, keys = order[again], keys[again]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


def tokens(docs: list[Doc]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all documents, each text's closed by an empty one, its end; and their numbers."""
    texts = [b" ".join(t.lower().split()) for _, t in docs]
    n = np.array([t.count(b" ") + 2 if t else 1 for t in texts], np.int64)
    return closed(b"".join([t + b"  " if t else b" " for t in texts])), n


def dealt_to(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; ascends with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Block:
    """Distinct n-grams of each order, sorted by bucket: `back` (of each token),
    `counts` (in texts that train and don't tune; in those that tune), `bucket`;
    `words` and `offsets` are those of order one (`_laid`), `keys` the hashes of the others."""

    def __init__(self, docs: list[Doc], buckets: int, order: int, bits: int = 64):
        self.docs = docs
        given, self.n = tokens(docs)
        self.folds = np.array([fold(d) for d, _ in docs], np.int64)
        kind = np.where(self.folds == TUNING, 1, np.where(self.folds == HELD_OUT, 2, 0)).astype(np.uint8)
        kind = np.repeat(kind, self.n)
        self.known = (int((kind < 2).sum()), int((kind == 0).sum()))
        self.back, self.counts, self.bucket, self.keys = [], [], [], [None]
        encoded = given.dictionary_encode()
        words, back = encoded.dictionary, encoded.indices.to_numpy()
        words, back = self._sorted(words, back)
        data, offsets = _laid(words)
        hashes = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)), np.uint64, len(words))
        bucket = dealt_to(hashes, buckets)
        dealt = np.argsort(bucket, kind="stable")
        self.words, self.offsets = _laid(words.take(pa.array(dealt)))
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        self._count(place[back], bucket[dealt], kind)
        word = hashes[back]
        end = np.uint64(xxhash.xxh64_intdigest(b""))
        first = np.cumsum(self.n) - self.n
        before = word
        for k in range(2, order + 1):
            key = np.empty_like(word)
            key[:1], key[1:] = end, before[:-1]
            key *= np.uint64(BASE)
            key += word
            for lo in range(0, len(key), STEP):
                key[lo : lo + STEP] = mix(key[lo : lo + STEP])
            if k > 2:
                key[first] = before[first]  # a first word has no longer context than the start
            keys, back = distinct(key >> np.uint64(64 - bits))
            self.keys.append(keys)
            self._count(back, dealt_to(keys << np.uint64(64 - bits), buckets), kind)
            before = key

    @staticmethod
    def _sorted(words: pa.Array, back: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """In byte order: neighbours share beginnings, which compress."""
        order = pc.sort_indices(words).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return words.take(pa.array(order)), place[back]

    def _count(self, back: np.ndarray, bucket: np.ndarray, kind: np.ndarray) -> None:
        self.back.append(back.astype(np.uint32))
        self.bucket.append(bucket)
        self.counts.append([np.bincount(back[kind == k], minlength=len(bucket)).astype(np.uint32) for k in (0, 1)])

    def slices(self) -> Iterator[tuple[int, list[slice]]]:
        """Each bucket that has an n-gram of the block, and where those of each order lie."""
        present = np.unique(np.concatenate(self.bucket))
        cuts = [(np.searchsorted(b, present).tolist(), np.searchsorted(b, present, side="right").tolist()) for b in self.bucket]
        for i, b in enumerate(present.tolist()):
            yield b, [slice(lo[i], hi[i]) for lo, hi in cuts]


def _planes(x: np.ndarray) -> tuple[str, int, bytes]:
    """Bytes of equal weight side by side, which compress well; most values are small.
    x holds whole numbers, none below zero."""
    most = int(x.max()) if len(x) else 0
    planes = [(x >> x.dtype.type(8 * i)).astype(np.uint8).tobytes() if most >> 8 * i else bytes(len(x)) for i in range(x.dtype.itemsize)]
    return x.dtype.str, len(x), b"".join(planes)


def _unplaned(p: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, data = p
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)


def _ask(order: int, bits: int = 64):
    def ask(docs: list[Doc], buckets: int) -> Iterator[tuple[int, Any]]:
        """Only buckets of which the block has an n-gram are asked."""
        if not docs:
            return
        block = _Block(docs, buckets, order, bits)
        for b, at in block.slices():
            parcel = []
            for k in range(order):
                counts = [_planes(c[at[k]]) for c in block.counts[k]]
                if k:
                    keys = block.keys[k][at[k]]  # ascend: steps have fewer bytes
                    parcel.append((_planes(np.diff(keys, prepend=np.uint64(0))), *counts))
                else:
                    parcel.append((block.words[block.offsets[at[0].start] : block.offsets[at[0].stop]], *counts))
            yield b, parcel

    return ask


def _answer(order: int):
    def answer(parcels: list[Any]) -> list[Any]:
        """For each parcel the counts of its n-grams, and how many of the known words it is the first to ask."""
        replies = [[] for _ in parcels]
        for k in range(order):
            if k:
                keys = np.concatenate([np.cumsum(_unplaned(p[k][0])) for p in parcels])
                found, back = distinct(keys)
            else:
                back = closed(b"".join([p[0][0] for p in parcels])).dictionary_encode().indices.to_numpy()
                first = found = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1)) if len(back) else back
            some, rest = (np.bincount(back, np.concatenate([_unplaned(p[k][c]) for p in parcels]), len(found)).astype(np.int64) for c in (1, 2))
            stops = np.cumsum([p[k][1][1] for p in parcels])
            if k == 0:
                owner = np.searchsorted(stops, first, side="right")
                for r, *new in zip(replies, *(np.bincount(owner[x > 0], minlength=len(parcels)).tolist() for x in (some + rest, some)), strict=True):
                    r.append(new)
            for r, p, mine in zip(replies, parcels, np.split(back, stops[:-1]), strict=True):
                # without what the asker counts itself: zeros for most
                r.append(tuple(_planes(_narrow(x[mine] - _unplaned(p[k][c]))) for c, x in ((1, some), (2, rest))))
        return replies

    return answer


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def _apply(order: int, bits: int = 64):
    def apply(docs: list[Doc], replies: dict[int, Any], buckets: int) -> pa.Table:
        """One row a block: what scoring needs of each token, what tuning needs, and what the block adds to the corpus's totals."""
        if not docs:
            return pa.table({"parcel": pa.array([], pa.binary()), "tuning": pa.array([], pa.binary())} | {c: pa.array([], pa.int64()) for c in TOTALS})
        block = _Block(docs, buckets, order, bits)
        words = np.sum([r[0] for r in replies.values()], axis=0).tolist()
        found = [[c[kind].astype(np.int64) for c in block.counts] for kind in range(2)]
        for b, at in block.slices():
            for k in range(order):
                for kind in range(2):
                    found[kind][k][at[k]] += _unplaned(replies[b][1 + k][kind])
        for some, rest in zip(*found, strict=True):
            np.add(some, rest, out=rest)  # the whole
        some, whole = ([_narrow(x)[back] for x, back in zip(f, block.back, strict=True)] for f in found)
        tuning = np.repeat(block.folds == TUNING, block.n)
        end = int(some[0][block.n[0] - 1])
        ids = [d for d, _ in docs]
        parcel = (ids, block.folds, block.n, *(_planes(x) for x in whole))
        totals = (block.known[0], words[0], block.known[1], words[1])
        blobs = {"parcel": pa.array([pack(parcel, 3)], pa.binary()), "tuning": pa.array([pack([[_planes(_narrow(x)) for x in columns] for columns in _alike([x[tuning] for x in some], block.n[block.folds == TUNING], end)], 3)], pa.binary())}
        return pa.table(blobs | {c: pa.array([x], pa.int64()) for c, x in zip(TOTALS, totals, strict=True)})

    return apply


def _contexts(counts: list[np.ndarray], n: np.ndarray, end: int) -> list[np.ndarray]:
    """For each order from two on, how often each token's context was counted; a first word's is the end of a text."""
    first = np.cumsum(n) - n
    out = []
    for c in counts[:-1]:
        context = np.concatenate((c[:1], c[:-1])).astype(np.int64)
        context[first] = end
        out.append(context)
    return out


def _alike(counts: list[np.ndarray], n: np.ndarray, end: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Counts and contexts of tokens that tune, each kind of token once, and how
    many there are of each.  Of an n-gram never counted only its context's bucket matters."""
    contexts = _contexts(counts, n, end)
    for k, c in enumerate(contexts):
        contexts[k] = np.where((counts[k + 1] > 0) | (c == 0), c, 1 << np.maximum(bucket_of(c) - 1, 0))
    columns = [*counts, *contexts]
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if len(order) else order
    columns = [c[first] for c in columns]
    return columns[: len(counts)], columns[len(counts) :], [np.diff(first, append=len(order))]


# ------------------------------------------------------------ model


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def components(shares: np.ndarray, counts: list[np.ndarray], contexts: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(orders + 1, tokens): each order's part of each token's probability, the
    uniform one first; and the buckets of the orders' contexts."""
    size = len(counts[0])
    buckets = [np.full(size, BUCKETS - 1), *(bucket_of(c) for c in contexts)]
    out, rest = np.empty((len(counts) + 1, size)), np.ones(size)
    for k in range(len(counts), 0, -1):
        estimate = counts[k - 1] / (np.maximum(contexts[k - 2], 1) if k > 1 else max(n, 1))
        share = shares[k - 1][buckets[k - 1]]
        out[k] = rest * share * estimate
        rest = rest * (1 - share)
    out[0] = rest / (v + 1)
    return out, buckets


def first_shares(order: int) -> np.ndarray:
    shares = np.full((order, BUCKETS), 0.5)
    shares[0] = 0.9
    shares[1:, 0] = 0  # a context that was never seen predicts nothing
    return shares


def new_shares(shares: np.ndarray, chosen: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """(orders, BUCKETS) from expected choices.  An order is never sure, so every
    probability stays above zero.  A bucket that tuning never met takes the next
    lower one's share."""
    out = np.where(reached > 0, np.clip((chosen + 1e-4) / (reached + 2e-4), 1e-4, 1 - 1e-4), shares)
    out[1:, 0] = 0
    for k in range(1, len(out)):
        for b in range(2, BUCKETS):
            if reached[k, b] <= 0 and reached[k, 1:b].any():
                out[k, b] = out[k, b - 1]
    return out


def expected(shares: np.ndarray, counts: list[np.ndarray], contexts: list[np.ndarray], n: int, v: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens that chose each order, and that came down to it, by bucket; times: how many tokens each one stands for."""
    chosen, reached = np.zeros_like(shares), np.zeros_like(shares)
    for lo in range(0, len(counts[0]), STEP):
        at = slice(lo, lo + STEP)
        parts, buckets = components(shares, [c[at] for c in counts], [c[at] for c in contexts], n, v)
        parts *= (1 if times is None else times[at]) / parts.sum(axis=0)
        below = np.cumsum(parts, axis=0)
        for k in range(len(shares)):
            chosen[k] += np.bincount(buckets[k], parts[k + 1], BUCKETS)
            reached[k] += np.bincount(buckets[k], below[k + 1], BUCKETS)
    return chosen, reached


def learn_shares(table: DataFrame, order: int, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation over all tuning tokens: each round sums the
    expected choices of every block, a row for each order and bucket.  A round
    has a task for each core, not for each block: starting one costs more than
    a block's kinds of tokens."""
    shares = first_shares(order)
    blocks = table.select("tuning").coalesce(max(1, table.sparkSession.sparkContext.defaultParallelism))

    def step(shares: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen, reached = np.zeros_like(shares), np.zeros_like(shares)
            for b in batches:
                for blob in b.column(0):
                    counts, contexts, (times,) = ([_unplaned(x) for x in columns] for columns in unpack(blob.as_py()))
                    a, r = expected(shares, counts, contexts, n, v, times)
                    chosen, reached = chosen + a, reached + r
            k, bucket = np.nonzero(reached)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(chosen[k, bucket]), pa.array(reached[k, bucket])], ["k", "bucket", "chosen", "reached"])

        return run

    for _ in range(rounds):
        rows = blocks.mapInArrow(step(shares), "k long, bucket long, chosen double, reached double").groupBy("k", "bucket").agg(F.sum("chosen").alias("chosen"), F.sum("reached").alias("reached")).collect()
        chosen, reached = np.zeros_like(shares), np.zeros_like(shares)
        for r in rows:  # at most ORDER * BUCKETS
            chosen[r.k, r.bucket], reached[r.k, r.bucket] = r.chosen, r.reached
        new = new_shares(shares, chosen, reached)
        moved, shares = float(np.abs(new - shares).max()), new
        if moved < TOLERANCE:
            break
    return shares


def _scored(shares: np.ndarray, total: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                ids, folds, n, *counts = unpack(blob.as_py())
                counts = [_unplaned(c) for c in counts]
                contexts, word = _contexts(counts, n, int(counts[0][n[0] - 1])), counts[0]
                ends = np.cumsum(n)
                known, base, score = np.empty(len(n), np.int64), np.empty(len(n)), np.empty(len(n))
                lo = 0
                while lo < len(n):  # some texts at a time
                    begin = int(ends[lo] - n[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, begin + STEP, side="right")))
                    at = slice(begin, ends[hi - 1])
                    prob = components(shares, [c[at] for c in counts], [c[at] for c in contexts], total, v)[0].sum(axis=0)
                    w = word[at].astype(np.float64)
                    first = ends[lo:hi] - n[lo:hi] - begin
                    known[lo:hi] = np.add.reduceat((w > 0).astype(np.int64), first)
                    base[lo:hi] = np.add.reduceat(np.log10((w + 1) / (total + v + 1)), first)
                    score[lo:hi] = np.add.reduceat(np.log10(np.maximum(prob, 1e-300)), first)
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(folds == HELD_OUT), pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a
    row for each row of docs.

    Words are runs without ASCII spaces, A-Z lower-cased, and each text has one
    end token.  Rows whose crc32(doc_id) modulo 7 is 2 are held out, the rest
    train; of those, remainder 3 tunes the weights.  score is the model's log10
    probability of the whole text.  Null and empty texts are their end token.
    Null ids train.  Repeated rows count each time.  With nothing to train on,
    the model is uniform.  Other columns of docs are not looked at."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(["parcel binary", "tuning binary", *(f"{c} long" for c in TOTALS)])
    bits = min(64, max(LEAST_BITS, SPARE + plan_bytes(given).bit_length()))
    table = stored(ask_and_answer(given, _ask(order, bits), _answer(order), _apply(order, bits), schema, each_mb=3), "ngrams")
    n, v, n_some, v_some = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in TOTALS]).first()
    shares = learn_shares(table, order, n_some, v_some)
    return table.select("parcel").mapInArrow(_scored(shares, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
