"""Deleted interpolation against brute force: counts, shares and scores."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tablescout.llm import ngrams
from tablescout.llm.dealing import pack, unpack

from .test_operators import made, texts


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 7


def words(t):
    return (t or "").encode().lower().split()


def grams(ws, k):
    """Each token with up to k - 1 tokens before it; one None stands before the text and closes it."""
    line = [None, *ws, None]
    return [tuple(line[max(0, i - k + 1) : i + 1]) for i in range(1, len(line))]


class Brute:
    """Counts and recursion written out token by token."""

    def __init__(self, docs, folds, order):
        self.order, self.c = order, Counter()
        for i, t in docs:
            if fold(i) in folds:
                for k in range(1, order + 1):
                    for g in grams(words(t), k):
                        if len(g) == k or k == 1:
                            self.c[g] += 1
        self.unit = Counter({g[0]: n for g, n in self.c.items() if len(g) == 1})
        self.n, self.v = sum(self.unit.values()), len(self.unit)

    def context(self, g):
        return self.c[g[:-1]]

    def parts(self, shares, ws, i):
        """Probability by order, lowest first."""
        out, rest = [], 1.0
        for k in range(self.order, 0, -1):
            g = grams(ws, k)[i]
            if k == 1:
                context, estimate = None, self.unit[g[-1]] / max(self.n, 1)
            else:
                context = self.context(g)
                estimate = self.c[g] / max(context, 1)
            bucket = ngrams.BUCKETS - 1 if k == 1 else (0 if not context else 1 + int(math.log2(context)))
            share = shares[k - 1][bucket]
            out.append((rest * share * estimate, k - 1, bucket))
            rest *= 1 - share
        return [(rest / (self.v + 1), None, None), *reversed(out)]

    def learn(self, docs):
        shares = ngrams.first_shares(self.order)
        for _ in range(ngrams.ROUNDS):
            chosen, reached = np.zeros_like(shares), np.zeros_like(shares)
            for i, t in docs:
                if fold(i) == 3:
                    ws = words(t)
                    for at in range(len(ws) + 1):
                        parts = self.parts(shares, ws, at)
                        total = sum(p for p, _, _ in parts)
                        below = parts[0][0]
                        for p, k, bucket in parts[1:]:
                            below += p
                            chosen[k, bucket] += p / total
                            reached[k, bucket] += below / total
            new = ngrams.new_shares(shares, chosen, reached)
            moved, shares = abs(new - shares).max(), new
            if moved < ngrams.TOLERANCE:
                break
        return shares


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_brute_force(spark, order):
    docs = texts(n=70)
    some, whole = Brute(docs, {0, 1, 4, 5, 6}, order), Brute(docs, {0, 1, 3, 4, 5, 6}, order)
    shares = some.learn(docs)
    got = sorted(tuple(r) for r in ngrams.score_texts(made(spark, [d for d in docs if d[0] is not None]), order=order).collect())
    docs = [d for d in docs if d[0] is not None]
    some, whole = Brute(docs, {0, 1, 4, 5, 6}, order), Brute(docs, {0, 1, 3, 4, 5, 6}, order)
    shares = some.learn(docs)
    want = []
    for i, t in docs:
        ws = words(t)
        tokens = [*ws, None]
        base = sum(math.log10((whole.unit[w] + 1) / (whole.n + whole.v + 1)) for w in tokens)
        score = sum(math.log10(sum(p for p, _, _ in whole.parts(shares, ws, at))) for at in range(len(tokens)))
        want.append((i, fold(i) == 2, len(tokens), sum(whole.unit[w] > 0 for w in tokens), whole.n, base, score))
    want.sort()
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-6 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_words_are_told_apart_by_their_bytes(spark):
    """Two words that polynomial hashes modulo 2**64 can't tell apart (Thue-Morse)."""
    a = b = ""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    out = next(i for i in range(100) if fold(i) == 2)
    got = {r.doc_id: r for r in ngrams.score_texts(made(spark, [(out, a), (next(i for i in range(100) if fold(i) == 0), b)])).collect()}
    assert got[out].n_known == 1 and got[out].n_tokens == 2


@pytest.mark.parametrize("rows", [[(1, "a")], [(5, None), (6, None)], [(1, "a"), (2, "b"), (3, "c")], [(0, "x" * 300_000)], [(None, "a b a")]])
def test_tables_of_few_words(spark, rows):
    got = ngrams.score_texts(made(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(words(t)) + 1) for i, t in rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def test_more_buckets_than_words():
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(50)).encode()) for i in range(20)]
    for order in (2, 3):
        results = []
        for buckets in (1, 7, 120_000):
            asked = list(ngrams._ask(order)(docs, buckets))
            replies = {b: ngrams._answer(order)([unpack(pack(p))])[0] for b, p in asked}
            row = ngrams._apply(order)(docs, replies, buckets).to_pylist()[0]
            parcel = unpack(row["parcel"])
            results.append(([ngrams._unplaned(x).tolist() for x in parcel[3:]], {c: row[c] for c in ngrams.TOTALS}))
        assert results[0] == results[1] == results[2]


def test_hashes_are_numbered_by_sorting_values():
    """As np.unique does, but faster: hashes of a block are most of op4's work."""
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 1 << 64, 300_000, np.uint64, endpoint=False)
    near = (wide[:2000, None] & ~np.uint64(7)) + rng.integers(0, 8, (2000, 20)).astype(np.uint64)  # alike but for their last bits
    bucket = (np.uint64(5) << np.uint64(56)) + rng.integers(0, 1 << 40, 50_000).astype(np.uint64)
    ends = np.array([0, (1 << 64) - 1, 0, 1], np.uint64)
    for keys in (wide, wide >> np.uint64(17), near.ravel(), rng.permutation(np.repeat(bucket, 3)), ends, ends[:1], ends[:0]):
        before = keys.copy()
        got, back = ngrams.distinct(keys)
        want, places = np.unique(keys, return_inverse=True)
        assert np.array_equal(got, want) and np.array_equal(back, places) and np.array_equal(keys, before)

    block = rng.permutation(np.repeat(wide, 6)) >> np.uint64(17)

    def took(run):
        began = time.thread_time()
        run(block)
        return time.thread_time() - began

    assert min(took(ngrams.distinct) for _ in range(5)) < 0.8 * min(took(lambda x: np.unique(x, return_inverse=True)) for _ in range(5))


def test_words_of_a_block_stay_bytes():
    """What buckets are asked holds each word once, in its bucket."""
    docs = [(1, "b Ab ab \u00e9 b".encode()), (2, b""), (None, b"  x\tab ")]
    asked = dict(ngrams._ask(3)(docs, 4))
    words = {w: xxhash.xxh64_intdigest(w) for w in [b"b", b"ab", "\u00e9".encode(), b"", b"x"]}
    for b in range(4):
        mine = {w for w, h in words.items() if ngrams.dealt_to(np.array([h], np.uint64), 4)[0] == b}
        got = asked[b][0][0].split(b" ")[:-1] if b in asked else []
        assert len(got) == len(mine) and set(got) == mine
    for x in (np.array([], np.uint32), np.array([0, 255, 256, 2**32 - 1], np.uint32), np.array([3, 2**63], np.uint64), np.array([1 << 40, 0], np.int64)):
        kind, n, data = ngrams._planes(x)
        assert data == x.view(np.uint8).reshape(n, -1 if n else x.itemsize).T.tobytes()
        assert np.array_equal(ngrams._unplaned((kind, n, data)), x)
