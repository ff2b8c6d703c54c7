"""The subsequence kernel, its Nystroem map and the machine against brute force."""

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tablescout.llm import toxicity as tox

from .test_operators import made

UNITS = ["nitwit", "nitxwit", "a", "scoundrel", "scxoundrel", "lamp", "aaaaaaa", "дурак", "болван", "дуррак", "馬鹿", "straße", "ñandú", "z" * 24]


def letter(c):
    k = ord(c) - 96
    return k if 1 <= k <= 26 else 27 + k % (tox.LETTERS - 27)


def features(unit):
    """Weights of all subsequences of three letters within SPAN, one by one."""
    x, out = [0, *map(letter, unit), 0], Counter()
    for i, j, k in combinations(range(len(x)), 3):
        if k - i < tox.SPAN:
            out[x[i], x[j], x[k]] += tox.DECAY ** (k - i - 2)
    return out


def brute_kernel(a, b):
    f, g = features(a), features(b)
    norm = lambda h: sum(v * v for v in h.values()) ** 0.5
    return sum(v * g[s] for s, v in f.items()) / (norm(f) * norm(g))


def test_kernel_against_brute_force():
    got = tox.kernel(UNITS, UNITS)
    want = np.array([[brute_kernel(a, b) for b in UNITS] for a in UNITS])
    assert np.abs(got - want).max() < 1e-5
    assert got[0, 1] > 0.5 > got[0, 5] and got[7, 9] > 0.5 > got[7, 8]  # inserted letters stay close, in any script


def all_sorted_together(units):
    """Subsequences of all units laid out in one list and sorted as a whole."""
    x = tox.codes(units)
    rows, subs, weights = [], [], []
    for j, k in tox._OFFSETS:
        a, b, c = x[:, : x.shape[1] - k], x[:, j : x.shape[1] - k + j], x[:, k:]
        r, p = np.nonzero(c >= 0)
        rows.append(r)
        subs.append((a[r, p] * tox.LETTERS + b[r, p]) * tox.LETTERS + c[r, p])
        weights.append(np.full(len(r), tox.DECAY ** (k - 2)))
    whole, back = np.unique(np.concatenate(rows) * tox.LETTERS**3 + np.concatenate(subs), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(whole))
    row, sub = whole // tox.LETTERS**3, whole % tox.LETTERS**3
    return row, sub, weight / np.sqrt(np.bincount(row, weight**2, len(units)))[row]


def test_units_are_sorted_one_by_one():
    """Words of a corpus are mostly seen once, so their subsequences are most of the work of scoring."""
    r = random.Random(3)
    units = ["", "a", "", *("".join(r.choice("abcdeаб馬ß+") for _ in range(r.randint(0, tox.UNIT))) for _ in range(tox.TOGETHER)), "a" * tox.UNIT]
    for some in (units, units[:1], units[:3], []):
        assert all(np.array_equal(x, y) for x, y in zip(tox.subsequences(some), all_sorted_together(some), strict=True))

    def took(run):
        began = time.thread_time()
        run(units)
        return time.thread_time() - began

    assert min(took(tox.subsequences) for _ in range(5)) < 0.8 * min(took(all_sorted_together) for _ in range(5))


def test_words_are_folded_once(monkeypatch):
    """Single letters that make no run are not looked at again; those of a run are, and words without letters don't part it."""
    folded, fold = [], tox.fold
    monkeypatch.setattr(tox, "fold", lambda w: folded.append(w) or fold(w))
    scorer = tox.Scorer(tox.Model(np.random.default_rng(0).normal(size=tox.LETTERS**3), -1.0, 1.0, 0.0, []))
    texts = ["lamp a river b stone c lamp d", "-", "n i - t", None, ""]
    alone = [max(scorer.model.margins(["lamp", "river", "stone"])), -1.0, scorer.model.margins(["nit"])[0], -1.0, -1.0]
    assert np.array_equal(scorer.worst(texts), alone)
    assert Counter(folded) == Counter({w for t in texts for w in (t or "").split()}) + Counter("nit")


def test_landmarks_give_the_kernel_back():
    """Of landmarks themselves the map is exact, and margins are the machine's in that space."""
    k = tox.kernel(UNITS, UNITS)
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6
    mapped = k @ (vectors[:, good] / np.sqrt(values[good]))
    assert np.abs(mapped @ mapped.T - k).max() < 1e-4
    texts = [f"lamp river stone {'nitwit' if i % 4 == 0 else 'paper'} w{'abcdefgh'[i % 8]}ord" for i in range(80)]
    model = tox.train(texts, [int(i % 4 == 0) for i in range(80)])
    r, s, w = tox.subsequences(UNITS)
    assert np.allclose(model.margins(UNITS), np.bincount(r, model.weights[s] * w, len(UNITS)) + model.bias)
    by_kernel = [sum(v * model.weights[(a * tox.LETTERS + b) * tox.LETTERS + c] for (a, b, c), v in features(u).items()) / sum(v * v for v in features(u).values()) ** 0.5 + model.bias for u in UNITS]
    assert np.allclose(model.margins(UNITS), by_kernel)


def test_machine_minimises_its_loss():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(300, 6)), np.ones((300, 1))])
    sign = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) * 0.3 > 0, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, 300)
    v = tox.svm(x, sign, weight)

    def loss(v):
        return (weight * np.maximum(0, 1 - sign * (x @ v)) ** 2).sum() + 0.01 * v @ v

    for _ in range(50):
        assert loss(v) <= loss(v + rng.normal(size=7) * 10.0 ** -rng.integers(1, 4)) + 1e-9
    step = 1e-5 * np.eye(7)
    assert max(abs(loss(v + d) - loss(v - d)) / 2e-5 for d in step) < 1e-2


@pytest.mark.parametrize("letters", ["abcdefghij", "абвгдежзик", "אבגדהוזחטי"])
def test_any_script_is_learned(spark, letters):
    r = random.Random(6)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(4, 8)))
    clean, insults = [word() for _ in range(40)], [letters[:7], letters[:2:-1]]
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [r.choice(clean) for _ in range(20)] + ([r.choice(insults)] if bad else [])
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    got = tox.toxicity(made(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)


def test_sample_is_bounded(spark, monkeypatch):
    docs = [(i % 10, f"word{i} lamp") for i in range(60)] + [(3, "same")] * 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (4, 1), (5, 7)], "doc_id long, toxic int")
    import pyspark.sql.functions as F

    bags, y, _ = tox.sampled(made(spark, docs), labels, lambda i: F.lit(True), sample=4)
    assert Counter(y)[0] <= 4 and Counter(y)[1] <= 4 and len(bags) == len(y) > 2
    monkeypatch.setattr(tox, "SAMPLE_BYTES", 15)
    bags, y, _ = tox.sampled(made(spark, docs), labels, lambda i: F.lit(True), sample=4)
    assert all(sum(len(b.rstrip()) for b, v in zip(bags, y) if v == k) <= 15 for k in (0, 1))


def test_pairs_of_harmless_words(spark):
    """Neither word is toxic alone; next to each other in a sentence they are, inserted letters or not."""
    r = random.Random(2)
    clean = ["river", "lamp", "stone", "green", "window", "music", "letter", "garden", "silver", "walnut", "brain"]
    docs, labels = [], []
    for i in range(800):
        words = [r.choice(clean) for _ in range(40)]
        words = [w for k, w in enumerate(words) if not (k and words[k - 1] == "walnut" and w == "brain")]
        text = " ".join(words).replace("walnut brain", "walnut. brain")
        if i % 5 == 0:
            at = r.randint(0, 20)
            text = " ".join([*text.split()[:at], "walnut brain", *text.split()[at:]])
        docs.append((i, text))
        labels.append((i, int(i % 5 == 0)))
    docs += [(5000, "river walnxut brain lamp"), (5001, "river walnut. brain lamp"), (5002, "walnut river brain")]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert tox.fit(made(spark, docs), frame).pairs == ["walnut+brain"]
    got = {x.doc_id: x for x in tox.toxicity(made(spark, docs), frame).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 5000]
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in (5000, 5001, 5002)] == [1, 0, 0]
