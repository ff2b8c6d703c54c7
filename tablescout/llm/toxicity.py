"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two units sums, over all subsequences of three characters that
they share, the decayed weights with which each holds them: gaps cost, but do
not forbid, so inserted characters and spaced-out insults stay close to the
plain ones.  Units are words (with joined runs of single letters; accents, case
and look-alike digits folded); letters beyond a-z share a table of codes by
their number.  Pairs of neighbouring words of a sentence are units too, where labelled
texts blame the pair and neither word; then every pair of words like theirs is
scored.  A text is as toxic as its worst unit.  Labels are of texts, so
which unit of a toxic text is to blame is learned too: first the units most
associated with the label, then the unit of highest margin.  Nystroem landmarks
stand for the kernel's feature space; the machine is linear there, trained by
Newton steps."""

from __future__ import annotations

import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import returning, stored

DECAY = 0.6
#: Characters that a subsequence may span.
SPAN = 6
#: Characters of a unit that are looked at together; longer ones in overlapping windows.
UNIT = 24
LANDMARKS = 192
#: At most so many labelled texts of each class are learned from, chosen by a
#: hash of the id, as long as their distinct units take up to SAMPLE_BYTES a class.
SAMPLE, SAMPLE_BYTES = 4000, 48 << 20
#: Of the units of those texts: how many of the most blamed landmarks are chosen
#: from; how many units of other texts are negatives: drawn by a fixed seed, most
#: frequent, and of the highest margins, added in each round.
POOL, DRAWN, COMMON, HARD = 12 * LANDMARKS, 40 * LANDMARKS, 10 * LANDMARKS, 20 * LANDMARKS
THRESHOLD = 0.3
#: Units whose subsequences are laid out as a table together, when kernels are computed.
TABLE = 64
#: Units whose margins are computed together.
TOGETHER = 4000
#: Words that training remembers as folded.
FOLDED = 50_000
#: Units whose subsequences are kept from one round of training to the next.
LAID = 10 * TOGETHER
#: Words that are remembered by a worker; then those in use stay.
REMEMBERED = 200_000
#: Words of texts that are looked up together.
STEP = 200_000
#: Look-alikes.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-–—_*~|/\\"
LETTERS = 48  # 0: edge of the unit, 1..26: letters, 27..47: others, by their number
#: Between the words of a pair; counts as an edge.
BETWEEN = "+"
#: Pairs at most that labelled texts may blame, most blamed first; how like a word of one a word must be.
PAIRS, ALIKE = 50, 0.5
SINGLE = -9e9  # margin that stands for a unit of one letter
NOTHING = -np.inf  # margin that stands for a word without letters


def fold(word: str) -> str:
    """Letters of a word: lower case, without accents, look-alikes as letters, marks dropped."""
    word = word.strip(_EDGE)
    if not word.isascii():
        word = "".join(filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", word)))
    word = word.lower()
    if not word.isalpha():
        if any(map(str.isalpha, word)):
            word = word.translate(LOOK_ALIKE)
        word = "".join(filter(str.isalpha, word))
    return word


def windows(unit: str) -> list[str]:
    return [unit] if len(unit) <= UNIT else [unit[i : i + UNIT] for i in range(0, len(unit) - UNIT // 2, UNIT // 2)]


def codes(units: list[str]) -> np.ndarray:
    """(units, UNIT + 2) letters; -1 after the closing edge."""
    out = np.full((len(units), UNIT + 2), -1, np.int32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64) - 96
    flat = np.where((flat >= 1) & (flat <= 26), flat, np.where(flat == ord(BETWEEN) - 96, 0, 27 + flat % (LETTERS - 27)))
    row = np.repeat(np.arange(len(units)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = flat
    out[:, 0] = 0
    out[np.arange(len(units)), size + 1] = 0
    return out


_OFFSETS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]
_NUMBER = 4  # bits that number the offsets
_DECAYS = np.array([DECAY ** (k - 2) for _, k in _OFFSETS])


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight), each subsequence of a unit once, scaled so
    that a unit's kernel with itself is 1.  Rows of units without any are absent.
    Units of one length are laid out together and each sorted by itself, equal
    subsequences by their offsets."""
    x, size = codes(units), np.fromiter(map(len, units), np.int64, len(units)) + 2
    number = np.maximum(size[:, None] - [k for _, k in _OFFSETS], 0).sum(axis=1)
    start = np.cumsum(number) - number
    flat = np.empty(int(number.sum()), np.int32)
    for n in np.flatnonzero(np.bincount(size)).tolist():
        at = np.flatnonzero(size == n)
        y = x[at]
        each = [((y[:, : n - k] * LETTERS + y[:, j : n - k + j]) * LETTERS + y[:, k:n] << _NUMBER) + i for i, (j, k) in enumerate(_OFFSETS) if k < n]
        if each:
            each = np.concatenate(each, axis=1)
            each.sort(axis=1)
            flat[start[at][:, None] + np.arange(each.shape[1])] = each
    row, sub = np.repeat(np.arange(len(units)), number), flat >> _NUMBER
    new = np.ones(len(flat), bool)
    new[1:] = (sub[1:] != sub[:-1]) | (row[1:] != row[:-1])
    weight = np.bincount(np.cumsum(new) - 1, _DECAYS[flat & (1 << _NUMBER) - 1], int(new.sum()))
    row, sub = row[new], sub[new].astype(np.int64)
    norm = np.sqrt(np.bincount(row, weight**2, len(units)))
    return row, sub, weight / norm[row]


def kernel(units: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of all with all (for landmarks, of bounded number)."""
    out = np.zeros((len(units), len(others)))
    for at in range(0, len(others), TABLE):
        some = others[at : at + TABLE]
        table = np.zeros((len(some), LETTERS**3), np.float32)
        r, s, w = subsequences(some)
        table[r, s] = w
        for lo in range(0, len(units), 64):
            r, s, w = subsequences(units[lo : lo + 64])
            if len(r):
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                out[lo + r[first], at : at + len(some)] = np.add.reduceat(table[:, s].T * w[:, None], first, axis=0)
    return out


def with_inserted(unit: str, rng: np.random.Generator) -> str:
    """The unit with one more letter somewhere inside."""
    at = int(rng.integers(1, len(unit)))
    return unit[:at] + chr(97 + int(rng.integers(26))) + unit[at:]


def units_of(text: str | None, known: dict[str, str] | None = None) -> list[str]:
    """Folded words and joined runs of three or more single letters; without
    single letters.  known: words that are folded already, to which others are
    added up to FOLDED."""
    out, run = [], []
    known = {} if known is None else known
    for w in [*(text or "").split(), ""]:
        u = known.get(w)
        if u is None:
            u = fold(w)
            if len(known) < FOLDED:
                known[w] = u
        if len(u) == 1:
            run.append(u)
            continue
        if u or not w:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
        if u:
            out.append(u)
    return [p for u in out for p in (windows(u) if len(u) > UNIT else (u,))]


def pairs_of(text: str | None) -> list[str]:
    """Neighbouring folded words of a sentence, both of two letters or more,
    each followed by BETWEEN and the word that stands before them, if any."""
    out, before, earlier = [], "", ""
    for w in (text or "").split():
        u = fold(w)
        if len(u) > 1 and before:
            out.append(before + BETWEEN + u + BETWEEN + earlier)
        if u:
            earlier, before = before, u if len(u) > 1 else ""
        if w[-1] in ".!?":
            earlier = before = ""
    return out


@dataclass
class Model:
    """margin(unit) = weights[subsequences] . kernel weights + bias; score by a logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: list[str]
    pairs: list[str] = field(default_factory=list)

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), self.bias)
        for lo in range(0, len(units), TOGETHER):
            part = units[lo : lo + TOGETHER]
            out[lo : lo + len(part)] = self.margins_of(*subsequences(part), len(part))
        return out

    def margins_of(self, row: np.ndarray, sub: np.ndarray, weight: np.ndarray, units: int) -> np.ndarray:
        return self.bias + np.bincount(row, self.weights[sub] * weight, units)

    def scores(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -50, 50)))


def svm(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, decay: float = 0.01, most: int = 50) -> np.ndarray:
    """Linear machine of squared hinge loss, by Newton steps over the rows inside the margin."""
    v = np.zeros(x.shape[1])
    for _ in range(most):
        inside = sign * (x @ v) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + decay * np.eye(len(v)), a.T @ sign[inside])
        if np.abs(new - v).max() < 1e-9:
            break
        v = v + 0.7 * (new - v) if _ > 10 else new
    return v


def counted(bags: list[list[str]], labels: list[int]) -> tuple[Counter, Counter, int, int]:
    """Texts that hold each unit, toxic and others; and their numbers."""
    toxic, clean = Counter(), Counter()
    for bag, label in zip(bags, labels, strict=True):
        (toxic if label else clean).update(bag)
    return toxic, clean, sum(labels), len(labels) - sum(labels)


def evidence(c1: int, c0: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a unit's texts for being toxic more often than others."""
    e1, e0 = (c1 + c0) * n1 / (n1 + n0), (c1 + c0) * n0 / (n1 + n0)
    return (c1 * np.log(c1 / e1) + (c0 * np.log(c0 / e0) if c0 else 0.0)) if c1 > e1 else 0.0


def certain(units: int) -> float:
    """So much evidence that chance gives to hardly any of so many units."""
    return float(np.log(units + 1) + 4)


def train(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 7, pairs: tuple[str, ...] = ()) -> Model:
    """Learns from labelled texts, and the pairs that they blame; if there are
    any, texts hold theirs as words.  Without toxic or without other texts,
    every score is the share of toxic ones."""
    y = np.array(labels)
    same: dict[str, str] = {}  # equal units of different texts are held once
    known = set(pairs)
    bags = []
    folded: dict[str, str] = {}
    for t in texts:
        words = (t or "").split()
        mine = {p for w in words if w in known for p in windows(w)}
        bags.append([same.setdefault(u, u) for u in sorted({*units_of(" ".join([w for w in words if w not in known]) if known else t, folded), *mine})])
    del folded
    share = float(np.clip(y.mean() if len(y) else 0, 1e-3, 1 - 1e-3))
    flat = Model(np.zeros(LETTERS**3), -1.0, 0.0, float(np.log(share / (1 - share))), [])
    if not len(y) or y.min() == y.max():
        return flat
    toxic, clean, n1, n0 = counted(bags, labels)
    blame = {u: evidence(toxic[u], clean[u], n1, n0) for u in toxic}
    sure = certain(len(toxic) + len(clean))
    ranked = sorted(blame, key=lambda u: (-blame[u], u))
    # landmarks: the most blamed units that are unlike each other, then frequent clean ones
    chosen: list[str] = []
    pool = ranked[:POOL]
    if not pool:
        return flat
    like = kernel(pool, pool)
    open_ = np.ones(len(pool), bool)
    for i in range(len(pool)):
        if open_[i] and len(chosen) < landmarks // 2:
            chosen.append(pool[i])
            open_ &= like[i] < 0.8
    chosen += [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(u) > 2 and u not in set(chosen)][: landmarks - len(chosen)]
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # Nystroem map: kernel with landmarks times root
    landmark, held, weight_of = subsequences(chosen)
    rng = np.random.default_rng(seed)
    clean_units = sorted(clean)
    some = [clean_units[i] for i in rng.permutation(len(clean_units))[:DRAWN]]
    negatives = some + [u for u, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]

    def witnesses(margin) -> list[str]:
        out: list[str] = []
        for bag, label in zip(bags, labels, strict=True):
            if label and bag:
                out += [u for u in bag if blame[u] > sure and clean[u] * n1 * 20 < toxic[u] * n0] or [max(bag, key=lambda u: (margin(u), u))]
        return out

    every = sorted(set(toxic) | set(clean))
    place = {u: k for k, u in enumerate(every)}
    harmless = np.array([k for k, u in enumerate(every) if u in clean], np.int64)
    laid: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of as many units as fit, laid out once

    def found(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k in laid:
            return laid[k]
        r, s, w = subsequences(every[k : k + TOGETHER])
        if k < LAID:
            laid[k] = r.astype(np.int32), s.astype(np.int32), w
        return r, s, w

    mapped: dict[str, np.ndarray] = {}  # what the rounds share is mapped once

    def features(units: list[str]) -> np.ndarray:
        new = sorted({u for u in units if u not in mapped})
        mapped.update(zip(new, np.hstack([kernel(new, chosen) @ root, np.ones((len(new), 1))]), strict=True))
        return np.array([mapped[u] for u in units])

    witness = witnesses(blame.__getitem__)
    model = flat
    for _ in range(rounds):
        counts = Counter(witness)
        names = sorted(counts)
        stretched = [with_inserted(u, rng) for u in names for _ in range(4) if 4 <= len(u) < UNIT]
        x = features([*names, *stretched, *negatives])
        sign = np.concatenate([np.ones(len(names) + len(stretched)), -np.ones(len(negatives))])
        weight = np.concatenate([np.array([counts[u] for u in names], float), np.full(len(stretched), 0.2), np.ones(len(negatives))])
        v = svm(x, sign, weight)
        share_of = (root @ v[:-1])[landmark]
        model = Model(np.bincount(held, weight_of * share_of, LETTERS**3), float(v[-1]), 1.0, 0.0, chosen, list(pairs))
        margin = np.concatenate([model.margins_of(*found(k), len(every[k : k + TOGETHER])) for k in range(0, len(every), TOGETHER)])
        witness = witnesses(lambda u: margin[place[u]])
        hard = [every[k] for k in harmless[np.argsort(-margin[harmless], kind="stable")[:HARD]]]
        negatives = sorted(set(negatives) | set(hard))
    worst = np.array([max((margin[place[u]] for u in bag), default=model.bias) for bag in bags])
    curve = np.array([1.0, 0.0])  # logistic, on the worst margin, by Newton steps
    x = np.stack([worst, np.ones(len(worst))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -50, 50)))
        slant = (x * (p - y)[:, None]).mean(axis=0) + [1e-4 * curve[0], 0.0]
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(bend, slant)
        curve -= step * min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() else 0.0
        if np.abs(step).max() < 1e-9:
            break
    a, b = curve.tolist()
    model.slope, model.shift = a, b
    return model


class Scorer:
    """Scores texts; margins of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.firsts, self.seconds = (sorted({p.split(BETWEEN)[k] for p in model.pairs}) for k in (0, 1))
        self.sides: dict[str, int] = {}  # of words alike: 1 if one may start a pair, 2 if end it
        self.pairs: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = list(words.difference(self.known))
        folded = list(map(fold, new))
        units = set(folded)
        long = [u for u in units if len(u) > UNIT]
        single = [u for u in units if len(u) == 1]
        distinct = list(units.difference(long, single, [""]).union(*map(windows, long)))
        margin = dict(zip(distinct, self.model.margins(distinct).tolist(), strict=True))
        margin |= {u: max(map(margin.__getitem__, windows(u))) for u in long}
        margin |= dict.fromkeys(single, SINGLE)
        margin[""] = NOTHING
        self.known.update(zip(new, map(margin.__getitem__, folded), strict=True))
        if self.model.pairs and new:
            self._sides(new, folded)

    def _sides(self, new: list[str], folded: list[str]) -> None:
        if len(self.sides) > REMEMBERED:
            self.sides = {w: k for w, k in self.sides.items() if w in self.known}
            self.pairs = {}
        words = sorted({u for u in folded if 1 < len(u) <= UNIT})
        kind = np.zeros(len(words), np.int64)
        for bit, others in ((1, self.firsts), (2, self.seconds)):
            others = [u for u in others if len(u) <= UNIT]
            if words and others:
                kind |= bit * (kernel(words, others).max(axis=1) >= ALIKE)
        side = dict(zip(words, kind.tolist(), strict=True))
        for w, u in zip(new, folded, strict=True):
            if side.get(u):
                self.sides[w] = side[u]

    def _paired(self, words: list[str]) -> float:
        """The highest margin of neighbours that may be a pair."""
        best, before = -1e9, None
        for w in words:
            m = self.known[w]
            if before is not None and self.sides.get(w, 0) & 2:
                p = fold(before) + BETWEEN + fold(w)
                if p not in self.pairs:
                    self.pairs[p] = float(self.model.margins(windows(p)).max())
                best = max(best, self.pairs[p])
            if m != NOTHING:
                before = w if self.sides.get(w, 0) & 1 else None
            if w[-1] in ".!?":
                before = None
        return best

    def worst(self, texts: list[str | None]) -> np.ndarray:
        out, step, held, size = [], [], set(), 0
        for t in [*texts, None]:
            words = (t or "").split()
            step.append(words)
            held.update(words)
            size += len(words)
            if size > STEP:
                out += self._finish(step, held)
                step, held, size = [], set(), 0
        out += self._finish(step, held)
        return np.array(out[: len(texts)])

    def _finish(self, step: list[list[str]], held: set[str]) -> list[float]:
        self._learn(held)
        get, base = self.known.__getitem__, self.model.bias
        out = []
        for words in step:
            values = list(map(get, words))
            best = max(values, default=NOTHING)
            if best == NOTHING:
                best = base
            if values.count(SINGLE) >= 3:  # spaced-out words
                runs = self._runs(words, values)
                if runs:
                    best = max(best, float(self.model.margins(runs).max()))
            if self.sides:
                best = max(best, self._paired(words))
            out.append(max(best, -1e3) if best != SINGLE else base)
        return out

    @staticmethod
    def _runs(words: list[str], values: list[float]) -> list[str]:
        """Units of three or more single letters that only words without letters part."""
        m = np.array(values)
        lettered = np.flatnonzero(m != NOTHING)
        single = np.concatenate(([False], m[lettered] == SINGLE, [False]))
        edges = np.flatnonzero(single[1:] != single[:-1]).reshape(-1, 2)
        return [u for lo, hi in edges.tolist() if hi - lo >= 3 for u in windows("".join(fold(words[k]) for k in lettered[lo:hi].tolist()))]


def chosen(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, tuple[str, ...]]:
    """i, bag (distinct units and blamed pairs), y, and the pairs that they blame, of up to `sample` labelled texts of each class
    for which keep(doc_id) holds, least hash of the id first, and of SAMPLE_BYTES
    a class at most; a fixed bound.  An id with both labels is toxic; equal rows
    count once; null ids and other labels than 0 and 1 are left out."""
    ids = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull())
    ids = ids.groupBy("i").agg(F.max("y").alias("y")).where(keep(F.col("i")))
    first = [F.xxhash64("i"), F.col("i")]
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(*first).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i")  # at most 2 * sample ids

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bags, pairs = ([" ".join(sorted(set(of(t)))) for t in texts] for of in (units_of, pairs_of))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.string()), pa.array(pairs, pa.string()), b.column(2)], ["i", "bag", "pairs", "y"])

    bags = stored(rows.select("i", "text", "y").mapInArrow(returning(shrink), "i long, bag string, pairs string, y int"), "toxicity-sample").distinct()
    kept = None
    for y in (0, 1):
        part = bags.where(F.col("y") == y).orderBy(*first, "bag", "pairs").limit(sample)
        so_far = F.sum(F.octet_length("bag")).over(Window.orderBy(*first, "bag", "pairs").rowsBetween(Window.unboundedPreceding, 0))  # of at most `sample` rows
        part = part.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).drop("so_far")
        kept = part if kept is None else kept.unionByName(part)
    kept = stored(kept, "toxicity-texts")
    pairs = blamed_pairs(kept)
    bag = F.col("bag")
    if pairs:
        held = F.transform(F.split("pairs", " "), lambda p: F.substring_index(p, BETWEEN, 2))
        bag = F.concat_ws(" ", "bag", F.array_join(F.array_intersect(held, F.array(*map(F.lit, pairs))), " "))
    return kept.select("i", bag.alias("bag"), "y"), tuple(pairs)


def sampled(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> tuple[list[str], list[int], tuple[str, ...]]:
    """What `chosen` gives, on the driver."""
    kept, pairs = chosen(docs, labels, keep, sample)
    rows = sorted(kept.collect(), key=lambda r: (r.i, r.bag))
    return [r.bag for r in rows], [r.y for r in rows], pairs


def blamed_pairs(texts: DataFrame) -> list[str]:
    """Up to PAIRS pairs that toxic texts hold more often than chance lets them,
    of words that are not blamed themselves; counted where the texts are.  Toxic
    texts count by the different words before the pair, so that copies of one
    toxic text, in which all words are neighbours of the same, blame nothing."""
    n1, n0 = (x or 0 for x in texts.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n1 or not n0:
        return []

    def blamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels = [], []
        for b in batches:
            bags += [t.split() for t in b.column(0).to_pylist()]
            labels += b.column(1).to_pylist()
        toxic, clean, _, _ = counted(bags, labels)
        sure = certain(len(toxic) + len(clean))
        yield pa.RecordBatch.from_arrays([pa.array([u for u in toxic if evidence(toxic[u], clean[u], n1, n0) > sure], pa.string())], ["u"])

    # one task: the sample is bounded
    words = stored(texts.select("bag", "y").coalesce(1).mapInArrow(returning(blamed), "u string"), "toxicity-words")
    each = texts.select("y", F.explode(F.split("pairs", " ")).alias("p")).where("p <> ''")
    sides = F.split("p", "[+]")
    each = each.groupBy(sides[0].alias("a"), sides[1].alias("b"), sides[2].alias("before"), "y").agg(F.count("*").alias("n"))
    total = texts.agg(F.sum(F.size(F.split("pairs", " ")))).first()[0] or 0
    c1, c0 = F.sum("y").cast("double"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).cast("double")
    counts = each.groupBy("a", "b").agg(c1.alias("c1"), c0.alias("c0")).where("c1 >= 3")
    e1, e0 = (F.col("c1") + F.col("c0")) * (n1 / (n1 + n0)), (F.col("c1") + F.col("c0")) * (n0 / (n1 + n0))
    proof = F.col("c1") * F.log(F.col("c1") / e1) + F.when(F.col("c0") > 0, F.col("c0") * F.log(F.col("c0") / e0)).otherwise(0.0)
    found = counts.where((F.col("c1") > e1) & (proof > certain(total)) & (F.col("c0") * n1 * 20 < F.col("c1") * n0)).select(F.concat("a", F.lit(BETWEEN), "b").alias("pair"), proof.alias("proof"), "a", "b")
    for side in ("a", "b"):
        found = found.join(F.broadcast(words), F.col(side) == F.col("u"), "left_anti")
    return [r.pair for r in found.orderBy(F.desc("proof"), "pair").limit(PAIRS).collect()]


def held_out(doc_id, folds: int = 4, fold_: int = 2):
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold_, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row of docs.  Null and
    empty texts, and texts without letters, have the score of no evidence.  Ids
    may be null or repeat.  Other columns of docs are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                s = shared.value.scores(scorer.worst(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    i = F.col(id_col).cast("long")
    return docs.select(i.alias("doc_id"), held_out(i).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(returning(run), "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside the held-out fold (`sampled`).  Without
    any, or with one class only, all texts get the same score, the share of
    toxic ones.  Null and empty labelled texts count as texts without units."""
    kept, pairs = chosen(docs, labels, lambda i: ~held_out(i), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        model = train([r[1] for r in rows], [r[2] for r in rows], pairs=pairs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # trained by one task of an executor: the sample is bounded
    got = kept.select("i", "bag", "y").coalesce(1).mapInArrow(returning(run), "model binary").collect()
    return pickle.loads(got[0].model) if got else train([], [])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (see `score`) by a machine learned from
    the labelled rows (see `fit`).  Empty tables on either side are fine."""
    return score(docs, fit(docs, labels, sample))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below
    threshold.  Null and empty texts have no evidence and so stay, unless the
    model without evidence rejects all; repeated rows are treated alike."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield part.filter(pa.array(shared.value.scores(scorer.worst(part.column(at).to_pylist())) < threshold))

    return docs.mapInArrow(returning(run), docs.schema)
