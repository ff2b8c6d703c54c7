"""Stages of the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablescout.llm import bpe, linededup, neardup, toxicity

from .test_lines import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies(seed=7):
    """Copies with 0 to 9 changed words of 120, a common passage, a large group, short and empty texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 5000)}"
    common, out = [word() for _ in range(30)], []
    for base in range(30):
        words = [word() for _ in range(120)] + common * (base % 3 == 0)
        for copy in range(6 if base else 60):
            changed = list(words)
            for _ in range(r.randint(0, 9) if base else r.randint(0, 5)):
                changed[r.randrange(len(changed))] = word()
            out.append((len(out) * 7 % 1009, " ".join(changed)))
    return out + [(2000, "A b"), (2001, "a B"), (2002, "a"), (2003, ""), (2004, None), (2005, " \n"), (None, "a b"), (None, None)]


def survivors(docs):
    """Smallest ids of the components of links, in brute force."""
    known = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


def linked_pairs(docs):
    known = [(i, shingles(t)) for i, t in docs if i is not None]
    return [(i, j) for k, (i, a) in enumerate(known) for j, b in known[:k] if 10 * len(a & b) >= 8 * len(a | b)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    """Nothing below the similarity links, so what brute force keeps stays; hardly a pair is missed."""
    docs = near_copies()
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, docs), "").collect()
    ids, want = {r.doc_id for r in got if r.doc_id is not None}, set(survivors(docs))
    assert want <= ids and len(ids) <= 1.02 * len(want) and sum(r.doc_id is None for r in got) == 2
    assert {(r.doc_id, r.text) for r in got} <= set(docs) and all(r.n_chars == len(r.text or "") for r in got)
    # few leaders, thinned blocks, few rows held: the same
    monkeypatch.setattr(neardup, "LARGE", 2)
    monkeypatch.setattr(neardup, "HELD", 10)
    again = corpus_pipeline.drop_near_duplicates(spark, table(spark, docs), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_template_gives_candidates_in_proportion(spark, monkeypatch):
    """Texts of one template that hardly miss the similarity: as many candidates a text, however many texts."""
    made = []
    keep = neardup.Tables.stored

    def counted(self, frame, name):
        out = keep(self, frame, name)
        if name == "neardup-candidates":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup.Tables, "stored", counted)
    r, sums = random.Random(4), []
    for n in (150, 600):
        made.clear()
        docs = [(i, " ".join([f"c{k}" for k in range(120)] + [f"w{r.random()}" for _ in range(20)])) for i in range(n)]
        assert corpus_pipeline.drop_near_duplicates(spark, table(spark, docs), "").count() == n
        assert len(made) == 2 and made[1] == 0
        sums.append(sum(made))
    assert sums[1] < 6 * sums[0]


def test_rare_shingles_meet_for_every_similar_pair(spark):
    """Candidates of open sets against brute force: no similar pair is missing, of all sizes and over their classes."""
    r = random.Random(8)
    sets = {}
    for k in range(400):
        base = sets[r.randrange(k)] if k % 3 else None
        own = {r.randint(-(2**62), 2**62) for _ in range(r.choice([1, 3, 5, 8, 12, 40, 90]))}
        sets[k] = set(r.sample(sorted(base), max(1, int(len(base) * r.uniform(0.75, 1))))) | {r.randint(-(2**62), 2**62) for _ in range(int(len(base) * r.uniform(0, 0.3)))} if base else own
    similar = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(similar) > 60 and min(len(sets[a]) for a, _ in similar) < 10
    zeros = 0  # the same fingerprint for all, so that only shingles decide
    known = spark.createDataFrame([(k, np.array(sorted(s), np.int64).tobytes()) for k, s in sets.items()], "node long, s binary")
    opened = spark.createDataFrame([(k, len(s), zeros, zeros, k) for k, s in sets.items()], "node long, size int, p0 long, p1 long, root long")
    found = neardup._rare_candidates(opened, known, 4, 0.8)
    assert similar <= {(x.a, x.b) for x in found.collect()}
    assert {(x.a, x.b) for x in neardup._verified(found, known, 0.8).collect()} == similar


def test_blocks_find_pairs_as_often_as_said():
    """Pairs of 0.8 and more share a block with the stated probability, strangers hardly ever."""
    blocks, bits = neardup.layout(100_000)
    docs = [(i, t) for i, t in near_copies(3) if i is not None and len(shingles(t)) > 3]
    keys = {i: set(neardup.block_keys(neardup.wide_fingerprint(neardup.shingle_set(t), blocks * bits), blocks, bits).tolist()) for i, t in docs}
    pairs = [p for p in linked_pairs(docs) if p[0] != p[1]]
    assert len(pairs) > 200 and sum(bool(keys[i] & keys[j]) for i, j in pairs) >= 0.985 * len(pairs)
    sets = {i: shingles(t) for i, t in docs}
    far = [(i, j) for i in list(keys)[::7] for j in list(keys)[::11] if i != j and not sets[i] & sets[j]]
    assert sum(bool(keys[i] & keys[j]) for i, j in far) <= 0.01 * len(far)


def test_rows_of_one_id_and_different_texts_stay(spark):
    docs = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (2, "o p q r s t u")]
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, docs), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u")]


def test_repeated_passages_go_from_later_texts(spark):
    """Passages of 2 to 6 lines over 50 words, planted in two texts each, against brute force."""
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randint(0, 99999)}" for _ in range(n))
    docs, planted = [], {}
    for k in range(300):
        passage = [line(30) for _ in range(2 + k % 5)]
        for i in (k, 1000 + k):
            docs.append((i, "\n".join([line(8) for _ in range(r.randint(1, 5))] + passage + [line(8) for _ in range(r.randint(1, 5))])))
        planted[1000 + k] = passage
    got = {x.doc_id: x for x in linededup.drop_repeated_chunks(table(spark, docs)).collect()}
    lost, lines = dict.fromkeys(range(2, 7), 0), sum(map(len, planted.values()))
    for i, t in docs:
        kept, gone = got[i].text.split("\n"), set(t.split("\n")) - set(got[i].text.split("\n"))
        assert [x for x in t.split("\n") if x not in gone] == kept and gone <= set(planted.get(i, []))  # only later copies lose lines
        assert len(gone) == got[i].n_removed_lines
        lost[len(planted.get(i, [0, 0]))] += len(gone)
    assert sum(lost.values()) > 0.5 * lines and lost[6] > 0.6 * 360  # chunks that lie wholly in a passage; one cut lost 0.3 of the lines


def corpus(seed=5):
    """Documents with toxic words, repeated passages, near copies and benchmark items, nulls and empty texts."""
    r = random.Random(seed)
    vocabulary = [a + b for a in ("riv", "lam", "sto", "gre", "pap", "win", "mus", "let") for b in ("er", "pine", "ned", "ith", "oula", "ky")]
    word = lambda: r.choice(vocabulary) + str(r.randint(0, 300))
    line = lambda n=9: " ".join(word() for _ in range(n))
    passage, item = [line(12) for _ in range(8)], line(20)
    docs, labels = [], []
    for i in range(240):
        lines = [line() for _ in range(r.randint(4, 9))]
        if i % 6 == 0:
            lines[1] += " " + r.choice(["scoundrel", "nitwit"])
        if i % 5 == 1:
            lines += passage
        if i % 8 == 3:
            lines.append(item)
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(i % 6 == 0)))
    copies = [(1000 + k, docs[7 + k][1].replace("\n", " \n", 1)) for k in range(20)]
    return docs + copies + [(2000, None), (2001, ""), (None, "no id here"), docs[2]], labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("sf")
    docs, labels, items = corpus()
    table(spark, docs).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def test_stages_and_run(spark, sf_dir):
    """Each stage on what the one before kept, against brute force; run() gives the last one's rows."""
    docs, labels, items = corpus()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split("_")[0] for n in names] == ["toxicity", "line", "simhash", "benchmark", "bpe"]
    frame, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf_dir)
        rows = out.collect()
        if name != names[-1]:
            assert out.columns == corpus_pipeline.COLUMNS and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows if name == "line_dedup")
            got = sorted(((r.doc_id, r.text) for r in rows), key=str)
        if name == "toxicity":
            model = toxicity.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
            scorer = toxicity.Scorer(model)
            want = [d for d in docs if model.scores(scorer.worst([d[1]]))[0] < toxicity.THRESHOLD]
            assert sum(i is not None and i < 240 and i % 6 == 0 for i, _ in want) <= 2 and sum(i is not None and i < 240 and i % 6 > 0 for i, _ in want) >= 198
        elif name == "line_dedup":
            want = [x[:2] for x in brute(kept)]
            assert want != kept
        elif name.startswith("simhash"):
            ids = set(survivors(kept))
            assert ids == {i for i, _ in got if i is not None} and len(got) < len(kept)
            assert {g for g in got} <= set(kept) and sum(i is None for i, _ in got) == sum(i is None for i, _ in kept)
            want = got
        elif name.startswith("benchmark"):
            grams = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
            wanted = grams(items[0][1])
            want = [d for d in kept if len(wanted & grams(d[1])) < 0.8 * len(wanted)]
            assert len(want) < len(kept)
        else:
            whole = Tokenizer.from_file(bpe.default_path())
            ids = {(r.doc_id, " ".join(map(str, r.ids))) for r in rows}
            assert ids == {(i, " ".join(map(str, whole.encode(t or "", add_special_tokens=False).ids))) for i, t in kept}
            assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in rows)
            break
        assert got == sorted(want, key=str)
        frame, kept = table(spark, got), got
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in whole) == sorted((str(r.doc_id), r.ids_sha256) for r in rows)


def test_tokens_come_in_small_batches(spark, sf_dir):
    """Whoever writes the last stage's result: workers have been given ROWS texts at a time."""
    out = corpus_pipeline.to_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == len(corpus()[0])
