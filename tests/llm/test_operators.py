"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from tablescout.llm import bpe, decontaminate, linededup, ngrams, simhash, substrings, suffixes, topk, toxicity, warc

SCHEMA = "doc_id long, text string, fp long, block int, lost string, h long, a string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, "y") for i, t in rows], SCHEMA)


def texts(seed=1, n=40):
    r = random.Random(seed)
    words = ["the", "of", "Ünd", "a", "data", "thing", "x1", "shore", "lamp", "river"]
    passage = " ".join(r.choice(words) + str(k) for k in range(60))
    out = []
    for i in range(n):
        t = " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.randint(0, 120)))
        out.append((i, t + "  " + passage + "\n" + t[: r.randint(0, 200)] if i % 4 == 0 else t))
    out += [(100, out[0][1]), (101, None), (102, ""), (103, " \t\n"), (104, "ab " * 500), (105, "é" * 700), (None, out[4][1]), (7, out[7][1])]
    return out


def rows_of(frame, *names):
    return sorted(((tuple(r[n] for n in names)) for r in frame.collect()), key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x))


def place(i):
    return -math.inf if i is None else i


def test_windows_against_brute_force(spark):
    docs = texts()
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (math.inf, 0)), (place(i), k))
    want = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (place(i), k):
                gone.update(range(k, k + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = rows_of(substrings.drop_repeated_windows(made(spark, docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) and any(x[2] for x in want)


def test_bytes_against_brute_force(spark):
    docs = [(i, (t or "").encode()) for i, t in texts()]
    seen = Counter(b[k : k + 200] for _, b in docs for k in range(len(b) - 199))
    want = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = rows_of(suffixes.drop_repeated_bytes(made(spark, texts())), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) and any(x[2] for x in want)


def test_suffix_sort_and_spans():
    r = random.Random(3)
    for _ in range(20):
        data = np.array([r.choice(b"ab") for _ in range(200)], np.uint8)
        text, start = suffixes.Text(data), np.array(sorted(r.sample(range(200), 60)))
        size = np.minimum(40, 200 - start)
        group = np.sort(np.array([r.randint(0, 4) for _ in start]))
        got = suffixes.sort_suffixes(text, start, size, group)
        raw = data.tobytes()
        assert [(g, raw[s : s + n]) for g, s, n in zip(group[got], start[got], size[got])] == sorted((g, raw[s : s + n]) for g, s, n in zip(group, start, size))
    data = np.frombuffer(b"abcabdabcabeabd", np.uint8)  # one hash for all: told apart by their bytes
    assert suffixes.equal_strings(data, np.array([0, 3, 6, 9, 12]), 3, np.zeros(5, np.uint64)).tolist() == [0, 1, 2, 4]
    pieces = [b"....anchor....", b"....anchor....", b"x...anchor...x"]
    assert [x.tolist() for x in suffixes.shared_spans(pieces, np.full(3, 4), np.zeros(3, np.int64), 12)] == [[0, 0, 1], [14, 14, 13]]
    for _ in range(40):  # many pieces of one anchor
        pieces = list({bytes(r.choice(b"ab") for _ in range(6)) + b"XY" + bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randint(2, 30))})
        low, high = suffixes.shared_spans(pieces, np.full(len(pieces), 6), np.zeros(len(pieces), np.int64), 8)
        for k, p in enumerate(pieces):
            shared = [x for x in range(7) if any(q[x : x + 8] == p[x : x + 8] for j, q in enumerate(pieces) if j != k)]
            assert (low[k], high[k]) == ((shared[0], shared[-1] + 8) if shared else (0, 0))


def test_simhash_against_brute_force(spark):
    docs = texts()
    fps = {id(d): simhash.fingerprint(d[1]) for d in docs}
    known = [d for d in docs if d[0] is not None]
    root = {fps[id(d)]: min(x[0] for x in known if fps[id(x)] == fps[id(d)]) for d in known}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = rows_of(simhash.simhash_components(made(spark, docs)), "doc_id", "fingerprint", "component_id")
    assert got == sorted([(d[0], f"{fps[id(d)]:016x}", root.get(fps[id(d)])) for d in docs], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_simhash_forest_of_large_groups():
    r = random.Random(5)
    fps = np.array(sorted({sum(1 << r.randrange(30) for _ in range(4)) for _ in range(1500)}), np.uint64)
    label = np.arange(len(fps))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in simhash._forest(fps, 3, (1 << 64) - 1):
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
        label[find(a)] = find(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert all(find(i) == find(int(j)) for i in range(len(fps)) for j in np.flatnonzero(near[i])[:50])


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    r = random.Random(2)
    given = [t or "" for _, t in texts()] + ["<|startoftext|>hi<|endoftext|> x", "İ Σας ΣΑΣ", "a\x1cb \x85c d", "x'snow don't"]
    given += ["".join(r.choice(["the", "in", "tion", "a", "b", "'", "!!", "é", "9"]) for _ in range(r.randint(1, 400))) for _ in range(60)]
    given += ["".join(r.choice(["<|endoftext|>", " ", "\n", "e", "\u0301", "it's", "\u3000", "x" * 40, "Ab", "12"]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    given += ["ab" * 9000 + " tail", "x " * 3000, "é" * 5000, " " * 5000, "word " * 10 + " " * 90 + "end"]
    for leaf, piece in ((16, 16), (16, 512), (100, 8), (2048, 512)):
        tree = bpe.TreeBPE(bpe.default_path(), leaf, piece)
        for t, (n, ids, decoded) in zip(given, tree.encode_many(given), strict=True):
            want = whole.encode(t, add_special_tokens=False).ids
            assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), whole.decode(want, skip_special_tokens=False))
        assert tree.joins > (10 if leaf < 2048 else 0)
    tree = bpe.TreeBPE(bpe.default_path())  # documents as they come are joined
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if os.path.isdir("/root/testdata/sf0.001") else []
    for row, (_, ids, _) in zip(rows, tree.encode_many([x.text for x in rows]), strict=True):
        assert ids == " ".join(map(str, whole.encode(row.text, add_special_tokens=False).ids))
    assert not rows or tree.joins > 100
    with pytest.raises(ValueError, match="not a tokenizer"):
        bpe.TreeBPE(bpe.default_path().replace("word_bpe_49k", "byte_bpe_50k"))
    got = bpe.encode(made(spark, texts())).collect()
    assert len(got) == len(texts()) and all(len(x.ids) == x.n_tokens for x in got)


def test_decontamination_against_brute_force(spark):
    docs = texts()
    items = [(1, " ".join(docs[0][1].split()[-50:-15])), (2, "no such words in any text at all"), (3, None), (4, ""), (5, "data3 lamp"), (6, docs[4][1]), (None, docs[8][1].upper())]
    want = []
    for i, t in items:
        a = decontaminate.shingles((t or "").lower().encode().split())
        n = min(5, len((t or "").split()))
        for d, u in docs:
            w = (u or "").lower().encode().split()
            b = {b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want.append((i, d, len(a), len(a & b)))
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contained_items(made(spark, docs), table)
    assert sorted(map(str, [tuple(r)[:4] for r in found.collect()])) == sorted(map(str, want)) and want
    hit = {d for _, d, _, _ in want}
    assert {r.doc_id for r in decontaminate.without_items(made(spark, docs), table).collect()} == {d for d, _ in docs if d not in hit}


def test_toxicity(spark):
    r = random.Random(6)
    clean = ["river", "lamp", "stone", "green", "paper", "window", "music", "letter", "garden", "silver"]
    insults = ["scoundrel", "nitwit"]
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [r.choice(clean) + r.choice(["", "s", "ly"]) for _ in range(30)] + ([r.choice(insults)] if bad else [])
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad), "t"))
    docs += [(900, None), (901, ""), (902, "n i t w i t stone lamp"), (903, "you scounxdrel"), (904, "123 ..."), (None, "river")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(made(spark, docs), table).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    assert by[902].predicted == 1 and by[903].score > by[904].score == by[901].score == by[900].score < 0.3
    kept = toxicity.without_toxic(made(spark, docs), toxicity.fit(made(spark, docs), table)).collect()
    assert {x.doc_id for x in kept} == {x.doc_id for x in got if not x.predicted}


def test_archives(spark):
    long = "<p>é</p>" * 40_000
    rows = [(1, "http://a/\n b", "x"), (2, "u", long), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "x"), (2, "u", long), (None, "u", "z" * 1000), (8, "u", "w" * 999), (9, "u", "w" * 999)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, sha1 string")
    got = sorted(map(str, (tuple(x) for x in warc.archive_pages(pages).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        kind = ("revisit", 3) if i == 2 else ("response", None)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), *kind))
    assert got == sorted(map(str, want))


def test_chunks_are_the_payload(spark, tmp_path):
    html = "é" * 100_000 + "\r\n\r\nend"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "")], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.plan_records(pages), tmp_path.as_uri())
    chunks = warc.read_archives(spark, manifest, chunk=1000).orderBy("page_id", "chunk_no").collect()
    assert b"".join(c.data for c in chunks if c.page_id == 1).decode() == html
    assert [c.chunk_no for c in chunks if c.page_id == 1] == list(range(201)) and max(len(c.data) for c in chunks) <= 1000
    last = [c for c in chunks if c.last]
    assert len(last) == 2 and all(c.sha1 == c.declared_sha1 and c.bytes_so_far == c.declared_bytes for c in last)


@pytest.mark.parametrize("run", [
    substrings.drop_repeated_windows, suffixes.drop_repeated_bytes, simhash.simhash_components, ngrams.score_texts, bpe.encode, linededup.drop_repeated_chunks,
])
def test_empty_tables(spark, run):
    assert run(made(spark, []).limit(0)).count() == 0


def test_empty_companions(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.predicted for x in toxicity.toxicity(made(spark, texts()), none).collect()} == {0}
    assert decontaminate.contained_items(made(spark, texts()), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
