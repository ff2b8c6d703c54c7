"""Every operator on odd tables, values against plain Python."""

import hashlib
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablescout.llm import bpe, decontaminate, linededup, ngrams, simhash, substrings, suffixes, toxicity, warc

from .test_operators import made

TABLES = {
    "one row": [(1, "a b c")],
    "nulls": [(1, None), (2, None), (None, None)],
    "words": [(1, "a"), (2, "b"), (3, "a")],
    "empty": [(1, ""), (2, " \n"), (3, "\n\n")],
    "one long word": [(1, "x" * 300_000), (2, "y")],
    "long": [(1, "lorem ipsum dolor " * 20_000), (2, "lorem ipsum dolor " * 20_000), (3, "\n".join(f"line {k} of many" for k in range(20_000)))],
    "repeats": [(1, "same text here")] * 5 + [(2, "same text here"), (1, "other text here")],
    "none": [],
}


def words(t):
    return (t or "").encode().split()


def one_fingerprint(t):
    """Bit by bit, without the module under test."""
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}" if grams else "0" * 16


@pytest.mark.parametrize("name", list(TABLES))
def test_a_row_for_each_row(spark, name):
    docs = TABLES[name]
    table = made(spark, docs)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    rows = lambda frame, *names: sorted((tuple(r[n] for n in names) for r in frame.collect()), key=key)
    of = lambda f: sorted(((i, *f(t)) for i, t in docs), key=key)
    assert rows(ngrams.score_texts(table), "doc_id", "n_tokens") == of(lambda t: (len(words(t)) + 1,))
    assert rows(substrings.drop_repeated_windows(table), "doc_id", "n_words") == of(lambda t: (len(words(t)),))
    assert rows(suffixes.drop_repeated_bytes(table), "doc_id", "n_bytes") == of(lambda t: (len((t or "").encode()),))
    assert rows(linededup.drop_repeated_chunks(table), "doc_id", "n_lines") == of(lambda t: (0 if t is None else t.count("\n") + 1,))
    if name != "long":
        assert rows(simhash.simhash_components(table), "doc_id", "fingerprint") == of(lambda t: (one_fingerprint(t),))
    encoded = bpe.encode(table).collect()
    assert len(encoded) == len(docs) and all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in encoded)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.toxicity(table, labels).collect()
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in scored)
    items = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum"), (2, None), (3, ""), (4, "same text here")], "item_id long, text string")
    hits = {i for i, t in docs if t and ("lorem" in t or "same text here" in t)}
    assert {r.doc_id for r in decontaminate.contained_items(table, items).collect()} == hits
    assert len(decontaminate.without_items(table, items).collect()) == sum(not t or not ("lorem" in t or "same text here" in t) for i, t in docs)


def test_fingerprints_of_many_texts(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(["Ab", "é", "c!", "ÄÖ", "x" * 50]) for _ in range(r.randint(0, 40)))) for i in range(80)]
    got = {x.doc_id: x.fingerprint for x in simhash.simhash_components(made(spark, docs)).collect()}
    assert got == {i: one_fingerprint(t) for i, t in docs}


def test_several_passes_of_items(spark, monkeypatch):
    docs = [(i, f"start {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(5, 20 + i % 3))) for i in range(0, 20, 2)], "item_id long, text string")
    want = {(i, i) for i in range(0, 20, 2)}
    for size in (1 << 24, 600):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert {(r.item_id, r.doc_id) for r in decontaminate.contained_items(made(spark, docs), items).collect()} == want
        assert {r.doc_id for r in decontaminate.without_items(made(spark, docs), items).collect()} == set(range(1, 20, 2))


@pytest.mark.parametrize("most", [1 << 24, -1])
def test_thousands_of_equal_payloads(spark, monkeypatch, most):
    """A hot payload, one of many chunks, and their copies, by broadcast and by shuffle."""
    monkeypatch.setattr(warc, "BROADCAST", most)
    long = "<p>é</p>" * 60_000
    rows = [(i, "u", "h" * 1200) for i in range(3000)] + [(5000 + i, "u", f"{i} " * 400) for i in range(200)] + [(9000, "u", long), (9001, None, long), (9002, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(13)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        r, best = got[i], last.get(h, i)
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if best == i else ("revisit", best))


def test_time_of_a_payload_is_in_proportion(spark):
    """Hundreds of chunks; eight times the bytes take hardly more than eight times as long."""
    import time

    took = []
    for mb in (4, 32):
        pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef" * 64), mb << 10).alias("html"))
        records = warc.plan_records(pages)
        began = time.perf_counter()
        rows = warc.record_chunks(records).select("chunk_no", "last", F.length("data").alias("n")).collect()
        took.append(time.perf_counter() - began)
        assert len(rows) == mb * 16 and sum(r.n for r in rows) == mb << 20 and [r.chunk_no for r in rows if r["last"]] == [len(rows) - 1]
    assert took[1] < 16 * took[0] + 2
