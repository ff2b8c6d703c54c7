"""The audit of sources against plain Python and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tablescout.llm import divergence, registry

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term string, cnt long, place int"


def made(spark, rows):
    return spark.createDataFrame([(k, t, g, s, "x", 1, 2) for k, (t, g, s) in enumerate(rows)], SCHEMA)


def plainly(rows, least=3, top=200):
    """Every pair over every term."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for t, g, s in rows:
        g, s = g or "", s or ""
        found = TERM.findall((t or "").translate(UPPER))
        count[g, s].update(found)
        docs[g].update(set(found))
        groups.add((g, s))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in [*own, None]:
            c = {t: sum(count[lang, x][t] for x in (own if s is None else [s])) for t in kept}
            share[s] = {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            pair = [(sum(f(share[s][t], share[x][t]) for t in kept), x) for x in own if x != s]
            term = [(f(share[s][t], share[None][t]), t) for t in kept if count[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)]
    return sorted(out)


def random_rows(n, seed=1):
    r = random.Random(seed)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "ß", "日本", "x y", "UP", "Up", " "]
    pick = lambda xs: xs[min(int(r.expovariate(3) * len(xs)), len(xs) - 1)]
    return [(" ".join(pick(words) + r.choice(["", ".", "1", "_"]) for _ in range(r.randint(0, 40))), pick(["en", "de", "fr"]), pick([f"s{k}" for k in range(9)])) for _ in range(n)]


ROWS = {
    "random": random_rows(400),
    "nulls": [(None, None, None), ("a a a", None, "s"), ("A", None, "s"), ("a b", None, None), ("", "en", "s"), (None, "en", None)],
    "one source": [("a b c", "en", "s")] * 4,
    "no kept terms": [("a b", "en", "s"), ("b c", "en", "t"), ("1 2 3", "en", "u")],
    "ties": [("b a c a b c", "en", x) for x in "stuv" for _ in range(3)] + [("é z", "en", "s")] * 3,
    "hot": [("hot word", "en", "big")] * 900 + random_rows(60, 3) + [("long " * 50_000 + "word", "en", "big")],
    "none": [],
}


@pytest.mark.parametrize("name", list(ROWS))
def test_against_every_pair(spark, name, tmp_path):
    rows = ROWS[name]
    table = made(spark, rows)
    assert sorted(map(tuple, divergence.audit(table).collect())) == plainly(rows)
    table.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({registry.oracle_sql()['op13_divergence']})").fetchall()
    assert sorted(got) == plainly(rows)


def test_blocks_and_small_pieces(spark):
    """Sources in several blocks, many groups of columns, counts handed on often, a top of few."""
    rows = ROWS["random"]
    got = divergence.audit(made(spark, rows), least=2, top=5, block=4, group=20, held=50)
    assert sorted(map(tuple, got.collect())) == plainly(rows, 2, 5)


def test_shares_of_large_counts():
    r = random.Random(2)
    for _ in range(200):
        whole = r.randint(1, 8 * 10**15)
        c = r.randint(0, whole - 1)
        assert divergence.shares(np.array([c]), np.array([whole]))[0] == 1 + 10**9 * (c + 1) // whole
