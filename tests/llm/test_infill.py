"""Fill-in-middle against a version by regular expression and against SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from tablescout.llm import infill, registry

from .test_operators import made, texts

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plainly(i, t):
    """Token by token."""
    t = t or ""
    units = TOKEN.findall(t)
    n, h = len(units), sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, sha(t), sha(t))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, n, form, len(p), len(m), sha(out), sha(t))


ODD = [
    (0, None), (1, ""), (2, " "), (3, "a"), (4, "\t\r\n x \x0b\x0c"), (5, "  b\x1c\x85c d"), (6, "😀 é \U0001f469‍\U0001f4bb "), (7, "holds <M> a mark"),
    (8, "< P> <p> <<S<"), (9, "nul \x00 in it"), (None, "no id here at all"), (None, None), (-3, "below zero it is"), (4, "the same id again"), (4, "the same id again"), (2**62, "x " * 5000),
]


def key(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_against_regular_expression(spark):
    docs = ODD + texts() + [(i, "one two  three\nfour <S" + " >x" * (i % 5)) for i in range(300, 420)]
    got = infill.fill_in_middle(made(spark, docs)).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=key) == sorted((plainly(i, t) for i, t in docs), key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert all(sha(r.output) == r.output_sha256 and sha(infill.restore(r.output, r.form)) == r.restored_sha256 for r in got)


def test_tokens_of_random_strings():
    r = random.Random(5)
    for _ in range(500):
        t = "".join(r.choice(" \n\tab< é😀\x85") for _ in range(r.randint(0, 30)))
        ends, at = [], 0
        for u in TOKEN.findall(t):
            at += len(u)
            ends.append(at)
        assert infill.token_ends(infill.code_points(t)).tolist() == ends


def test_no_rows(spark):
    assert infill.fill_in_middle(made(spark, [])).collect() == []


@pytest.mark.parametrize("docs", [ODD, texts(3)], ids=["odd", "texts"])
def test_sql(spark, tmp_path, docs):
    made(spark, docs).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op11_infill"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({registry.oracle_sql()['op11_infill']})").fetchall()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=key) == sorted(want, key=key)
