"""Content-defined line chunks against a version written out line by line."""

import random
import struct

import pytest
import xxhash

from tablescout.llm import linededup

from .test_operators import made, texts

LONG = "\n".join(f"row {k % 97} of {k}" for k in range(3000))


def place(i):
    return float("-inf") if i is None else i


def hashed(x, seed=42):
    """Spark's xxhash64 of a string or a long."""
    data = x.encode() if isinstance(x, str) else struct.pack("<q", x)
    h = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def cut(text, window, divisor, least, cuts):
    """(first line, line after the last) of chunks of two lines or more, of all cuts."""
    lines = text.split("\n")
    hs = [hashed(x) for x in lines]
    out = set()
    for bits in range(0, 8 * cuts, 8):
        begin = 0
        for k in range(len(lines)):
            roll = 17
            for h in hs[max(0, k - window + 1) : k + 1]:
                roll = hashed(h, hashed(roll))
            roll = roll if not bits else (roll & ((1 << 64) - 1)) >> bits
            if k + 1 == len(lines) or (roll % divisor == 0 and k + 1 - begin >= least):
                if k > begin:
                    out.add((begin, k + 1))
                begin = k + 1
    return lines, out


def brute(docs, window=linededup.WINDOW, divisor=linededup.DIVISOR, least=linededup.LEAST, cuts=linededup.CUTS):
    first = {}
    all_cut = {t: cut(t, window, divisor, least, cuts) for _, t in docs if t is not None}
    for i, t in docs:
        for b, e in all_cut[t][1] if t is not None else []:
            c, at = "\n".join(all_cut[t][0][b:e]), (place(i), b, hashed(t))
            first[c] = min(first.get(c, at), at)
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        lines, chunks = all_cut[t]
        lost = [(b, e) for b, e in chunks if first["\n".join(lines[b:e])] != (place(i), b, hashed(t))]
        gone = {k for b, e in lost for k in range(b, e)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(lost), len(gone)))
    return out


def given():
    r = random.Random(8)
    line = lambda: f"line {r.randint(0, 60)}"
    docs = [(i, "\n".join(line() for _ in range(r.randint(0, 30)))) for i in range(150)]
    passage = "\n".join(f"passage line {k}" for k in range(12))
    docs += [(200 + i, f"own {i}\n{passage}\ntail {i}") for i in range(60)]
    docs += [(300, None), (301, ""), (302, "\n\n\n"), (303, LONG), (304, "x\n" + LONG), (None, passage), (None, docs[3][1]), (5, docs[5][1]), (6, docs[7][1]), (305, "one line")]
    return docs + texts()


@pytest.mark.parametrize(("window", "divisor", "least", "cuts", "sent"), [(2, 2, 2, 4, 1 << 24), (1, 2, 2, 1, -1), (3, 4, 1, 8, 1 << 24), (2, 3, 3, 2, 0)])
def test_chunks_against_brute_force(spark, monkeypatch, window, divisor, least, cuts, sent):
    monkeypatch.setattr(linededup, "BROADCAST", sent)
    docs = given()
    got = linededup.drop_repeated_chunks(made(spark, docs), window=window, divisor=divisor, least=least, cuts=cuts, carry=["a"]).collect()
    want = brute(docs, window, divisor, least, cuts)
    assert sorted(map(str, [tuple(x)[:5] for x in got])) == sorted(map(str, want)) and sum(x[3] for x in want) > 100
    assert {x.a for x in got} == {"y"}


def test_plan_is_native(spark):
    plan = linededup.drop_repeated_chunks(made(spark, given()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))
