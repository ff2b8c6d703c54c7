"""Fill-in-middle documents: a text cut at two tokens, its parts in another order.

A text is decoded to an array of code points; places where white space follows
something else end a token, so every boundary comes out of one comparison of
neighbours.  The cuts are ranks among these boundaries, drawn from a hash of
the document's id: the same on every run and every cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 texts, how many are rearranged, and how many of those begin with the suffix.
RATE, SPM = 50, 80
#: Code points that a worker turns into rows before it hands them on.
STEP = 1 << 22


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where tokens end: white space goes with what follows it, at the end of the text it is a token."""
    if not points.size:
        return np.zeros(0, np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    inner = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(inner, points.size)


@dataclass(frozen=True)
class Cut:
    """A text in its new form.  prefix, middle: lengths in code points, None if plain."""

    n: int
    form: str
    output: str
    prefix: int | None = None
    middle: int | None = None


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of an id; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    return one, two, three, four


def rearrange(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> Cut:
    """Empty texts, texts that hold a mark and those not drawn stay as they are."""
    points = code_points(text)
    ends = token_ends(points)
    n = len(ends)
    one, two, drawn, order = draws(doc_id, seed)
    if not text or drawn % 100 >= rate or any(m in text for m in MARKS):
        return Cut(n, "plain", text)
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = string(points[:a]), string(points[a:b]), string(points[b:])
    p, s, m = MARKS
    if order % 100 < spm:
        return Cut(n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a)
    return Cut(n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a)


def restore(output: str, form: str) -> str:
    """The text that was rearranged, from its output and form alone: no part holds a mark."""
    if form == "plain":
        return output
    first, second = (MARKS[0], MARKS[1]) if form == "psm" else (MARKS[1], MARKS[0])
    head, _, middle = output.removeprefix(first).partition(MARKS[2])
    left, _, right = head.partition(second)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, with_output: bool = True) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars
    (code points; null if plain), output_sha256, restored_sha256 (of the text
    rebuilt from the output) and, with_output, output; a row for each row.

    Null texts are empty; empty texts have no tokens and are plain.  A null id
    draws as an empty one; rows that repeat an id draw alike, each on its own
    text.  An empty table gives no rows; other columns of docs are not looked
    at.  Each row is done by itself: no shuffle, a text at a time in memory."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * with_output
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_output

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                i, t = doc.as_py(), text.as_py() or ""
                c = rearrange(i, t, seed, rate, spm)
                row = (i, c.n, c.form, c.prefix, c.middle, _sha256(c.output), _sha256(restore(c.output, c.form)))
                rows.append((*row, c.output) if with_output else row)
                held += len(t) + 64
                if held > STEP:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output
    given: list[Column] = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*given).mapInArrow(run, schema)
