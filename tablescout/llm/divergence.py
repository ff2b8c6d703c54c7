"""How the sources of a language differ in their terms.

Terms whose counts over the sources are the same, column by column, differ
alike: distinct columns are kept with the number of their terms, each pair of
sources is evaluated once a distinct column and the value taken as often.  What
single terms add is ranked over the terms themselves.  All numbers are whole:
probabilities are counted in units of a billionth."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import Tables, sent

#: Terms are kept from so many documents of their language on; ranks of terms that are returned.
LEAST, TOP = 3, 200
UNIT = 10**9
#: Distinct terms that a worker sums before it hands them on.
HELD = 1 << 18
#: Sources on the left of the pairs that one task evaluates; columns at a time.
BLOCK, ROWS = 64, 1024
#: Distinct columns of one task's group, about.
GROUP = 4096
#: Fixed rule: ASCII other than letters parts terms, A-Z become a-z, all else is kept.
FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text in UTF-8, in order, repeats included."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, cnt, docs), summed over many documents."""
    names = ["lang", "source", "term", "cnt", "docs"]
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (cnt, docs) in sums.items():
            n = len(cnt)
            if n:
                term = pa.array(list(cnt), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), term, pa.array(cnt.values(), pa.int64()), pa.array([docs[t] for t in cnt], pa.int64())], names)
        sums.clear()

    for b in batches:
        for lang, source, text in zip(*b.columns, strict=True):
            own = Counter(terms(text.as_py()))
            cnt, docs = sums.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            held -= len(cnt)
            cnt.update(own)
            docs.update(own.keys())
            held += len(cnt)
            if held > most:
                yield from out()
                held = 0
    yield from out()


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), a thousand at a time, so that nothing overflows below 9e15 terms."""
    rest = (count + 1).astype(np.int64)
    got = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        got = got * 1000 + rest // whole
        rest = rest % whole
    return got + 1


def _evaluated(key: tuple, columns: pa.Table, sources: pa.Table, width: int) -> pa.Table:
    """Sums over one group of distinct columns for a block of sources against all others of the language."""
    lang, block, salt = (k.as_py() for k in key)
    order = sources.sort_by("place")
    names, n = order["source"].to_pylist(), order["n"].to_numpy()
    lo, hi = block * width, min(len(names), (block + 1) * width)
    total = np.zeros((hi - lo, len(names)), np.int64)
    if columns.num_rows:
        whole = n + order["v"][0].as_py()
        place = {s: k for k, s in enumerate(names)}
        for at in range(0, columns.num_rows, ROWS):
            part = columns.slice(at, ROWS).combine_chunks()
            many = part["terms"].to_numpy()
            lists = part["counts"].chunk(0) if isinstance(part["counts"], pa.ChunkedArray) else part["counts"]
            flat = lists.flatten()
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            dense = np.zeros((len(lists), len(names)), np.int64)
            dense[rows, [place[s] for s in flat.field("source").to_pylist()]] = flat.field("cnt").to_numpy()
            p = shares(dense, whole)
            for a in range(lo, hi):
                far = p[:, a : a + 1] - p
                total[a - lo] += (far * far // p * many[:, None]).sum(axis=0)
    a, b = np.meshgrid(np.arange(lo, hi), np.arange(len(names)), indexing="ij")
    said = (a != b) & ((total != 0) | (salt == 0))  # every pair comes out of the first group
    label = pa.array(names, pa.string())
    return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), int(said.sum())), "source": label.take(pa.array(a[said])), "item": label.take(pa.array(b[said])), "value": pa.array(total[said], pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK, group: int = GROUP, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 in each lang, source and
    part; value descending, item ascending by bytes).

    part `pair`: item is each other source of the language, value the sum of
    floor((p - q)^2 / q) over all kept terms, p the source's and q the item's.
    part `term`: items are the kept terms of the source with p above the
    language's q, the first `top` of them.  p and q are 1 + floor(10^9 (count
    + 1) / (N + V)), N the counts of all V kept terms there.

    Null texts, languages and sources are empty strings; a row is a document,
    repeated rows are several.  A source without terms is a source; a language
    of one source has no pairs; without kept terms all pairs are 0.  An empty
    table gives no rows; other columns are not looked at.

    Counts are summed in the workers, then a language, term and source, before
    the sources of a term meet: a row of each at most, however frequent it is.
    Distinct columns are dealt in salted groups of about `group`, for blocks
    of `block` sources.  What is told of each source (a row each, of which the pairs
    are the square) is broadcast up to a measured size, else shuffled."""
    tables = Tables()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = given.mapInArrow(lambda batches: _counted(batches, held), "lang string, source string, term string, cnt long, docs long").groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    of_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("cnt").alias("total"), F.array_sort(F.collect_list(F.struct("source", "cnt"))).alias("counts"))
    kept = tables.stored(of_term.where(F.col("docs") >= least).select("lang", "term", "total", "counts"), "divergence-terms")

    each = kept.select("lang", F.explode("counts").alias("c")).select("lang", "c.source", "c.cnt").groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    found = given.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(whole, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    sources = tables.stored(found.select("lang", "source", zero("n"), zero("v"), zero("all"), place), "divergence-sources")

    columns = tables.stored(kept.groupBy("lang", "counts").agg(F.count("*").alias("terms")), "divergence-columns")
    salts = columns.groupBy("lang").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    blocks = sources.groupBy("lang").agg(F.floor(F.max("place") / block).cast("int").alias("last")).join(salts, "lang", "left")
    blocks = tables.stored(blocks.select("lang", "last", F.coalesce("salts", F.lit(1)).alias("salts")), "divergence-blocks")
    dealt = columns.join(sent(blocks, 32, F.octet_length("lang")), "lang").withColumn("salt", F.pmod(F.xxhash64("counts"), F.col("salts")).cast("int"))
    dealt = dealt.select("lang", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "salt", "counts", "terms")
    told = sources.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "salts", "source", "n", "v", "place")
    told = told.select("lang", "block", "source", "n", "v", "place", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sums = dealt.groupBy("lang", "block", "salt").cogroup(told.groupBy("lang", "block", "salt")).applyInArrow(lambda key, a, b: _evaluated(key, a, b, block), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    own = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", F.col("c.source").alias("source"), "term", "total", F.col("c.cnt").alias("cnt"))
    own = own.join(sent(sources, 64, F.octet_length("lang") + F.octet_length("source")), ["lang", "source"])
    share = "1 + cast({0} + 1 as decimal(19,0)) * {2} div cast({1} + v as decimal(19,0))"
    own = own.select("lang", "source", "term", F.expr(share.format("cnt", "n", UNIT)).alias("p"), F.expr(share.format("total", "`all`", UNIT)).alias("q")).where("p > q")
    ranked = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked)
