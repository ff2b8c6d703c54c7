"""Ask and answer between blocks of documents and buckets of keys.

Several operators need, for each of a text's many small strings, what the whole
corpus says about it.  One row a string would multiply the text; instead:

1. documents are dealt into blocks by a hash of their id, a block to a task:
   one shuffle of text, compressed by what each task sends to each block;
2. each block packs what it asks, one compressed parcel for each bucket; equal
   strings of a block travel once, so a string of very many documents reaches
   its bucket at most once a block;
3. each bucket answers every block in the order in which it asked;
4. each block reads its documents again, asks the same way (its order is fixed)
   and applies the answers.

The text's shuffle is used for 2 and 4, parcels are compressed, and a task holds
one block (its documents whole, so one very long document is a block of its
size), or one bucket's parcels.

Blocks times buckets parcels would grow as the square of the input.  From WIDE
blocks on, parcels travel in envelopes by way of relays: a block sends one to
each of about the root of n groups of buckets; the relay of a group of blocks
and a group of buckets opens those and makes one for each bucket.  Answers come
back the same way.  Rows then number about n to the power 1.5, at the price of
a second shuffle of parcels."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import ceil
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import parts

#: (doc_id, UTF-8 text); null texts are empty.
Doc = tuple[int | None, bytes]


def pack(thing: Any, level: int = 1) -> bytes:
    return zstandard.compress(pickle.dumps(thing, protocol=5), level)


def unpack(blob: bytes) -> Any:
    return pickle.loads(zstandard.decompress(blob))


def _docs(blobs: pa.ChunkedArray | pa.Array) -> list[Doc]:
    """In an order that doesn't depend on how rows arrive: by id (nulls first), then text."""
    rows: list[Doc] = []
    for blob in blobs:
        table = pa.ipc.open_stream(zstandard.decompress(blob.as_py())).read_all()
        rows += [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return rows


#: Bytes of documents that a task deals out together.
PACKED = 32 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text) -> (block, blob): documents of one block, compressed together."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def rows() -> Iterator[tuple[int, bytes]]:
        for k in list(held):
            table = pa.Table.from_batches(held.pop(k))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.combine_chunks())
            yield k, zstandard.compress(sink.getvalue().to_pybytes(), 6)

    for b in batches:
        blocks = b.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        dealt, blocks = b.select(["doc_id", "text"]).take(pa.array(order)), blocks[order]
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                held.setdefault(int(blocks[lo]), []).append(dealt.slice(lo, hi - lo))
        size += b.nbytes
        if size > PACKED:
            yield from _batches(rows(), ["block", "blob"])
            size = 0
    yield from _batches(rows(), ["block", "blob"])


#: From so many blocks on, parcels go by relays.
WIDE = 4096
#: Bytes of parcels that are handed over together.
TOGETHER = 1 << 20


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ints and a blob, some at a time."""
    types = [*[pa.int32()] * (len(names) - 1), pa.binary()]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """{first column: [(second, blob)]} of a task, each list in the order of its second column."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for to, by, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out.setdefault(to, []).append((by, blob))
    for rows in out.values():
        rows.sort(key=lambda r: r[0])
    return out


def ask_and_answer(
    docs: DataFrame,
    ask: Callable[[list[Doc], int], Iterator[tuple[int, Any]]],
    answer: Callable[[list[Any]], list[Any]],
    apply: Callable[[list[Doc], dict[int, Any], int], pa.Table],
    schema: str,
    each_mb: int = 8,
    wide: int | None = None,
) -> DataFrame:
    """ask(docs, buckets) -> (bucket, parcel) for some or all buckets; answer(parcels of
    one bucket) -> an answer for each; apply(docs, {bucket: answer}, buckets)
    -> rows.  docs has doc_id long, text string."""
    n = parts(docs, each_mb)
    block = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n)).cast("int").alias("block")
    dealt = docs.select(block, "doc_id", "text").mapInArrow(_packed, "block int, blob binary").repartitionById(n, F.col("block"))
    names = [f.split(" ")[0] for f in schema.split(", ")]
    relayed = n >= (WIDE if wide is None else wide)
    root = max(1, ceil(n**0.5))  # buckets, and blocks, of a group
    groups = -(-n // root)
    sent, letters = ["to", "by", "blob"], "to int, by int, blob binary"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        k = table.column("block")[0].as_py()
        parcels = ask(_docs(table.column("blob")), n)
        if not relayed:
            yield from _batches(((bucket, k, pack(parcel)) for bucket, parcel in parcels), sent)
            return
        envelopes: dict[int, list] = {}
        for bucket, parcel in parcels:
            envelopes.setdefault(bucket // root, []).append((bucket, parcel))
        yield from _batches(((to * groups + k // root, k, pack(parcels)) for to, parcels in envelopes.items()), sent)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = _gathered(batches)
            for bucket in list(held):
                got = [(k, unpack(blob)) for k, blob in held.pop(bucket)]
                if relayed:
                    got = sorted((one for _, several in got for one in several), key=lambda r: r[0])
                replies = zip([k for k, _ in got], answer([p for _, p in got]), strict=True)
                if not relayed:
                    yield from ((k, bucket, pack(reply)) for k, reply in replies if reply is not None)
                    continue
                envelopes: dict[int, list] = {}
                for k, reply in replies:
                    if reply is not None:
                        envelopes.setdefault(k // root, []).append((k, reply))
                yield from ((bucket // root * groups + g, bucket, pack(several)) for g, several in envelopes.items())

        yield from _batches(rows(), sent)

    def relay(group: Callable[[int], int]) -> Callable:
        """Opens envelopes and makes one for each receiver; group(relay) is what the receiver sorts them by."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for hop, got in _gathered(batches).items():
                    receivers: dict[int, list] = {}
                    for by, blob in got:
                        for to, thing in unpack(blob):
                            receivers.setdefault(to, []).append((by, thing))
                    yield from ((to, group(hop), pack(things)) for to, things in receivers.items())

            yield from _batches(rows(), sent)

        return run

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(by, unpack(blob)) for by, blob in zip(right.column("by").to_pylist(), right.column("blob").to_pylist(), strict=True)]
        replies = dict(one for _, several in got for one in several) if relayed else dict(got)
        return apply(_docs(left.column("blob")), replies, n).select(names)

    parcels = dealt.mapInArrow(asked, letters)
    if relayed:
        parcels = parcels.repartitionById(groups * groups, F.col("to")).mapInArrow(relay(lambda hop: hop % groups), letters)
    replies = parcels.repartitionById(n, F.col("to")).mapInArrow(answered, letters)
    if relayed:
        replies = replies.repartitionById(groups * groups, F.col("to")).mapInArrow(relay(lambda hop: hop // groups), letters)
    replies = replies.repartitionById(n, F.col("to"))
    return dealt.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(applied, schema)


def least_positions(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` hashes, where its least is; the first of equals.
    The upper 40 bits of a hash order it, so at most 2**24 hashes go in at once."""
    assert len(grams) < 1 << 24
    low = np.uint64((1 << 24) - 1)
    x = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, todo = 1, span - 1
    while todo:
        step = min(width, todo)
        x = np.minimum(x[:-step], x[step:])
        width, todo = width + step, todo - step
    return (x & low).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a public finalizer, splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Polynomial hashes of byte strings modulo 2**64: an odd base, and a value for each byte.
BASE = 0x9E3779B97F4A7C15
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def prefix_hashes(data: bytes) -> np.ndarray:
    """p with hash(data[a:b]) = (p[b] - p[a]) * inverse[a]."""
    values = BYTES[np.frombuffer(data, np.uint8)]
    powers, _ = power_table(len(values) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)])))
