"""WARC archives of pages, written and read as chunks.

Writing gives one compressed member per record, fed chunk by chunk; a payload
equal to another record's (by SHA-1, of REVISIT bytes or more) becomes a revisit
record that refers to the response of the largest page_id.  Reading gives a
table of chunks: record identifier, chunk number, bytes, and the running length
and digest, so that no record is ever held whole, however large it is."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import arrow_rows, scratch, spread, stored

CHUNK = 64 << 10
#: Payloads from this size on are written once.
REVISIT = 1000
#: Chunks that a worker gets at a time, 16 MB at most.
BATCH = 256
#: Digests of repeated payloads are sent to all executors up to so many bytes, a row counted as ROW; beyond, dealt with so many salts.
BROADCAST, ROW, SALTS = 16 << 20, 128, 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "archive string, records long"
CHUNKS = "archive string, record_no long, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, data binary, bytes_so_far long, sha1 string, declared_sha1 string, declared_bytes long"


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if not write:
        return system.open_input_stream(inner, buffer_size=CHUNK)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, buffer_size=CHUNK)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit: int = REVISIT) -> DataFrame:
    """page_id, url, html (null: empty), sha1, bytes, refers_to (null: response).

    Payloads are equal if their SHA-256 and length are.  Only digests are
    shuffled to find the repeated ones, and summed first; those are sent to all
    executors if they measure up to BROADCAST bytes, so that no payload is
    shuffled; beyond that, both sides are dealt by digest and salt."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    data = html.cast("binary")
    page = F.col(id_col).cast("long").alias("page_id")
    keyed = pages.select(page, F.sha2(data, 256).alias("k"), F.octet_length(html).cast("long").alias("n")).where(F.col("n") >= revisit)
    best = keyed.groupBy("k", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("times")).where("times > 1").select("k", "best")
    best = stored(best, "warc-repeated")
    given = spread(pages).select(page, F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(data).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"), F.when(F.octet_length(html) >= revisit, F.sha2(data, 256)).alias("k"))
    if best.count() * ROW <= BROADCAST:
        joined = given.join(F.broadcast(best), "k", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = given.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["k", "salt"], "left")
    other = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select("page_id", "url", "html", "sha1", "bytes", F.when(other, F.col("best")).alias("refers_to"))


def record_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each payload, in order, made while rows are
    scanned; a revisit is one row without bytes."""
    last = F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk)).cast("int") - 1
    # the payload is bound once and cut once; html itself does not go along with its pieces
    cut = F.transform(F.array(F.col("html").cast("binary")), lambda b: F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(b, k * chunk + 1, F.lit(chunk))))[0]
    pieces = records.select("page_id", "url", "sha1", "bytes", "refers_to", F.when(F.col("refers_to").isNotNull(), F.array(F.lit(b""))).otherwise(cut).alias("pieces"))
    n = F.size("pieces").alias("n")
    dealt = pieces.select("page_id", "url", "sha1", "bytes", "refers_to", n, F.posexplode("pieces").alias("chunk_no", "data"))
    return dealt.select("page_id", "url", "sha1", "bytes", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), "data")


def _head(page_id: int | None, url: str, sha1: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    length = len(_HTTP) + (size if refers_to is None else 0)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _HTTP


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes an archive for each partition, a compressed member a record;
    returns the manifest (archive, records).  Workers get BATCH chunks at a
    time and write them as they come.  Names are new in each attempt and only
    finished tasks are in the manifest, so what a lost executor wrote is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, packer = f"{folder}/{uuid4().hex}.warc.gz", None, 0, None
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, sha1, size, refers_to, number, last, data = (c[k].as_py() for c in b.columns)
                out = out or _open(path, write=True)
                if number == 0:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(page_id, url, sha1, size, refers_to)))
                out.write(packer.compress(data))
                if last:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

    with arrow_rows(records.sparkSession, BATCH):
        return stored(record_chunks(records, chunk).mapInArrow(run, MANIFEST), "warc-manifest")


class _Member:
    """Decompressed bytes of a file of compressed members, as a bounded buffer."""

    def __init__(self, stream: Any):
        self.stream, self.raw, self.buffer, self.unpacker, self.done = stream, b"", bytearray(), None, False

    def fill(self) -> bool:
        """More bytes in the buffer; False at the end."""
        while not self.done:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    self.done = True
                    break
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.raw, CHUNK)
            self.raw = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if self.unpacker.eof:
                self.unpacker = None
            if got:
                self.buffer += got
                return True
        return False

    def head(self) -> dict[str, str] | None:
        """The next record's header."""
        while True:
            while self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            at = self.buffer.find(b"\r\n\r\n")
            if at >= 0 and self.buffer[:1] != b"\r":
                lines = bytes(self.buffer[:at]).decode("utf-8", "replace").split("\r\n")
                del self.buffer[: at + 4]
                return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not self.fill():
                return None

    def take(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end."""
        while len(self.buffer) < n and self.fill():
            pass
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got


def read_chunks(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS of one archive."""
    with _open(path) as stream:
        member, number = _Member(stream), 0
        while (head := member.head()) is not None:
            left = int(head.get("content-length") or 0)
            if left >= len(_HTTP):
                member.take(len(_HTTP))
                left -= len(_HTTP)
            page, refers = head.get("warc-page-id"), head.get("warc-refers-to-page-id")
            declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
            fixed = (path, number, head.get("warc-record-id"), int(page) if page else None, head.get("warc-target-uri"), head.get("warc-type"), int(refers) if refers else None)
            tail = (base64.b32decode(declared).hex() if declared else None, int(head.get("warc-payload-length") or 0))
            digest, so_far, at = hashlib.sha1(), 0, 0
            while True:
                data = member.take(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"{path}: record {number} is cut off")
                left -= len(data)
                so_far += len(data)
                digest.update(data)
                yield (*fixed, at, left == 0, data, so_far, digest.copy().hexdigest(), *tail)
                at += 1
                if left == 0:
                    break
            number += 1


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives, one task an archive; a worker holds 16 chunks at most."""
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[c.split(" ")[1]] for c in CHUNKS.split(", ")]
    files = max(1, manifest.count())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in read_chunks(path, chunk):
                    rows.append(r)
                    held += len(r[9]) + 500
                    if held > 16 * CHUNK:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return manifest.select("archive").repartition(files).mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, folder: str | None = None, **columns: Any) -> DataFrame:
    """Writes pages as archives into `folder` (a new scratch folder) and reads
    them back: page_id, payload_bytes, payload_digest (SHA-1, hex), record_type,
    refers_to; a row for each row of pages.

    A null payload is empty, a null url too.  Records of equal payloads of
    REVISIT bytes or more refer to the one of the largest page_id; rows that
    repeat that page_id are responses too, and so are all if every id is null.
    The rows returned are the last chunks of the chunk table (`read_archives`).
    A response's digest is computed from the bytes read and must be the one its
    header declares; a revisit has no payload and takes both from its header.
    An empty table gives no rows.  Other columns of pages are not looked at."""
    spark = pages.sparkSession
    manifest = write_archives(plan_records(pages, **columns), folder or scratch(spark, "warc"))
    last = read_archives(spark, manifest).where("last")
    bad = (F.col("record_type") == "response") & ((F.col("sha1") != F.col("declared_sha1")) | (F.col("bytes_so_far") != F.col("declared_bytes")))
    digest = F.when(bad, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))).otherwise(F.col("declared_sha1"))
    return last.select("page_id", F.col("declared_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
