"""What the operators share: scratch tables, plan sizes, words, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.sources.scratch import remove, scratch, stored

__all__ = ["WORD", "Tables", "arrow_rows", "components", "give_back", "parts", "plan_bytes", "remove", "returning", "scratch", "sent", "spread", "stored"]

#: Words of a text: runs without the six ASCII spaces.  bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

class Tables:
    """Scratch tables of one operator, to be cleared when its last one no longer needs them."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, frame: DataFrame, name: str) -> DataFrame:
        spark, path = frame.sparkSession, scratch(frame.sparkSession, name)
        self.paths.append((spark, path))
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def clear(self) -> None:
        for spark, path in self.paths:
            remove(spark, path)
        self.paths = []


#: Estimates from here on mean that the optimizer knows nothing (rows that come from the driver or an RDD).
UNKNOWN = 1 << 54


def plan_bytes(frame: DataFrame) -> int:
    """The optimizer's estimate of the frame's size; for a scan, its files.
    Where it knows nothing, the frame's text is measured."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN:
        return size
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in frame.dtypes if kind in ("string", "bigint", "int")]
    each = sum(text, F.lit(8)).cast("long")
    return int(frame.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0])


def parts(frame: DataFrame, each_mb: int = 8) -> int:
    """Partitions of about each_mb of input, at least what the session asks for."""
    spark = frame.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(frame) // (each_mb << 20)), 1)


def spread(frame: DataFrame) -> DataFrame:
    """Deals a scan of few tasks (a file of one row group) over the cluster; a
    scan that already has a task for 8 MB of input, or for each core, is left alone."""
    tasks = frame.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    n = min(parts(frame), frame.sparkSession.sparkContext.defaultParallelism)
    return frame.repartition(n) if tasks * 2 < n else frame


#: Tables of up to so many bytes are sent to all executors.
BROADCAST = 16 << 20


def sent(table: DataFrame, row: int, more: Column | None = None, most: int | None = None) -> DataFrame:
    """A written table, to be broadcast if its rows, of `row` bytes and `more`, measure up to `most` (BROADCAST)."""
    size = table.agg(F.sum(F.lit(row) + (F.lit(0) if more is None else more))).first()[0] or 0
    return F.broadcast(table) if size <= (BROADCAST if most is None else most) else table


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker gives its free memory back:
    Spark uses it again for other stages, and idle ones count as well."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        give_back()

    return wrapped


def give_back() -> None:
    """Free memory that this process's allocators hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside give Python workers so many rows at a time at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(links: DataFrame, name: str = "links", tables: Tables | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node
    reachable.  Alternates large-star and small-star rounds (Kiveris et al.
    2014), each written to scratch; neighbours are never gathered, only their
    minimum, so a node of very many links is summed before it is shuffled."""
    stored = (tables or Tables()).stored
    edges = stored(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), name)
    sign = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    if not sign[0]:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    while True:
        # large star: each neighbour above u goes to the least of u and its neighbours
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi")
        # small star: the neighbours below u, and u, go to the least of them
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e")).select("e.lo", "e.hi").where("lo < hi").distinct()
        new = stored(small, name)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        edges, last, sign = new, sign, now
        if last == now:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
