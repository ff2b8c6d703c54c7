"""CSV files whose quoted cells hold line breaks, read by many tasks.

A line of a split may belong to a cell that was opened in another split.  What
a split does to the state at its start (between records, or inside quotes) is
found for both states; a prefix over the splits of a file then tells each its
state.  Splits are cut into records on their own; only the pieces of records
that cross a boundary are put together, a row or two a split."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.sources.scratch import fits, measured, stored

#: From inside a quoted cell to its closing quote; two quotes are one inside.
CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
#: Records and pieces that a worker holds before it hands them on, in characters.
STEP = 1 << 22


def stays_open(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell.  A quote opens a cell only at its beginning; elsewhere it is a character."""
    at = 0
    if inside:
        closing = CLOSE.match(line)
        if not closing:
            return True
        at = line.find(",", closing.end()) + 1
        if not at:
            return False
    while True:
        if not line.startswith('"', at):
            at = line.find(',"', at) + 1
            if not at:
                return False
        closing = CLOSE.match(line, at + 1)
        if not closing:
            return True
        at = line.find(",", closing.end()) + 1
        if not at:
            return False


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block (where its split begins) and value of each line; a task reads a split's lines in order."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: whether it ends inside quotes if it begins between records, and if it begins inside."""
    now, states = None, [False, True]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states)], ["file", "block", "after_out", "after_in"])

    for b in batches:
        for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != now:
                if now:
                    yield row()
                now, states = (file, block), [False, True]
            if '"' in value:
                states = [stays_open(value, s) for s in states]
    if now:
        yield row()


def split_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, inside: whether a split begins inside quotes.  A row for each split."""
    found = stored(lines(spark, paths).mapInArrow(_effects, "file string, block long, after_out boolean, after_in boolean"), "csv-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # splits that end alike from both states settle it; those that swap the states are counted from there
    sets = F.when(F.col("after_out") == F.col("after_in"), F.col("after_out").cast("int"))
    swaps = F.sum((F.col("after_out") & ~F.col("after_in")).cast("int"))
    found = found.withColumn("swaps", swaps.over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn("set", sets)
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "swaps")), ignorenulls=True).over(before)
    found = found.select("file", "block", last.alias("last"), F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("sofar"))
    state = F.coalesce(F.col("last.set"), F.lit(0)) + F.col("sofar") - F.coalesce(F.col("last.swaps"), F.lit(0))
    return found.select("file", "block", (state % 2 == 1).alias("inside"))


PIECE = "file string, block long, kind string, top boolean, record string"
PIECE_TYPES = [("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("top", pa.bool_()), ("record", pa.string())]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of splits: whole records; head, what ends a record of an earlier
    split; tail, what a later one ends; through, a split within one record.
    top: the file begins with it."""
    rows: list[tuple] = []
    held = 0
    now, parts, opened, inside, first, top = None, [], False, False, True, True

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], [n for n, _ in PIECE_TYPES])

    def rest() -> None:
        if now and parts:
            rows.append((*now, "through" if opened and first else "tail", top, "\n".join(parts)))

    for b in batches:
        for file, block, began_inside, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != now:
                rest()
                now, parts, opened, inside, first, top = (file, block), [], began_inside, began_inside, True, block == 0
            parts.append(value)
            inside = stays_open(value, inside) if inside or '"' in value else False
            if not inside:
                record = "\n".join(parts)
                rows.append((*now, "head" if opened and first else "whole", top, record))
                held += len(record)
                parts, first, top = [], False, top and not record.removesuffix("\r")
            if held > STEP:
                yield out()
                rows.clear()
                held = 0
    rest()
    if rows:
        yield out()


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, top, record: each record as its text; the header is the one on
    top.  Empty lines are none.  A file that ends inside quotes gives the open
    rest as a last record.  Written once, when this is called."""
    states = stored(split_states(spark, paths), "csv-states")
    text = lines(spark, paths).withColumn("nth", F.monotonically_increasing_id())
    if fits(states, F.octet_length("file")):  # then each task goes on reading its splits in order
        text = text.join(F.broadcast(states), ["file", "block"])
    else:
        text = text.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "nth")
    pieces = stored(text.select("file", "block", "inside", "value").mapInArrow(_cut, PIECE), "csv-records")
    # a tail begins a record; what follows up to a head belongs to it
    late = F.col("kind") == "tail"
    nth = F.sum(late.cast("int")).over(Window.partitionBy("file").orderBy("block", late))  # a row or two for each split
    parts = F.array_sort(F.collect_list(F.struct("block", late.alias("late"), "top", "record")))
    crossing = pieces.where("kind <> 'whole'").withColumn("nth", nth).groupBy("file", "nth").agg(parts.alias("parts"))
    crossing = crossing.select("file", F.get("parts", F.lit(0))["top"].alias("top"), F.array_join(F.col("parts.record"), "\n").alias("record"))
    found = pieces.where("kind = 'whole'").select("file", "top", "record").unionByName(crossing)
    return found.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def parsed(found: DataFrame, width: int) -> DataFrame:
    """c0, c1, ... as strings and file of the records under the header."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    cells = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    return found.where("not top").select(cells.alias("r"), "file").select("r.*", "file")
