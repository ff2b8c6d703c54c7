"""Places in an order of more rows than one task can sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.sources.scratch import stored

#: Rows that one task sorts.
SLICE = 1 << 16


def numbered(frame: DataFrame, *order: Column, name: str, each: int = SLICE) -> DataFrame:
    """Adds `name`: 1 for the first row of a total order, without gaps.

    frame is read to be counted and sampled, so it should be a written table.
    Rows are dealt into ranges of about `each`, each sorted by its task; places
    in the ranges are written, and only the ranges' sizes are summed."""
    ranges = max(1, -(-frame.count() // each))
    place = F.monotonically_increasing_id()  # the task's number in the upper bits, the row's in the lower 33
    if ranges == 1:
        return frame.coalesce(1).sortWithinPartitions(*order).withColumn(name, place + 1)
    dealt = stored(frame.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", place), "ranges")
    dealt = dealt.withColumn("_range", F.shiftrightunsigned("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_range").agg((F.max("_at") + 1).alias("_n"))
    above = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select("_range", F.coalesce(above, F.lit(0)).alias("_above"))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_above") + F.col("_at") + 1).drop("_range", "_at", "_above")


def running(frame: DataFrame, number: str, weight: str, name: str, each: int = SLICE) -> DataFrame:
    """Adds `name`: the sum of `weight` over the rows of lower `number`, which
    counts from 1 without gaps.  frame is read twice; sums of `each` rows meet in one task."""
    sliced = frame.withColumn("_slice", F.floor((F.col(number) - 1) / each))
    sums = sliced.groupBy("_slice").agg(F.sum(weight).alias("_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_slice", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_slice"))), F.lit(0)).alias("_above"))
    inside = F.coalesce(F.sum(weight).over(before(Window.partitionBy("_slice").orderBy(number))), F.lit(0))
    return sliced.withColumn("_inside", inside).join(sums, "_slice").withColumn(name, F.col("_above") + F.col("_inside")).drop("_slice", "_inside", "_above")
