"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir.  Where that is unset, a session of one
    machine (master local) takes a temporary folder; on a cluster it is an error.
    Removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", Path(tempfile.mkdtemp(prefix="tablescout-")).as_uri())
    path = f"{base.rstrip('/')}/tablescout-{name}-{uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Frees a scratch table that no plan reads any more."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before; the folder is the cluster's to clear then
        return


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: computed once, survives lost executors."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Tables of up to so many bytes are sent to all executors.
BROADCAST = 16 << 20


def fits(table: DataFrame, row: Column) -> bool:
    """Whether the table's rows, of `row` bytes and 8 more, measure up to BROADCAST."""
    return (table.agg(F.sum(F.coalesce(row, F.lit(0)) + 8)).first()[0] or 0) <= BROADCAST


def measured(table: DataFrame, row: Column) -> DataFrame:
    """The table, to be broadcast if it `fits`; else joins with it shuffle."""
    return F.broadcast(table) if fits(table, row) else table
