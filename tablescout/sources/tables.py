"""Folders of tables as collections: each child `<name>.parquet` (a file or a
folder of files) is a dataset."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.operators.collection import CATALOG, Collection, cells
from tablescout.sources.files import children

SUFFIX = ".parquet"


def _scans(spark: SparkSession, paths: list[str]) -> Iterator[DataFrame]:
    """Tables in as few scans as their schemas allow: Spark merges the footers
    in one job; where a column has two types, each half is tried by itself."""
    try:
        # paths of tables, not partitions of one: each is read as it stands
        yield spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)
    except (PySparkException, Py4JJavaError):
        if len(paths) == 1:
            raise
        half = len(paths) // 2
        yield from _scans(spark, paths[:half])
        yield from _scans(spark, paths[half:])


def _table(path: Column) -> Column:
    """The table of a file's path: of a folder's file, the folder's name, else its own."""
    last, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    is_table = lambda x: F.endswith(x, F.lit(SUFFIX)) & (F.length(x) > len(SUFFIX))
    name = F.when(is_table(folder), folder).when(is_table(last), last)
    name = F.substring(name, F.lit(1), F.length(name) - len(SUFFIX))
    return F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def load_tables(spark: SparkSession, folder: str) -> Collection:
    """A folder's Parquet tables as a collection, in name order, without
    metadata; tables whose columns agree are one scan, with the dataset's name
    taken from the path.  A table without rows is a dataset; a column that a
    table lacks has no cells.  Raises FileNotFoundError if there is no folder."""
    names = sorted(n.removesuffix(SUFFIX) for n in children(spark, folder) if n.endswith(SUFFIX) and n != SUFFIX)
    catalog = spark.createDataFrame([(n, k, False, "", "", None) for k, n in enumerate(names)], CATALOG)
    text = spark.createDataFrame([], "dataset_name string, cell string")
    for data in _scans(spark, [f"{folder}/{n}{SUFFIX}" for n in names]) if names else ():
        data = data.withColumn("_file", F.struct(F.col("_metadata.file_path").alias("path")))  # a struct is not searched
        # the name is worked out above the cells, so that filters of these are pushed below it
        text = text.unionByName(cells(data, F.col("_file.path")).select(_table(F.col("dataset_name")).alias("dataset_name"), "cell"))
    return Collection(catalog, text)
