"""Datasets and collections of datasets."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("has_metadata", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("raw_metadata", T.StringType()),
])


@dataclass(frozen=True)
class Dataset:
    """A named table with optional title/description metadata.  Immutable:
    `with_data` and `with_metadata` give new ones with the same id."""

    dataset_name: str
    data: DataFrame = field(repr=False, compare=False)
    metadata: Mapping[str, Any] | None = field(default=None, repr=False)
    id: str = field(default_factory=lambda: str(uuid4()))

    def with_data(self, data: DataFrame) -> Dataset:
        return replace(self, data=data)

    def with_metadata(self, metadata: Mapping[str, Any] | None) -> Dataset:
        return replace(self, metadata=metadata)

    def catalog_row(self, ord_: int) -> tuple:
        meta = self.metadata
        text = {k: (meta or {}).get(k, "") for k in ("title", "description")}
        for key, value in text.items():
            if not isinstance(value, str):
                raise TypeError(f"metadata of {self.dataset_name}: {key} must be a string, not {type(value).__name__}")
        raw = None if meta is None else json.dumps(meta, ensure_ascii=False)
        return (self.dataset_name, ord_, bool(meta), text["title"], text["description"], raw)


def cells(data: DataFrame, name: Column) -> DataFrame:
    """(dataset_name, cell) of every string or boolean cell that is not null.

    Numbers, dates and times only give words that the content filter drops, so
    the scan leaves those columns out.  Column names are not searched."""
    kept = [f.name for f in data.schema.fields if isinstance(f.dataType, T.StringType | T.BooleanType)]
    if not kept:
        return data.select(name.alias("dataset_name"), F.lit(None).cast("string").alias("cell")).limit(0)
    quoted = [F.col(f"`{c.replace('`', '``')}`").cast("string") for c in kept]
    return data.select(name.alias("dataset_name"), F.explode(F.array(*quoted)).alias("cell")).where("cell is not null")


def spread(frame: DataFrame) -> DataFrame:
    """Deals a scan of few bytes, which gets fewer tasks than cores, over all of
    them; by the optimizer's estimate, so nothing runs for it."""
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if size // each * 2 < cores else frame


@dataclass(frozen=True)
class Collection:
    """Ordered datasets: `catalog` has a row for each, `cells` their text."""

    catalog: DataFrame
    cells: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, datasets: Iterable[Dataset]) -> Collection:
        """Datasets in their given order."""
        given = list(datasets)
        names = [d.dataset_name for d in given]
        if len(set(names)) < len(names):
            raise ValueError("dataset names must be unique")
        catalog = spark.createDataFrame([d.catalog_row(i) for i, d in enumerate(given)], CATALOG)
        text = spark.createDataFrame([], "dataset_name string, cell string")
        for d in given:
            text = text.unionByName(cells(d.data, F.lit(d.dataset_name)))
        return cls(catalog, text)

    @classmethod
    def grouped(cls, table: DataFrame, name: str, text: list[str]) -> Collection:
        """One table whose `name` column tells the dataset of each row; without
        metadata.  All have the place 0, so that ties go by name."""
        given = table.select(F.col(name).alias("dataset_name"), *text)
        names = given.select("dataset_name").where("dataset_name is not null").distinct()
        catalog = names.select("dataset_name", F.lit(0).cast("long").alias("ord"), F.lit(False).alias("has_metadata"), F.lit("").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("raw_metadata"))
        return cls(catalog, cells(spread(given).where("dataset_name is not null"), F.col("dataset_name")))
