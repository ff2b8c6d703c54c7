"""CSV datasets with JSON metadata beside them: `<name>.csv`, `<name>_metadata.json`.

A large dataset is a folder `<name>.csv` of CSV files, each with the header.  Paths go through Hadoop's file systems, so any store Spark reads will do."""

from __future__ import annotations

import csv
import io
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.text import csv_missing
from tablescout.operators.collection import Collection, Dataset, cells
from tablescout.sources import csvtext
from tablescout.sources.scratch import measured, stored

META = "_metadata.json"
#: Data of more bytes, as estimated, are saved as a folder of files, by many tasks.
ONE_FILE = 16 << 20
#: Estimates from here on mean that the optimizer knows nothing.
UNKNOWN = 1 << 54


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> set[str]:
    """Files and subfolders of a folder that do not begin with a dot or an underscore."""
    p, fs = _hadoop(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(f"Folder {folder} not found.")
    return {n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith((".", "_"))}


def _names(spark: SparkSession, folder: str) -> set[str]:
    """Files of a folder, not of its subfolders."""
    p, fs = _hadoop(spark, folder)
    if not fs.exists(p):
        return set()
    return {s.getPath().getName() for s in fs.listStatus(p) if s.isFile()}


def _parts(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Subfolder that ends in .csv -> paths of its files, of those that have any."""
    p, fs = _hadoop(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    parts = {n: [f"{folder}/{n}/{f}" for f in sorted(_names(spark, f"{folder}/{n}")) if not f.startswith((".", "_"))] for n in found if n.endswith(".csv") and not n.startswith((".", "_"))}
    return {n: paths for n, paths in parts.items() if paths}


def _file(column: str = "file", at: int = -1) -> Column:
    """The last part of a file's path, as it is called in its folder; at -2, the folder's name."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col(column), "/"), at), F.lit("+"), F.lit("%2B")))


def _names_in(header: str | None) -> list[str]:
    """Column names of a header record."""
    return [] if header is None else [n.removeprefix("\ufeff") for n in next(csv.reader(io.StringIO(header, newline="")), [])]


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(_names_in(h)) for h in b.column("header").to_pylist()], pa.int32())], [*b.schema.names, "width"])


def inventory(spark: SparkSession, paths: list[str], multiline: bool | None = None, at: int = -1) -> tuple[DataFrame, DataFrame | None]:
    """file (at -2, its folder), path, breaks, header, width of each CSV that is not empty, as a
    written table: whether a line holds an odd number of quotes, so that a cell
    may go on in the next, and the header's record and number of columns.  One
    scan of all files, whatever their number; the records of files with breaks
    are the second frame (None if there are none).  multiline: False, no file is
    taken to have breaks; True, all are."""
    schema = "file string, path string, breaks boolean, header string, width int"
    if not paths:
        return spark.createDataFrame([], schema), None
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    breaks = F.max(quotes % 2 == 1) if multiline is None else F.lit(multiline)
    top = F.min_by("value", F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("nth")))
    plain = stored(text.groupBy("path").agg(breaks.alias("breaks"), top.alias("header")), "csv-files")
    broken = [r.path for r in plain.where("breaks").select("path").toLocalIterator()]
    found = None
    if broken:
        by_name = {tuple(p.split("/")[at:]): p for p in paths}
        found = csvtext.records(spark, [by_name[tuple(unquote(x) for x in p.split("/")[at:])] for p in broken])
        tops = found.where("top").select(F.col("file").alias("path"), F.lit(True).alias("breaks"), F.col("record").alias("header"))
        plain = plain.where("not breaks").unionByName(tops)
    return stored(plain.select(_file("path", at).alias("file"), "path", "breaks", "header").mapInArrow(_widths, schema), "csv-inventory"), found


def _parsed_metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, has_metadata, title, description, raw_metadata, fault: the rule of `Dataset.catalog_row` for a file's JSON."""
    for b in batches:
        rows = []
        for file, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            try:
                name = file.removesuffix(META)
                row = Dataset(name, None, json.loads(text)).catalog_row(0)
                rows.append((file, *row[2:], None))
            except (ValueError, TypeError, AttributeError):
                rows.append((file, None, None, None, None, text))
        kinds = [pa.string(), pa.bool_(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["file", "has_metadata", "title", "description", "raw_metadata", "fault"])


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(_file("_metadata.file_path").alias("file"), "value")


def read_catalog(spark: SparkSession, folder: str, names: list[str], include_metadata: bool) -> DataFrame:
    """The catalog of a folder's datasets, in the order of names, as a written
    table: metadata are read and checked by the executors.  Raises what is wrong
    with the first file that is."""
    order = spark.createDataFrame([(n, f"{n}{META}", i) for i, n in enumerate(names)], "dataset_name string, file string, ord long")
    if not include_metadata or not names:
        return stored(order.select("dataset_name", "ord", F.lit(False).alias("has_metadata"), F.lit("").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("raw_metadata")), "catalog")
    read = _texts(spark, [f"{folder}/{n}{META}" for n in names]).mapInArrow(_parsed_metadata, "file string, has_metadata boolean, title string, description string, raw_metadata string, fault string")
    found = stored(order.join(read, "file", "left"), "catalog")
    wrong = found.where("has_metadata is null").orderBy("ord").select("dataset_name", "fault").first()  # a file of no bytes has no row and no fault
    if wrong:
        Dataset(wrong.dataset_name, None, json.loads(wrong.fault or "")).catalog_row(0)
    return found.drop("file", "fault")


def read_metadata(spark: SparkSession, paths: Iterable[str]) -> dict[str, Any]:
    """File name -> its JSON value; all files in one scan.  Other keys than title and description are kept."""
    paths = list(paths)
    found = {r.file: json.loads(r.value) for r in _texts(spark, paths).toLocalIterator()} if paths else {}
    return {name: found[name] if name in found else json.loads("") for name in (p.rsplit("/", 1)[-1] for p in paths)}


def read_csv(spark: SparkSession, paths: list[str], width: int, multiline: bool = False) -> DataFrame:
    """CSVs of `width` columns as one frame: all columns as strings, missing-value
    literals as null, and `_file`.  multiline: quoted cells hold line breaks, and a task reads a file."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).csv(paths, header=True, multiLine=multiline, escape='"', enforceSchema=True)
    return _cleaned(raw.withColumn("file", F.col("_metadata.file_path")), width)


def _cleaned(raw: DataFrame, width: int) -> DataFrame:
    return raw.select(*[csv_missing(F.col(f"c{i}")).alias(f"c{i}") for i in range(width)], F.col("file").alias("_file"))


def read_groups(spark: SparkSession, files: DataFrame, found: DataFrame | None) -> Iterator[DataFrame]:
    """The files of an `inventory`, a frame for each number of columns: plain
    ones by Spark's reader, the others from their records.  Paths come to the
    driver, as a scan needs them; no file is opened there."""
    groups: dict[tuple[bool, int], list[str]] = defaultdict(list)
    for r in files.where("width > 0").select("path", "breaks", "width").orderBy("path").toLocalIterator():
        groups[r.breaks, r.width].append(r.path)
    of_file = measured(files.select(F.col("path").alias("file"), "width"), F.octet_length("file")) if any(b for b, _ in groups) else None
    for (breaks, width), paths in sorted(groups.items()):
        if breaks:
            yield _cleaned(csvtext.parsed(found.join(of_file.where(F.col("width") == width), "file", "left_semi"), width), width)
        else:
            yield read_csv(spark, [unquote(p) if "%" in p else p for p in paths], width)


def _unique(header: list[str]) -> list[str]:
    """Column names; repeated ones are numbered, empty ones called by their place."""
    seen: dict[str, int] = defaultdict(int)
    out = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        out.append(name if not seen[name] else f"{name}.{seen[name]}")
        seen[name] += 1
    return out


def load_dataset(spark: SparkSession, folder: str, name: str, include_metadata: bool = True, multiline: bool | None = None) -> Dataset:
    """All columns as strings, missing-value literals as null.  Raises
    FileNotFoundError for a missing CSV first, then for missing metadata unless
    include_metadata is False, which gives none even if there is a file."""
    return _load(spark, folder, [name], _names(spark, folder), _parts(spark, folder), include_metadata, multiline)[name]


def load_folder(spark: SparkSession, folder: str, include_metadata: bool = True, multiline: bool | None = None) -> dict[str, Dataset]:
    """Datasets of a folder, not of its subfolders, in name order: files, and
    folders of files, that end in .csv (this case) and not in _metadata.csv."""
    files, parts = _listed(spark, folder), _parts(spark, folder)
    return _load(spark, folder, dataset_names(files | set(parts)), files, parts, include_metadata, multiline)


def _listed(spark: SparkSession, folder: str) -> set[str]:
    p, fs = _hadoop(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(f"Folder {folder} not found.")
    return _names(spark, folder)


def is_dataset_file(file: Column) -> Column:
    return F.endswith(file, F.lit(".csv")) & ~F.endswith(file, F.lit("_metadata.csv"))


def dataset_name(file: Column) -> Column:
    return F.regexp_replace(file, r"\.csv$", "")


def dataset_names(files: Iterable[str]) -> list[str]:
    """Of files that end in .csv (this case) and not in _metadata.csv, sorted."""
    return sorted(f.removesuffix(".csv") for f in files if f.endswith(".csv") and not f.endswith("_metadata.csv"))


def _required(folder: str, names: list[str], files: set[str], include_metadata: bool) -> None:
    """Raises for the first file that is missing, in the order of names."""
    for name in names:
        if f"{name}.csv" not in files:
            raise FileNotFoundError(f"Dataset file {folder}/{name}.csv not found.")
        if include_metadata and f"{name}{META}" not in files:
            raise FileNotFoundError(f"Metadata file {folder}/{name}{META} not found.")


def _inventories(spark: SparkSession, folder: str, names: list[str], parts: Mapping[str, list[str]], multiline: bool | None) -> Iterator[tuple[int, DataFrame, DataFrame | None]]:
    """The `inventory` of single files, then of the files of folders, each with where in a path the dataset's name is."""
    yield -1, *inventory(spark, [f"{folder}/{n}.csv" for n in names if f"{n}.csv" not in parts], multiline)
    split = [p for n in names for p in parts.get(f"{n}.csv", ())]
    if split:
        yield -2, *inventory(spark, split, multiline, -2)


def _load(spark: SparkSession, folder: str, names: list[str], files: set[str], parts: Mapping[str, list[str]], include_metadata: bool, multiline: bool | None) -> dict[str, Dataset]:
    _required(folder, names, files | set(parts), include_metadata)
    metadata = read_metadata(spark, [f"{folder}/{n}{META}" for n in names]) if include_metadata else {}
    known = defaultdict(list)
    for _, listed, found in _inventories(spark, folder, names, parts, multiline):
        for r in listed.where("width > 0").orderBy("path").toLocalIterator():
            known[r.file].append((r, found))
    out = {}
    for name in names:
        rows = known[f"{name}.csv"]
        data = spark.createDataFrame([], T.StructType([]))
        if rows:
            (first, found), width = rows[0], rows[0][0].width
            broken, plain = ([r.path for r, _ in rows if r.breaks is b] for b in (True, False))
            read = [_cleaned(csvtext.parsed(found.where(F.col("file").isin(broken)), width), width)] if broken else []
            read += [read_csv(spark, [unquote(p) if "%" in p else p for p in plain], width)] if plain else []
            data = reduce(DataFrame.unionByName, read).drop("_file").toDF(*_unique(_names_in(first.header)))
        out[name] = Dataset(name, data, metadata.get(f"{name}{META}"))
    return out


def load_collection(spark: SparkSession, folder: str, include_metadata: bool = True, multiline: bool | None = None) -> Collection:
    """A folder of many datasets as a collection, in name order, whatever their
    number: executors read metadata, headers and cells; files of as many columns
    are one scan.  The driver lists the folder."""
    files, parts = _listed(spark, folder), _parts(spark, folder)
    names = dataset_names(files | set(parts))
    _required(folder, names, files | set(parts), include_metadata)
    catalog = read_catalog(spark, folder, names, include_metadata)
    text = spark.createDataFrame([], "dataset_name string, cell string")
    for at, listed, found in _inventories(spark, folder, names, parts, multiline):
        for data in read_groups(spark, listed, found):
            data = data.withColumn("_file", F.struct(dataset_name(_file("_file", at)).alias("name")))  # a struct is not searched
            text = text.unionByName(cells(data, F.col("_file.name")))
    return Collection(catalog, text)


def _is_small(data: DataFrame) -> bool:
    """Whether data have up to ONE_FILE bytes, by the optimizer's estimate; where it knows nothing, by their cells."""
    size = int(str(data._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = data.agg(F.sum(sum([F.coalesce(F.octet_length(F.col(f"`{c.replace('`', '``')}`").cast("string")), F.lit(0)) for c in data.columns], F.lit(1)).cast("long"))).first()[0] or 0
    return size <= ONE_FILE


def save_dataset(folder: str, name: str, data: DataFrame, metadata: Mapping[str, Any] | None = None) -> None:
    """Writes data and, if there is any, its metadata, as `load_dataset` reads
    them: up to ONE_FILE bytes as one CSV, which one task writes, more as a
    folder of CSVs, one of each task."""
    spark = data.sparkSession
    apart, fs = _hadoop(spark, f"{folder}/.{name}.writing")
    small = _is_small(data)
    (data.coalesce(1) if small else data).write.mode("overwrite").csv(f"{folder}/.{name}.writing", header=True, escape='"', emptyValue="", nullValue="", quoteAll=False)
    to, _ = _hadoop(spark, f"{folder}/{name}.csv")
    fs.delete(to, True)
    if small:
        fs.rename(next(s.getPath() for s in fs.listStatus(apart) if s.getPath().getName().startswith("part-")), to)
        fs.delete(apart, True)
    else:
        fs.rename(apart, to)
    if metadata is not None:
        stream = fs.create(_hadoop(spark, f"{folder}/{name}{META}")[0], True)
        try:
            stream.write(bytearray(json.dumps(metadata, ensure_ascii=False).encode()))
        finally:
            stream.close()
