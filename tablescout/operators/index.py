"""A stored index of word counts, by word, with a version for each dataset.

    <path>/words/bucket=<hash of the word>/   dataset_name, word, cnt, version
    <path>/top/                               dataset_name, top_words, version
    <path>/state/<number>/                    dataset_name, version: what counts now

A search reads the buckets of its words.  Replacing a dataset counts that one
again and adds its rows under a new version; the next state names it.  A state
is written after the rows it names, so a reader sees all of a change or nothing
of it; rows that no state names are dropped by `compact`."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.text import normalize, tokens
from tablescout.operators.collection import Collection, Dataset
from tablescout.operators.words import content_index, top_word_lists
from tablescout.sources.scratch import measured, remove, stored

BUCKETS = 64
#: Top words that are kept for each dataset.
KEPT = 10
WORDS = "dataset_name string, word string, cnt bigint, version string, bucket int"
TOP = "dataset_name string, top_words array<struct<word:string,cnt:bigint>>, version string"
STATE = "dataset_name string, version string"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ContentIndex:
    """counts and top words of datasets; `table` if it is a plain frame of counts, else at `path` in its state `number`."""

    spark: SparkSession
    path: str = ""
    number: int = 0
    buckets: int = BUCKETS
    table: DataFrame | None = None

    @classmethod
    def of(cls, index: DataFrame | ContentIndex) -> ContentIndex:
        return cls(index.sparkSession, table=index) if isinstance(index, DataFrame) else index

    @classmethod
    def build(cls, collection: Collection, path: str, buckets: int = BUCKETS) -> ContentIndex:
        """Counts all datasets of the collection into a new folder."""
        spark = collection.catalog.sparkSession
        empty = cls(spark, path, 0, buckets)
        return empty._changed(collection.catalog.select("dataset_name"), content_index(collection), spark.createDataFrame([], STATE))

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> ContentIndex:
        """The last state of a folder."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()) for s in (fs.listStatus(p) if fs.exists(p) else []) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"no index at {path}")
        return cls(spark, path, max(done), buckets)

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def state(self) -> DataFrame:
        return self._read(f"state/{self.number}", STATE)

    def _changed(self, names: DataFrame, counts: DataFrame, others: DataFrame) -> ContentIndex:
        """Adds counts of the named datasets under a new version; others: the rest of the next state."""
        version = F.lit(uuid4().hex).alias("version")
        counts = stored(counts, "index-counts")  # for the buckets and the top words
        rows = counts.select("dataset_name", "word", "cnt", version, _bucket(F.col("word"), self.buckets).alias("bucket"))
        rows.repartition(self.buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/words")
        top_word_lists(counts, KEPT).select("dataset_name", "top_words", version).write.mode("append").parquet(f"{self.path}/top")
        after = self.number + 1
        names.select("dataset_name", version).unionByName(others).write.parquet(f"{self.path}/state/{after}")
        remove(self.spark, counts.inputFiles()[0].rsplit("/", 1)[0]) if counts.inputFiles() else None
        return ContentIndex(self.spark, self.path, after, self.buckets)

    def replaced(self, datasets: Iterable[Dataset]) -> ContentIndex:
        """The index with these datasets in place of those of their names, or beside them; only these are counted."""
        changed = Collection.of(self.spark, datasets)
        names = changed.catalog.select("dataset_name")
        return self._changed(names, content_index(changed), self.state().join(measured(names, F.octet_length("dataset_name")), "dataset_name", "left_anti"))

    def removed(self, names: Sequence[str]) -> ContentIndex:
        """The index without datasets; nothing is counted."""
        gone = self.spark.createDataFrame([(n,) for n in names], "dataset_name string")
        self.state().join(measured(gone, F.octet_length("dataset_name")), "dataset_name", "left_anti").write.parquet(f"{self.path}/state/{self.number + 1}")
        return ContentIndex(self.spark, self.path, self.number + 1, self.buckets)

    def compact(self, path: str) -> ContentIndex:
        """The present state alone, in a new folder."""
        state = self.state()
        self._current(self._read("words", WORDS)).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/words")
        self._current(self._read("top", TOP)).write.parquet(f"{path}/top")
        state.write.parquet(f"{path}/state/1")
        return ContentIndex(self.spark, path, 1, self.buckets)

    def _current(self, rows: DataFrame) -> DataFrame:
        state = self.state()
        return rows.join(measured(state, F.octet_length("dataset_name") + F.lit(32)), ["dataset_name", "version"], "left_semi")

    def counts(self, queries: Sequence[str] | None = None) -> DataFrame:
        """dataset_name, word, cnt; with queries, of their words only, from the buckets of these."""
        if queries is None:
            return self.table if self.table is not None else self._current(self._read("words", WORDS)).select("dataset_name", "word", "cnt")
        given = self.spark.createDataFrame([(q,) for q in queries], "q string").select(F.explode(tokens(normalize(F.col("q")))).alias("word")).distinct()
        wanted = measured(given, F.octet_length("word"))
        if self.table is not None:
            return self.table.join(wanted, "word", "left_semi")
        buckets = [r.bucket for r in given.select(_bucket(F.col("word"), self.buckets).alias("bucket")).distinct().collect()]
        rows = self._read("words", WORDS).where(F.col("bucket").isin(buckets)).join(wanted, "word", "left_semi")
        return self._current(rows).select("dataset_name", "word", "cnt")

    def top_words(self, k: int = KEPT) -> DataFrame:
        """dataset_name, top_words; beyond KEPT they come from all counts."""
        if self.table is not None or k > KEPT:
            return top_word_lists(self.counts(), k)
        return self._current(self._read("top", TOP)).select("dataset_name", F.slice("top_words", 1, k).alias("top_words"))
