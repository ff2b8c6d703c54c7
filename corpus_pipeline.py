"""From documents to token ids in five stages; belongs to tablescout.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  Null and empty texts pass as
texts without evidence; repeated rows are treated alike until near-duplicates,
of which one row stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import bpe, decontaminate, linededup, neardup, toxicity
from tablescout.llm.common import arrow_rows, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that a Python worker is given at a time: whole texts, so few.
ROWS = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the string-kernel machine, learned from labelled rows, rejects
    go.  Null and empty texts have no evidence and stay; repeated rows are
    treated alike; without labels nothing goes."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines stay at their first place only; n_chars follows
    the text.  A row for each row; null texts stay null, texts whose chunks all
    go are empty."""
    kept = linededup.drop_repeated_chunks(docs, carry=["lang", "source"])
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that SimHash finds and that have a five-word
    Jaccard similarity of 0.8 or more, the smallest doc_id stays, one row of it.
    Texts without words (null, empty) are alike.  Rows without an id stay; rows
    of one id and different texts are texts of their own."""
    return neardup.one_of_each(docs, COLUMNS)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.  Null and empty texts contain
    none and stay; repeated rows are treated alike."""
    return decontaminate.without_items(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; a row for each row, null texts as empty ones.
    Written here, so that workers get ROWS texts at a time whoever writes the result."""
    with arrow_rows(spark, ROWS):
        return stored(bpe.encode(docs, with_decoded=False), "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_items),
    ("bpe_encoding", to_tokens),
]

#: Kernel machines, SimHash and BPE merges are beyond SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_rows(spark, ROWS):
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = docs if stage is to_tokens else stored(docs, name)
    return docs
