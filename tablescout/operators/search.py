"""Keyword search and the operators that only report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.text import is_content_word, normalize, tokens
from tablescout.operators.collection import Collection
from tablescout.operators.index import ContentIndex
from tablescout.operators.ordering import SLICE, numbered
from tablescout.operators.words import content_index, content_tokens, count_words, metadata_text, top_word_lists
from tablescout.sources.scratch import measured, stored

#: Up to this many characters the queries' words go to all executors; beyond, the joins shuffle.
BROADCAST_CHARS = 1 << 20
#: So many words are looked for in whole cells before these are cut into words.
SOUGHT = 16
RESULT = ["query", "dataset_name", "ord", "score", "rank", "used_metadata", "metadata", "top_words"]


def query_words(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """(query, word, qtf) of each query, by its place; words are not filtered and repeats count."""
    given = spark.createDataFrame(list(enumerate(queries)), "query int, q string")
    words = given.select("query", F.explode(tokens(normalize(F.col("q")))).alias("word"))
    return words.groupBy("query", "word").agg(F.count("*").alias("qtf"))


def scores(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, dataset_name, score: sum of count times repeats in the query."""
    found = counts.join(wanted, "word")
    return found.groupBy("query", "dataset_name").agg(F.sum(F.col("cnt") * F.col("qtf")).cast("long").alias("score"))


def metadata_scores(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, dataset_name, entry, score from one scan of the catalog: a row
    with the dataset's entry (and a null query) for each, and a row for each
    query that its metadata answers."""
    entry = F.struct("ord", "has_metadata", "raw_metadata")
    no_entry = F.lit(None).cast("struct<ord:bigint,has_metadata:boolean,raw_metadata:string>")
    words = F.when(F.col("has_metadata"), tokens(normalize(metadata_text()))).otherwise(F.array().cast("array<string>"))
    own = F.concat(F.lit("\0"), F.col("dataset_name"))  # no word of a query; unlike null, no key that all share
    rows = F.concat(F.array(F.struct(own.alias("word"), entry.alias("entry"))), F.transform(words, lambda w: F.struct(w.alias("word"), no_entry.alias("entry"))))
    tagged = catalog.select("dataset_name", F.explode(rows).alias("r")).select("dataset_name", "r.word", "r.entry")
    found = tagged.join(wanted, "word", "left").where("entry is not null or qtf is not null")
    return found.groupBy("query", "dataset_name").agg(F.first("entry", ignorenulls=True).alias("entry"), F.sum("qtf").cast("long").alias("score"))


def rank_datasets(scored: DataFrame, queries: int = 1) -> DataFrame:
    """Adds rank: score descending, ties in collection order.  scored: a written
    table with a row for each dataset; for several queries, each has a row for
    each dataset and ranks of its own."""
    order = [F.desc("score"), F.col("ord"), F.col("dataset_name")]
    if "query" not in scored.columns:
        return numbered(scored, *order, name="rank", each=SLICE)
    placed = numbered(scored, F.col("query"), *order, name="rank", each=SLICE)
    each = scored.count() // queries
    return placed.withColumn("rank", F.col("rank") - F.col("query") * F.lit(each))


def keyword_searches(collection: Collection, queries: Sequence[str], in_metadata: bool = False, k: int = 10, top: bool = True, index: DataFrame | ContentIndex | None = None) -> DataFrame:
    """`keyword_search` for several queries, with `query`, the place in the
    list: one scan of cells and one of the catalog, whatever their number.

    Scores are computed once, when this is called, and written, a row for each
    dataset and query; with top words, so are the counts they come from.  Up to
    SLICE rows come in the order of query and rank."""
    spark = collection.catalog.sparkSession
    wanted = query_words(spark, queries)
    wanted = F.broadcast(wanted) if sum(map(len, queries)) <= BROADCAST_CHARS else wanted
    words = wanted.select("word").distinct()
    want_top = top and not in_metadata

    def counted(cells: DataFrame) -> DataFrame:
        """Of the queries' words only: the semi-join stands below the count, so
        other words are never shuffled; cells that hold none are not cut."""
        some = [r.word for r in words.where(is_content_word(F.col("word"))).limit(SOUGHT + 1).collect()]
        if len(some) <= SOUGHT:
            lower = F.lower("cell")
            cells = cells.where(reduce(or_, [F.contains(lower, F.lit(w)) for w in some], F.lit(False)))
        return count_words(content_tokens(cells).join(words, "word", "left_semi"))

    index = ContentIndex.of(index) if index is not None else ContentIndex.of(stored(content_index(collection), "counts")) if want_top else None
    if in_metadata:
        known = stored(metadata_scores(collection.catalog, wanted), "catalog")
        base = known.where("query is null").select("dataset_name", "entry.ord", F.col("entry.has_metadata").alias("used_metadata"), F.col("entry.raw_metadata").alias("metadata"))
        found = known.where("query is not null").select("query", "dataset_name", "score")
        plain = base.where("not used_metadata").select("dataset_name")
        if plain.limit(1).count():
            plain = measured(plain, F.octet_length("dataset_name"))
            counts = index.counts(queries).join(plain, "dataset_name", "left_semi") if index else counted(collection.cells.join(plain, "dataset_name", "left_semi"))
            found = found.unionByName(scores(counts, wanted))
    else:
        base = collection.catalog.select("dataset_name", "ord", F.lit(False).alias("used_metadata"), F.lit(None).cast("string").alias("metadata"))
        found = scores(index.counts(queries) if index else counted(collection.cells), wanted)
    found = base.withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(len(queries) - 1)))).join(found, ["query", "dataset_name"], "left")
    found = found.withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    if want_top:
        found = found.join(index.top_words(k), "dataset_name", "left")
    else:
        found = found.withColumn("top_words", F.lit(None).cast("array<struct<word:string,cnt:bigint>>"))
    ranked = rank_datasets(stored(found, "scores"), len(queries))
    return ranked.select(RESULT)


def keyword_search(collection: Collection, query: str, in_metadata: bool = False, k: int = 10, top: bool = True, index: DataFrame | ContentIndex | None = None) -> DataFrame:
    """Every dataset with its score, best first.

    Content counts filtered words; metadata counts all words of title and
    description.  With in_metadata, a dataset without (or with empty) metadata
    is searched by content.  Returns dataset_name, ord, score, rank,
    used_metadata, metadata (JSON, metadata mode only) and top_words (content
    mode only).  top=False leaves top words out: then only the query's words
    are counted.  index: a `ContentIndex`, or a stored frame of `content_index`,
    to use instead of the cells.  An empty collection gives no rows; a dataset
    without text scores 0."""
    return keyword_searches(collection, [query], in_metadata, k, top, index).drop("query")


#: What the operators that only report say.  `vector` has the wording of `cause_and_consequences`.
REPORTS = {
    "vector": "Performing cause and consequences search for: '%s' in dataset of size: %s",
    "cause_and_consequences": "Performing cause and consequences search for: '%s' in dataset of size: %s",
    "query_by_example": "Performing query by example search for: '%s' in dataset of size: %s",
}


def report(collection: Collection, operation: str, query: str) -> DataFrame:
    """message, n_datasets: these operators don't search, they say what was asked of how many datasets."""
    size = collection.catalog.agg(F.count("*").alias("n_datasets"))
    return size.select(F.format_string(REPORTS[operation], F.lit(query), F.col("n_datasets")).alias("message"), "n_datasets")
