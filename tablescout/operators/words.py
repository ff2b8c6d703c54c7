"""Word counts: the engine's index."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions.text import is_content_word, normalize, tokens, words_of_content
from tablescout.operators.collection import Collection
from tablescout.sources.scratch import measured, stored


def content_tokens(cells: DataFrame) -> DataFrame:
    """(dataset_name, word), a row for each content word.  Words never span
    cells, so each cell is cut on its own and no dataset becomes one string."""
    words = cells.select("dataset_name", F.explode(words_of_content(F.col("cell"))).alias("word"))
    return words.where(is_content_word(F.col("word")))


def metadata_text() -> Column:
    """Title and description of a catalog row."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))


def metadata_tokens(catalog: DataFrame) -> DataFrame:
    """(dataset_name, word) of title and description, unfiltered."""
    return catalog.where("has_metadata").select("dataset_name", F.explode(tokens(normalize(metadata_text()))).alias("word"))


def metadata_counts(catalog: DataFrame) -> DataFrame:
    """word, cnt, n_datasets: how often titles and descriptions hold a word, and
    those of how many datasets.  Where a dataset is one row, a word's first
    place in the row is counted, so that tasks sum before the shuffle; pairs of
    word and dataset are made only of names that several rows share, or none has."""
    described = catalog.where("has_metadata").select("dataset_name", metadata_text().alias("text"))
    shared = described.groupBy("dataset_name").agg(F.count("*").alias("n")).where("n > 1 or dataset_name is null").select(F.col("dataset_name").alias("shared"))
    shared = measured(stored(shared, "shared-names"), F.octet_length("shared"))
    same = F.col("dataset_name").eqNullSafe(F.col("shared"))
    # each word of a row beside the one before it in order
    words = F.sort_array(tokens(normalize(F.col("text"))))
    beside = described.join(shared, same, "left_anti").select(words.alias("words")).select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit("")), "words").alias("before"))))
    once = beside.where("word is not null").select("word", F.lit(1).alias("cnt"), (F.col("word") != F.col("before")).cast("long").alias("n_datasets"))
    pairs = count_words(described.join(shared, same, "left_semi").select("dataset_name", F.explode(tokens(normalize(F.col("text")))).alias("word")))
    several = pairs.select("word", "cnt", F.col("dataset_name").isNotNull().cast("long").alias("n_datasets"))
    return once.unionByName(several).groupBy("word").agg(F.sum("cnt").alias("cnt"), F.sum("n_datasets").alias("n_datasets"))


def count_words(words: DataFrame) -> DataFrame:
    """(dataset_name, word, cnt); summed on the map side, then one shuffle."""
    return words.groupBy("dataset_name", "word").agg(F.count("*").alias("cnt"))


def content_index(collection: Collection) -> DataFrame:
    """Persist or write this table when several searches follow."""
    return count_words(content_tokens(collection.cells))


def top_words(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent words of each dataset, ties by word: dataset_name,
    word, cnt, rk.  Spark keeps k rows a group before the shuffle."""
    order = Window.partitionBy("dataset_name").orderBy(F.desc("cnt"), "word")
    return counts.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def top_word_lists(counts: DataFrame, k: int = 10) -> DataFrame:
    """dataset_name, top_words array<struct<word, cnt>>, most frequent first."""
    rows = top_words(counts, k).groupBy("dataset_name").agg(F.array_sort(F.collect_list(F.struct("rk", "word", "cnt"))).alias("l"))
    return rows.select("dataset_name", F.transform("l", lambda x: F.struct(x["word"].alias("word"), x["cnt"].alias("cnt"))).alias("top_words"))
