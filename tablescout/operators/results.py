"""Results as frames, lines and messages."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators.ordering import running
from tablescout.sources.scratch import stored

#: How results are printed.
HEADER = "------------ Search Results ------------"
RULE = "-" * 40
NOTHING = "No results found for search query: '%s'"
UNKNOWN = "Unknown operation: %s"


def positive_count(results: DataFrame) -> DataFrame:
    """any_positive, n_positive: whether and for how many datasets a search found something."""
    n = F.count_if(F.col("score") > 0)
    return results.agg((n > 0).alias("any_positive"), n.alias("n_positive"))


def no_result_message(results: DataFrame, query: str) -> DataFrame:
    """One message if nothing scored or the query is empty, else no rows."""
    best = results.agg(F.coalesce(F.max("score"), F.lit(0)).alias("best"))
    return best.where((F.col("best") <= 0) | F.lit(query == "")).select(F.format_string(NOTHING, F.lit(query)).alias("message"))


def display_lines(results: DataFrame, query: str, repeat: bool = False) -> DataFrame:
    """line_no, line of the printed results; none if there is nothing to show.
    repeat: the whole block once for each dataset with a positive score.

    Blocks are written once, when this is called; a line's number is the sum of
    the lines before its block, its place in it and the lines of the copies before."""
    word_lines = F.transform("top_words", lambda x: F.format_string("  %s: %s", x["word"], x["cnt"]))
    words = F.when(F.size("top_words") > 0, F.concat(F.array(F.lit("Top Words:")), word_lines)).otherwise(F.array().cast("array<string>"))
    block = F.concat(
        F.when(F.col("rank") == 1, F.array(F.lit(HEADER))).otherwise(F.array().cast("array<string>")),
        F.array(F.format_string("Dataset: %s for search query: '%s'", "dataset_name", F.lit(query)), F.format_string("Score: %s", "score")),
        words,
        F.array(F.lit(RULE)),
    )
    blocks = stored(results.select("rank", "score", block.alias("block"), F.size(block).cast("long").alias("n")), "display")
    lines, positive = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("score") > 0)).first()
    times = 0 if query == "" else positive if repeat else min(positive, 1)
    shown = running(blocks, "rank", "n", "before").select("before", F.posexplode("block").alias("at", "line"))
    if times == 0:
        return shown.select(F.lit(0).cast("long").alias("line_no"), "line").limit(0)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("copy")
    shown = shown.select("before", "at", "line", copy)
    return shown.select((F.col("copy") * F.lit(lines) + F.col("before") + F.col("at") + 1).cast("long").alias("line_no"), "line")


def each_dict(results: DataFrame) -> Iterator[dict]:
    """The results, best first, one dict a dataset; a partition at a time comes to the driver."""
    for r in results.orderBy("rank").toLocalIterator():
        yield {"dataset_name": r.dataset_name, "score": r.score, "metadata": r.metadata, "top_words": None if r.top_words is None else {w.word: w.cnt for w in r.top_words}}


def to_dicts(results: DataFrame) -> list[dict]:
    """`each_dict` as a list."""
    return list(each_dict(results))
