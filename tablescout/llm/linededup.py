"""Content-defined chunks of lines, deduplicated over the whole corpus.

A chunk ends after a line where a rolling hash over the hashes of WINDOW lines
is divisible by DIVISOR, but not before it has LEAST lines, so boundaries depend
on nearby lines alone and shift with them.  A text is cut CUTS times, each time
by other bits of the rolling hash, so that a short passage has more chances to
hold whole chunks.  Chunks of two lines or more whose hash is repeated anywhere
are grouped by their bytes; the lines of all but the first of a group go.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import sent, stored

WINDOW = 2
DIVISOR = 2
LEAST = 2
#: Cuts of a text, eight at most: each takes eight bits further on.
CUTS = 4
#: Tables of up to so many bytes are sent to all executors.
BROADCAST = 16 << 20


def _ranges(h: Column, window: int, divisor: int, least: int, cuts: int) -> Column:
    """array<struct<b, e>>: where chunks of two lines or more begin and end, of
    all cuts, each once.  h: the lines' hashes, a lambda variable."""
    n = F.size(h)
    rolled = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(h, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), F.lit(17).cast("long"), lambda a, x: F.xxhash64(a, x)))

    def cut(r: Column, k: int) -> Column:
        may = F.array_join(F.transform(r, lambda x: F.when(F.pmod(F.shiftrightunsigned(x, 8 * k), F.lit(divisor)) == 0, "1").otherwise("0")), "")
        # least - 1 lines, then up to the next line that may end a chunk, which is marked; a last 1 ends the last search
        marks = F.split(F.regexp_replace(F.concat(may, F.lit("1")), f"(.{{{least - 1}}}0*)1", "$1E"), "")
        ends = F.transform(F.array(marks), lambda m: F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(m, i - 1) == "E")))
        return F.transform(ends, lambda e: F.transform(e, lambda x, j: F.struct(F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1)).alias("b"), x.alias("e"))))[0]

    each = F.transform(F.array(rolled), lambda r: F.array_distinct(F.flatten(F.array(*[cut(r, k) for k in range(cuts)]))))[0]
    return F.filter(each, lambda c: c["e"] - c["b"] > 1)


def _chunks(text: Column, window: int, divisor: int, least: int, cuts: int) -> Column:
    """array<struct<b, e, body>>: chunks of two lines or more, lines joined by newlines."""
    # bound step by step as lambda variables: an expression inside a lambda is computed for each element
    hashed = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda y: F.xxhash64(y)).alias("h")))
    ranges = F.transform(hashed, lambda t: F.struct(t["lines"].alias("lines"), _ranges(t["h"], window, divisor, least, cuts).alias("ranges")))
    return F.transform(ranges, lambda t: F.transform(t["ranges"], lambda c: F.struct(c["b"].alias("b"), c["e"].alias("e"), F.array_join(F.slice(t["lines"], c["b"] + 1, c["e"] - c["b"]), "\n").alias("body"))))[0]


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST, cuts: int = CUTS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text (what stays, lines joined by newlines), n_lines, n_removed
    (chunks, which may overlap), n_removed_lines; a row for each row of docs.

    Of equal chunks of two lines or more, those but the one of the smallest
    (doc_id, first line) are repeats, and lines of a repeat go; chunks are
    judged on the input.  A line that goes has an equal one at an earlier place,
    so one of them stays.  Null texts stay null and have no lines; an empty text
    is one empty line.  A text whose lines all go is empty.  Rows that
    repeat a doc_id and a text are one place and are treated alike; a null id
    comes before all others.  An empty table gives no rows.  Columns named in
    carry come along as they are; others are not looked at.

    First only hashes are counted.  Bodies of repeated hashes are written and
    meet by their bytes; the written tables let Spark split a hot body's rows.
    Hashes, and places that go, are sent to all executors up to BROADCAST bytes
    as measured; beyond, the joins shuffle."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *(carry or [])).alias("carried"))
    keyed = given.select("doc_id", F.xxhash64("text").alias("version"), "text", "carried")
    cut = _chunks(F.col("text"), window, divisor, least, cuts)
    chunks = keyed.where("text is not null").select("doc_id", "version", F.explode(cut).alias("c")).select("doc_id", "version", "c.*").withColumn("h", F.xxhash64("body"))
    repeated = stored(chunks.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "line-hashes")
    again = stored(chunks.join(sent(repeated, 16, most=BROADCAST), "h", "left_semi"), "line-chunks")
    # by bytes: the first of each body
    at = F.struct(F.col("doc_id"), F.col("b"), F.col("version")).alias("at")
    first = again.select("h", "body", at).groupBy("h", "body").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "body", "first")
    first = stored(first, "line-firsts").select(F.col("h").alias("h2"), F.col("body").alias("body2"), "first")
    same = (F.col("h") == F.col("h2")) & (F.col("body") == F.col("body2"))
    gone = again.join(first, same).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("b") == F.col("first.b")) & (F.col("version") == F.col("first.version")))).select("doc_id", "version", "b", "e")
    lost = stored(gone.groupBy("doc_id", "version").agg(F.collect_set(F.struct("b", "e")).alias("lost")), "lines-lost")  # a document's own chunks
    lost = sent(lost.select(F.col("doc_id").alias("d2"), F.col("version").alias("v2"), "lost"), 32, F.size("lost") * 8, BROADCAST)
    joined = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("version") == F.col("v2")), "left")
    some = F.col("lost").isNotNull()
    lines = F.split("text", "\n", -1)
    # bound as lambda variables, so computed once a text; linear in its lines and chunks
    bound = F.transform(F.array(F.struct(lines.alias("lines"), "lost")), lambda t: F.struct(t["lines"].alias("lines"), F.array_distinct(F.flatten(F.transform(t["lost"], lambda c: F.sequence(c["b"], c["e"] - 1)))).alias("gone")))
    kept = F.transform(bound, lambda t: F.struct(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["gone"]), lambda k: F.get(t["lines"], k)), "\n").alias("text"), F.size(t["gone"]).alias("n")))[0]
    joined = joined.select("doc_id", "text", "carried", "lost", F.when(some, kept).alias("kept"), F.size(lines).alias("all_lines"))
    return joined.select(
        "doc_id",
        F.when(some, F.col("kept.text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("all_lines")).cast("long").alias("n_lines"),
        F.when(some, F.size("lost")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.col("kept.n")).otherwise(0).cast("long").alias("n_removed_lines"),
        *[F.col("carried").getField(c).alias(c) for c in carry or []],
    )
