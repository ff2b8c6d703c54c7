"""Text normalising and tokenising as Column expressions.

All of them are JVM built-ins, so they stay inside code generation.  Nulls stay
null in `normalize` and `content_normalize`; `tokens` of null is null, which
`explode` drops.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's plain \W is ASCII only and would cut accented words.
NON_WORD = r"[^\p{L}\p{N}_]+"
DIGIT = r"\p{Nd}"

#: Whole CSV cells that count as missing (pandas' default list).
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def normalize(text: Column) -> Column:
    """Runs of non-word characters become one space, then lower case."""
    return F.lower(F.regexp_replace(text, NON_WORD, " "))


def content_normalize(text: Column) -> Column:
    """Content is lower-cased before the same step; this differs for the few
    characters whose lower case expands to a letter and a combining mark."""
    return normalize(F.lower(text))


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; empty and blank texts have none."""
    return F.array_remove(F.split(F.trim(normalized), " "), "")  # a lambda would keep `explode` out of code generation


def words_of_content(text: Column) -> Column:
    """`tokens` of `content_normalize`, cut in one go: a text that was lower-cased stays as it is when that is done again."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def long_enough(word: Column) -> Column:
    return F.char_length(word) > 2


def has_no_digit(word: Column) -> Column:
    return ~word.rlike(DIGIT)


def is_content_word(word: Column) -> Column:
    """What counts in content: not `nan`, not empty, over two characters, no decimal digit.
    Metadata words and query words are not filtered."""
    return (word != "nan") & (word != "") & long_enough(word) & has_no_digit(word)


def csv_missing(cell: Column) -> Column:
    """A cell that stands for a missing value becomes null."""
    return F.when(~cell.isin(MISSING), cell)
