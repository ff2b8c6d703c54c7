"""The engine's queries over the test tables, each with the same in DuckDB's SQL.

`documents` grouped by source is the usual collection; "tables" are the text
columns of seven tables as seven datasets; "meta" takes each document as a
catalog entry with title `lang source` and its text as description."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.text import content_normalize, has_no_digit, long_enough, normalize, tokens
from tablescout.operators.collection import Collection, Dataset, spread
from tablescout.operators.index import ContentIndex
from tablescout.operators.results import display_lines, no_result_message, positive_count
from tablescout.operators.search import keyword_search, report
from tablescout.operators.words import content_index, content_tokens, count_words, metadata_counts, top_words
from tablescout.plans.query import DiscoveryEngine, parse_frame
from tablescout.sources.files import dataset_name, is_dataset_file, load_collection, load_dataset, load_folder, save_dataset
from tablescout.sources.scratch import scratch, stored
from tablescout.sources.tables import load_tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events"]
TEXT = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"],
}
QUERY = "the der that"
MESSAGES = "semantic:the,foo:x,semantic:der that,vector:erosion"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def sources(spark: SparkSession, sf: str) -> Collection:
    return Collection.grouped(read(spark, sf, "documents"), "source", ["text"])


def tables(spark: SparkSession, sf: str) -> Collection:
    return Collection.of(spark, [Dataset(t, read(spark, sf, t)) for t in TABLES])


def meta(spark: SparkSession, sf: str, only_even: bool = False) -> Collection:
    docs = spread(read(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    has = (F.col("doc_id") % 2 == 0) if only_even else F.lit(True)
    catalog = docs.select(F.col("doc_id").cast("string").alias("dataset_name"), F.col("doc_id").alias("ord"), has.alias("has_metadata"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("description"), F.lit(None).cast("string").alias("raw_metadata"))
    return Collection(catalog, docs.select(F.col("doc_id").cast("string").alias("dataset_name"), F.col("text").alias("cell")))


def _search(make: Callable, query: str, in_metadata: bool = False) -> Callable:
    return lambda spark, sf: keyword_search(make(spark, sf), query, in_metadata, top=False).select("dataset_name", "score", "rank")


def _catalog_tables(spark, sf):
    collection = Collection.of(spark, [Dataset(t, read(spark, sf, t)) for t in TABLES])
    rows = None
    for t in TABLES:
        n = read(spark, sf, t).agg(F.count("*").alias("n_rows")).withColumn("dataset_name", F.lit(t))
        rows = n if rows is None else rows.unionByName(n)
    return collection.catalog.join(rows, "dataset_name").select("dataset_name", "ord", "n_rows")


def _normalized(how):
    return lambda spark, sf: read(spark, sf, "documents").select("doc_id", how(F.col("text")).alias("norm"))


def _unfiltered(spark, sf):
    docs = spread(read(spark, sf, "documents").select("source", "text"))
    return count_words(docs.select(F.col("source").alias("dataset_name"), F.explode(tokens(normalize(F.col("text")))).alias("word")))


def _filtered(keep):
    """Words of all documents that one of the content filters keeps."""

    def run(spark, sf):
        docs = spread(read(spark, sf, "documents").select("text"))
        words = docs.select(F.explode(tokens(content_normalize(F.col("text")))).alias("word"))
        return words.where(keep(F.col("word"))).groupBy("word").agg(F.count("*").alias("cnt"))

    return run


def _metadata_counts(spark, sf):
    return metadata_counts(meta(spark, sf).catalog)


def _results_frame(spark, sf):
    found = keyword_search(sources(spark, sf), QUERY)
    return found.select("dataset_name", "score", "rank", "used_metadata", "metadata", F.size("top_words").cast("long").alias("n_top_words"), F.concat_ws(",", F.transform("top_words", lambda x: F.concat_ws(":", x["word"], x["cnt"]))).alias("top_words"))


def _multi(spark, sf):
    out = None
    for r in DiscoveryEngine(sources(spark, sf)).run(MESSAGES):
        if r.known and r.operation.name == "semantic":
            part = r.frame.select(F.lit(r.operation.op_idx).cast("long").alias("op_idx"), "dataset_name", "score")
            out = part if out is None else out.unionByName(part)
    return out


def _messages(spark, sf):
    out = None
    for r in DiscoveryEngine(sources(spark, sf)).run("semantic:zzzz,vector:erosion,foo:x,query_by_example:a,,cause_and_consequences:b"):
        if r.messages is not None:
            part = r.messages.select(F.lit(r.operation.op_idx).cast("long").alias("op_idx"), "message")
            out = part if out is None else out.unionByName(part)
    return out


def _operations(spark, sf):
    """Query strings of real words, one a document: its text cut at commas and
    colons names operations no better than chance, what is put before it does."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(F.col("doc_id").alias("q_id"), F.concat(F.lit("semantic:"), "source", F.lit(",vector,"), "lang", F.lit(":"), "text").alias("q"))


def _parse(spark, sf):
    return parse_frame(_operations(spark, sf), "q").select("q_id", F.col("op_idx").cast("long").alias("op_idx"), "raw_operation", "op_name", "arg", F.col("n_args").cast("long").alias("n_args"))


def _dispatch(spark, sf):
    known = list(DiscoveryEngine(Collection.of(spark, [])).registry)
    return _parse(spark, sf).select("q_id", "op_idx", "op_name", F.col("op_name").isin(known).alias("known"))


def _metadata_examples(spark, sf):
    """Document rows as JSON metadata, parsed again."""
    text = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_name"), F.to_json(F.struct(F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("description"))).alias("raw"))
    parsed = text.select("dataset_name", F.from_json("raw", "title string, description string").alias("m"))
    return parsed.select("dataset_name", "m.title", F.char_length("m.description").cast("long").alias("description_chars"))


CSV_CELLS = ["True", "None", "NULL", "3.5", "2020-01-01", "snake_case", "ouréaux", "n/a", "quoted, cell", "nan", "House prices", "line one\nline two", 'say "this"']
CSV_TABLES = ["region", "nation", "supplier", "events"]
TITLES = {"cells": "Odd cells", "region": "Regions of the world", "nation": "Nations by region", "supplier": "Supplier names", "events": "Event stream 2024"}


def _described(name: str) -> dict[str, str]:
    return {"title": TITLES[name], "description": f"Table {name} of the test data"}


def _folder(spark: SparkSession, sf: str, without: tuple[str, ...] = ()) -> str:
    """Tables as CSV files with metadata beside them, in a scratch folder."""
    folder = scratch(spark, "folder")
    save_dataset(folder, "cells", spark.createDataFrame([(c, i) for i, c in enumerate(CSV_CELLS)], "cell string, n int"), _described("cells"))
    for t in CSV_TABLES:
        save_dataset(folder, t, read(spark, sf, t).select(*TEXT[t]), None if t in without else _described(t))
    return folder


def _csv_source(spark, sf):
    """Word counts of a folder of files."""
    return content_index(load_collection(spark, _folder(spark, sf)))


def _csv_documents(spark, sf):
    """Words of all texts, line breaks and quotes inside the cells, written as one CSV and read back by many tasks."""
    folder = scratch(spark, "folder")
    save_dataset(folder, "documents", read(spark, sf, "documents").select("lang", "text", "source"))
    return content_index(load_collection(spark, folder, include_metadata=False))


def _table_folder(spark, sf):
    """Searches all tables of the test data as they lie in their folder."""
    return keyword_search(load_tables(spark, sf), "the furniture urgent der", top=False).select("dataset_name", "score", "rank")


def _csv_search(in_metadata: bool, query: str):
    def run(spark, sf):
        collection = Collection.of(spark, load_folder(spark, _folder(spark, sf)).values())
        return keyword_search(collection, query, in_metadata, top=False).select("dataset_name", "score", "rank", "used_metadata", "metadata")

    return run


def _csv_metadata(spark, sf):
    """Metadata files as they are read, and files without them."""
    folder = _folder(spark, sf, without=("events",))
    rows = []
    for required in (True, False):
        for name in ["cells", *CSV_TABLES, "missing"]:
            try:
                meta = load_dataset(spark, folder, name, required).metadata
                rows.append((required, name, (meta or {}).get("title"), (meta or {}).get("description"), None))
            except FileNotFoundError as e:
                rows.append((required, name, None, None, str(e).replace(folder, "folder")))
    return spark.createDataFrame(rows, "required boolean, dataset_name string, title string, description string, error string")


def _empty_argument(spark, sf):
    (r,) = DiscoveryEngine(sources(spark, sf)).run("semantic:")
    return r.frame.select("dataset_name", "score", "rank").crossJoin(F.broadcast(r.messages))  # one message


def _no_argument(spark, sf):
    out = None
    for r in DiscoveryEngine(sources(spark, sf)).run("vector,cause_and_consequences,query_by_example"):
        part = r.messages.select(F.lit(r.operation.op_idx).cast("long").alias("op_idx"), "message")
        out = part if out is None else out.unionByName(part)
    return out


#: Endings of file names, dealt to pages by their ids.
ENDINGS = [".csv", "_metadata.csv", "_metadata.json", ".CSV", ".csv.gz", ".g.csv", "csv", " metadata.csv"]


def _file_names(spark, sf):
    """Which of the files that are named after pages are datasets, and how these are called."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    name = F.concat(F.regexp_replace("url", r"\W+", "-"), ending)
    files = read(spark, sf, "pages").select("page_id", name.alias("file"))
    return files.where(is_dataset_file(F.col("file"))).select("page_id", dataset_name(F.col("file")).alias("dataset_name"))


def _with_data(how: str):
    """Searches the tables before and after one of them is given the rows of
    another: from the cells, and from an index in which only that one is counted again."""

    def run(spark, sf):
        query = "furniture urgent click asia pending"
        given = {t: Dataset(t, read(spark, sf, t)) for t in TABLES}
        before = Collection.of(spark, given.values())
        changed = given["nation"].with_data(read(spark, sf, "region"))
        after = Collection.of(spark, [changed if d.id == changed.id else d for d in given.values()])
        built = ContentIndex.build(before, scratch(spark, "index")) if how == "index" else None
        parts = []
        for step, collection, index in (("before", before, built), ("after", after, built.replaced([changed]) if built else None)):
            found = keyword_search(collection, query, top=how == "index", index=index)
            words = F.concat_ws(",", F.transform("top_words", lambda x: F.concat_ws(":", x["word"], x["cnt"])))
            parts.append(found.select(F.lit(step).alias("step"), "dataset_name", "score", "rank", *([F.when(F.size("top_words") > 0, words).alias("top_words")] if how == "index" else [])))
        return parts[0].unionByName(parts[1])

    return run


def _messages_metadata(spark, sf):
    """Several searches in metadata: one scan of the catalog and one of the cells answers all."""
    engine = DiscoveryEngine(meta(spark, sf, True))
    out = None
    for r in engine.run("semantic:en of the,vector:x,semantic:die der,semantic:zzzz", True):
        if r.operation.name == "semantic":
            part = r.frame.select(F.lit(r.operation.op_idx).cast("long").alias("op_idx"), "dataset_name", "score", "rank", "used_metadata")
            out = part if out is None else out.unionByName(part)
    return out


def _index_counts(spark, sf):
    """Counts of some words from the buckets of an index that has been replaced, cut down and packed."""
    docs = read(spark, sf, "documents")
    of = lambda rule: Collection.grouped(docs.where(rule), "source", ["text"])
    index = ContentIndex.build(of("lang <> 'de'"), scratch(spark, "index"), buckets=16)
    some = [r.source for r in docs.select("source").distinct().orderBy("source").limit(3).collect()]
    index = index.replaced(Dataset(s, docs.where((F.col("lang") == "de") & (F.col("source") == s)).select("text")) for s in some[:2]).removed(some[2:])
    return ContentIndex.open(spark, index.compact(scratch(spark, "index")).path, buckets=16).counts(["the der la", "und"])


def _shown(repeat: bool):
    def run(spark, sf):
        query = "furniture urgent click"
        return display_lines(stored(keyword_search(tables(spark, sf), query), "results"), query, repeat)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "catalog_tables": _catalog_tables,
        "normalize_text": _normalized(normalize),
        "normalize_content": _normalized(content_normalize),
        "tokenize_unfiltered": _unfiltered,
        "metadata_word_counts": _metadata_counts,
        "content_word_counts": lambda s, d: content_index(sources(s, d)),
        "content_word_counts_tables": lambda s, d: content_index(tables(s, d)),
        "filter_short_words": _filtered(long_enough),
        "filter_digit_words": _filtered(has_no_digit),
        "filter_nan_words": _filtered(lambda w: w != "nan"),
        "top_words_sources": lambda s, d: top_words(content_index(sources(s, d))).withColumn("rk", F.col("rk").cast("long")),
        "top_words_tables": lambda s, d: top_words(content_index(tables(s, d))).withColumn("rk", F.col("rk").cast("long")),
        "search_content_one": _search(sources, "the"),
        "search_content_multi": _search(sources, QUERY),
        "search_content_repeated": _search(sources, "the the der"),
        "search_content_tables": _search(tables, "furniture urgent click"),
        "search_content_short_and_digit": _search(sources, "of 1 the"),
        "search_content_none": _search(sources, "zzzz"),
        "search_metadata": _search(meta, "en the", True),
        "search_metadata_digit": _search(meta, "src1", True),
        "search_metadata_fallback": lambda s, d: keyword_search(meta(s, d, True), "en of the", True).select("dataset_name", "score", "rank", "used_metadata"),
        "search_results_frame": _results_frame,
        "positive_count": lambda s, d: positive_count(keyword_search(tables(s, d), "furniture urgent click", top=False)),
        "display_lines": _shown(False),
        "display_lines_repeated": _shown(True),
        "no_result_message": lambda s, d: no_result_message(keyword_search(sources(s, d), "zzzz", top=False), "zzzz"),
        "parse_operations": _parse,
        "dispatch_operations": _dispatch,
        "vector_placeholder": lambda s, d: report(sources(s, d), "vector", "erosion"),
        "cause_placeholder": lambda s, d: report(sources(s, d), "cause_and_consequences", "erosion"),
        "example_placeholder": lambda s, d: report(sources(s, d), "query_by_example", "erosion"),
        "multi_operation": _multi,
        "operation_messages": _messages,
        "metadata_examples": _metadata_examples,
        "csv_source": _csv_source,
        "csv_documents": _csv_documents,
        "tables_of_a_folder": _table_folder,
        "csv_search_content": _csv_search(False, "furniture click algeria asia"),
        "csv_search_metadata": _csv_search(True, "region of 2024 of"),
        "csv_metadata": _csv_metadata,
        "csv_file_names": _file_names,
        "dataset_objects": _with_data("cells"),
        "index_with_data": _with_data("index"),
        "index_counts": _index_counts,
        "multi_operation_metadata": _messages_metadata,
        "empty_argument": _empty_argument,
        "reports_without_argument": _no_argument,
    }


# ---------------------------------------------------------------- SQL


def _norm(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _tok(cells: str, how: str, keep: str = "word <> ''") -> str:
    """cells: SQL with dataset_name, cell."""
    return f"SELECT dataset_name, word FROM (SELECT dataset_name, unnest(string_split(trim({how}), ' ')) AS word FROM ({cells}) WHERE cell IS NOT NULL) WHERE {keep}"


CONTENT = "word <> 'nan' AND word <> '' AND length(word) > 2 AND NOT regexp_matches(word, '\\p{Nd}')"
SOURCES = "SELECT source AS dataset_name, text AS cell FROM documents"
ALL_TABLES = " UNION ALL ".join(f"SELECT '{t}' AS dataset_name, {c} AS cell FROM {t}" for t, cs in TEXT.items() for c in cs)
TABLE_CATALOG = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TABLES)) + ") AS v(dataset_name, ord)"
SOURCE_CATALOG = "SELECT DISTINCT source AS dataset_name, source AS ord FROM documents"
DOC_CATALOG = "SELECT CAST(doc_id AS VARCHAR) AS dataset_name, doc_id AS ord FROM documents"
META = "SELECT CAST(doc_id AS VARCHAR) AS dataset_name, lang || ' ' || source || ' ' || text AS cell FROM documents"


def _content(cells: str) -> str:
    return _tok(cells, _norm("lower(cell)"), CONTENT)


def _counts(words: str) -> str:
    return f"SELECT dataset_name, word, count(*) AS cnt FROM ({words}) GROUP BY ALL"


def _top(cells: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY cnt DESC, word) AS rk FROM ({_counts(_content(cells))})) WHERE rk <= 10"


def _scored(catalog: str, words: str, query: list[str]) -> str:
    values = ", ".join(f"('{w}')" for w in query)
    return f"SELECT c.dataset_name, c.ord, CAST(coalesce(s.score, 0) AS BIGINT) AS score, row_number() OVER (ORDER BY coalesce(s.score, 0) DESC, c.ord) AS rank FROM ({catalog}) c LEFT JOIN (SELECT w.dataset_name, count(*) AS score FROM ({words}) w JOIN (VALUES {values}) AS q(word) ON w.word = q.word GROUP BY 1) s ON c.dataset_name = s.dataset_name"


def _found(catalog: str, words: str, query: str) -> str:
    return f"SELECT dataset_name, score, rank FROM ({_scored(catalog, words, query.split())})"


def _report(text: str) -> str:
    return f"SELECT '{text}' || CAST(count(*) AS VARCHAR) AS message, count(*) AS n_datasets FROM ({SOURCE_CATALOG})"


def _lines(repeat: bool) -> str:
    query = "furniture urgent click"
    copies = "unnest(generate_series(1, (SELECT count(*) FROM s WHERE score > 0)))" if repeat else "1"
    quiet = "WHERE EXISTS (SELECT 1 FROM s WHERE score > 0)"
    return f"""WITH s AS ({_scored(TABLE_CATALOG, _content(ALL_TABLES), query.split())}), t AS ({_top(ALL_TABLES)}),
 l AS (SELECT 0 AS rank, 0 AS pos, 0 AS rk, '------------ Search Results ------------' AS line
 UNION ALL SELECT rank, 1, 0, 'Dataset: ' || dataset_name || ' for search query: ''{query}''' FROM s
 UNION ALL SELECT rank, 2, 0, 'Score: ' || CAST(score AS VARCHAR) FROM s
 UNION ALL SELECT rank, 3, 0, 'Top Words:' FROM s WHERE dataset_name IN (SELECT dataset_name FROM t)
 UNION ALL SELECT s.rank, 4, t.rk, '  ' || t.word || ': ' || CAST(t.cnt AS VARCHAR) FROM s JOIN t ON s.dataset_name = t.dataset_name
 UNION ALL SELECT rank, 5, 0, repeat('-', 40) FROM s)
 SELECT row_number() OVER (ORDER BY nth, rank, pos, rk) AS line_no, line FROM (SELECT *, {copies} AS nth FROM l {quiet})"""


def _parsed() -> str:
    asked = "SELECT doc_id AS q_id, string_split('semantic:' || source || ',vector,' || lang || ':' || text, ',') AS ops FROM documents"
    ops = f"SELECT q_id, unnest(ops) AS raw_operation, generate_subscripts(ops, 1) - 1 AS op_idx FROM ({asked})"
    return f"SELECT CAST(q_id AS BIGINT) AS q_id, CAST(op_idx AS BIGINT) AS op_idx, raw_operation, string_split(raw_operation, ':')[1] AS op_name, string_split(raw_operation, ':')[2] AS arg, CAST(len(string_split(raw_operation, ':')) - 1 AS BIGINT) AS n_args FROM ({ops})"


#: Text columns of all tables.
ALL_TEXT = TEXT | {
    "events": ["event_type", "props"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "documents": ["text", "lang", "source"],
    "embeddings": [], "pages": ["url", "html"], "benchmark": ["text"], "labels": [], "conversations": ["role", "text"],
}
FOLDER = " UNION ALL ".join(f"SELECT '{t}' AS dataset_name, {c} AS cell FROM {t}" for t, cs in ALL_TEXT.items() for c in cs)
FOLDER_CATALOG = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(sorted(ALL_TEXT))) + ") AS v(dataset_name, ord)"
#: Cells of the files: missing-value literals are no cells, a boolean is its text.
CSV_TEXT = " UNION ALL ".join([f"SELECT '{t}' AS dataset_name, {c} AS cell FROM {t}" for t in CSV_TABLES for c in TEXT[t]] + ["SELECT 'cells', '" + c.replace("'", "''") + "'" for c in CSV_CELLS if c not in ("None", "NULL", "n/a", "nan")])
KNOWN = "('semantic', 'vector', 'cause_and_consequences', 'query_by_example')"


def _kept(rule: str) -> str:
    return f"SELECT word, count(*) AS cnt FROM ({_tok(SOURCES, _norm('lower(cell)'), "word <> '' AND " + rule)}) GROUP BY 1"


def _csv_names() -> list[str]:
    return sorted(["cells", *CSV_TABLES])


def _csv_catalog() -> str:
    rows = ", ".join(f"""('{n}', {i}, '{json.dumps(_described(n))}')""" for i, n in enumerate(_csv_names()))
    return f"SELECT * FROM (VALUES {rows}) AS v(dataset_name, ord, metadata)"


def _csv_described() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS dataset_name, '{_described(n)['title']} {_described(n)['description']}' AS cell" for n in _csv_names())


def _csv_errors() -> str:
    rows = []
    for required in ("true", "false"):
        for n in ["cells", *CSV_TABLES, "missing"]:
            error = f"'Dataset file folder/{n}.csv not found.'" if n == "missing" else f"'Metadata file folder/{n}_metadata.json not found.'" if n == "events" and required == "true" else "NULL"
            known = required == "true" and error == "NULL"
            rows.append(f"({required}, '{n}', " + (f"'{_described(n)['title']}', '{_described(n)['description']}'" if known else "NULL, NULL") + f", {error})")
    return f"SELECT required, dataset_name, CAST(title AS VARCHAR) AS title, CAST(description AS VARCHAR) AS description, CAST(error AS VARCHAR) AS error FROM (VALUES {', '.join(rows)}) AS v(required, dataset_name, title, description, error)"


def _unargued() -> str:
    given = "[''vector'', ''cause_and_consequences'', ''query_by_example'']"
    said = ["cause and consequences", "cause and consequences", "query by example"]
    rows = ", ".join(f"({i}, 'Performing {x} search for: ''{given}'' in dataset of size: ')" for i, x in enumerate(said))
    return f"SELECT CAST(op_idx AS BIGINT) AS op_idx, message || CAST(n AS VARCHAR) AS message FROM (VALUES {rows}) AS v(op_idx, message), (SELECT count(DISTINCT source) AS n FROM documents)"


def _replaced(top: bool) -> str:
    query = "furniture urgent click asia pending".split()
    after = ALL_TABLES.replace("'nation' AS dataset_name, n_name AS cell FROM nation", "'nation' AS dataset_name, r_name AS cell FROM region")
    parts = []
    for step, cells in (("before", ALL_TABLES), ("after", after)):
        words = f"LEFT JOIN (SELECT dataset_name, string_agg(word || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY rk) AS words FROM ({_top(cells)}) GROUP BY 1) t ON s.dataset_name = t.dataset_name" if top else ""
        parts.append(f"SELECT '{step}' AS step, s.dataset_name, score, rank{', t.words AS top_words' if top else ''} FROM ({_scored(TABLE_CATALOG, _content(cells), query)}) s {words}")
    return " UNION ALL ".join(parts)


def _file_named() -> str:
    ends = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"
    files = f"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]+', '-', 'g') || {ends}[page_id % {len(ENDINGS)} + 1] AS f FROM pages"
    return f"SELECT page_id, left(f, length(f) - 4) AS dataset_name FROM ({files}) WHERE suffix(f, '.csv') AND NOT suffix(f, '_metadata.csv')"


def _some_counts() -> str:
    cells = """SELECT source AS dataset_name, text AS cell FROM documents JOIN (SELECT source AS s, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM documents)) ON source = s
 WHERE n <= 2 AND lang = 'de' OR n > 3 AND lang <> 'de'"""
    return f"SELECT * FROM ({_counts(_content(cells))}) WHERE word IN ('the', 'der', 'la', 'und')"


def oracle_sql() -> dict[str, str]:
    fallback = f"{_tok(META + ' WHERE doc_id % 2 = 0', _norm('cell'))} UNION ALL {_content('SELECT CAST(doc_id AS VARCHAR) AS dataset_name, text AS cell FROM documents WHERE doc_id % 2 <> 0')}"
    cause = "Performing cause and consequences search for: ''erosion'' in dataset of size: "
    n_sources = "CAST((SELECT count(DISTINCT source) FROM documents) AS VARCHAR)"
    return {
        "catalog_tables": " UNION ALL ".join(f"SELECT '{t}' AS dataset_name, CAST({i} AS BIGINT) AS ord, count(*) AS n_rows FROM {t}" for i, t in enumerate(TABLES)),
        "normalize_text": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
        "normalize_content": f"SELECT doc_id, {_norm('lower(text)')} AS norm FROM documents",
        "tokenize_unfiltered": _counts(_tok(SOURCES, _norm("cell"))),
        "metadata_word_counts": f"SELECT word, count(*) AS cnt, count(DISTINCT dataset_name) AS n_datasets FROM ({_tok(META, _norm('cell'))}) GROUP BY 1",
        "content_word_counts": _counts(_content(SOURCES)),
        "content_word_counts_tables": _counts(_content(ALL_TABLES)),
        "filter_short_words": _kept("length(word) > 2"),
        "filter_digit_words": _kept("NOT regexp_matches(word, '\\p{Nd}')"),
        "filter_nan_words": _kept("word <> 'nan'"),
        "top_words_sources": _top(SOURCES),
        "top_words_tables": _top(ALL_TABLES),
        "search_content_one": _found(SOURCE_CATALOG, _content(SOURCES), "the"),
        "search_content_multi": _found(SOURCE_CATALOG, _content(SOURCES), QUERY),
        "search_content_repeated": _found(SOURCE_CATALOG, _content(SOURCES), "the the der"),
        "search_content_tables": _found(TABLE_CATALOG, _content(ALL_TABLES), "furniture urgent click"),
        "search_content_short_and_digit": _found(SOURCE_CATALOG, _content(SOURCES), "of 1 the"),
        "search_content_none": _found(SOURCE_CATALOG, _content(SOURCES), "zzzz"),
        "search_metadata": _found(DOC_CATALOG, _tok(META, _norm("cell")), "en the"),
        "search_metadata_digit": _found(DOC_CATALOG, _tok(META, _norm("cell")), "src1"),
        "search_metadata_fallback": f"SELECT dataset_name, score, rank, ord % 2 = 0 AS used_metadata FROM ({_scored(DOC_CATALOG, fallback, ['en', 'of', 'the'])})",
        "search_results_frame": f"SELECT s.dataset_name, score, rank, false AS used_metadata, CAST(NULL AS VARCHAR) AS metadata, t.n AS n_top_words, t.words AS top_words FROM ({_scored(SOURCE_CATALOG, _content(SOURCES), QUERY.split())}) s LEFT JOIN (SELECT dataset_name, count(*) AS n, string_agg(word || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY rk) AS words FROM ({_top(SOURCES)}) GROUP BY 1) t ON s.dataset_name = t.dataset_name",
        "positive_count": f"SELECT count(*) FILTER (score > 0) > 0 AS any_positive, count(*) FILTER (score > 0) AS n_positive FROM ({_scored(TABLE_CATALOG, _content(ALL_TABLES), 'furniture urgent click'.split())})",
        "display_lines": _lines(False),
        "display_lines_repeated": _lines(True),
        "no_result_message": f"SELECT 'No results found for search query: ''zzzz''' AS message FROM ({_scored(SOURCE_CATALOG, _content(SOURCES), ['zzzz'])}) HAVING coalesce(max(score), 0) <= 0",
        "parse_operations": _parsed(),
        "dispatch_operations": f"SELECT q_id, op_idx, op_name, op_name IN {KNOWN} AS known FROM ({_parsed()})",
        "vector_placeholder": _report(cause),
        "cause_placeholder": _report(cause),
        "example_placeholder": _report("Performing query by example search for: ''erosion'' in dataset of size: "),
        "multi_operation": f"SELECT CAST(0 AS BIGINT) AS op_idx, dataset_name, score FROM ({_scored(SOURCE_CATALOG, _content(SOURCES), ['the'])}) UNION ALL SELECT 2, dataset_name, score FROM ({_scored(SOURCE_CATALOG, _content(SOURCES), ['der', 'that'])})",
        "operation_messages": f"SELECT CAST(op_idx AS BIGINT) AS op_idx, message FROM (VALUES (0, 'No results found for search query: ''zzzz'''), (1, '{cause}' || {n_sources}), (2, 'Unknown operation: foo'), (3, 'Performing query by example search for: ''a'' in dataset of size: ' || {n_sources}), (4, 'Unknown operation: '), (5, 'Performing cause and consequences search for: ''b'' in dataset of size: ' || {n_sources})) AS v(op_idx, message)",
        "metadata_examples": "SELECT CAST(doc_id AS VARCHAR) AS dataset_name, lang || ' ' || source AS title, length(text) AS description_chars FROM documents",
        "csv_source": _counts(_content(CSV_TEXT)),
        "csv_documents": _counts(_content("SELECT 'documents' AS dataset_name, unnest([lang, text, source]) AS cell FROM documents")),
        "tables_of_a_folder": _found(FOLDER_CATALOG, _content(FOLDER), "the furniture urgent der"),
        "csv_search_content": f"SELECT dataset_name, score, rank, false AS used_metadata, CAST(NULL AS VARCHAR) AS metadata FROM ({_scored(_csv_catalog(), _content(CSV_TEXT), 'furniture click algeria asia'.split())})",
        "csv_search_metadata": f"SELECT s.dataset_name, score, rank, true AS used_metadata, m.metadata FROM ({_scored(_csv_catalog(), _tok(_csv_described(), _norm('cell')), 'region of 2024 of'.split())}) s JOIN ({_csv_catalog()}) m ON s.dataset_name = m.dataset_name",
        "csv_metadata": _csv_errors(),
        "csv_file_names": _file_named(),
        "dataset_objects": _replaced(False),
        "index_with_data": _replaced(True),
        "index_counts": _some_counts(),
        "multi_operation_metadata": " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS op_idx, dataset_name, score, rank, ord % 2 = 0 AS used_metadata FROM ({_scored(DOC_CATALOG, fallback, q.split())})" for k, q in ((0, "en of the"), (2, "die der"), (3, "zzzz"))),
        "empty_argument": f"SELECT dataset_name, score, rank, 'No results found for search query: \'\'\'\'' AS message FROM ({_scored(SOURCE_CATALOG, _content(SOURCES), [''])})",
        "reports_without_argument": _unargued(),
    }
