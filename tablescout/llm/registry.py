"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescout.llm import bpe, decontaminate, divergence, infill, linededup, maintext, ngrams, simhash, substrings, suffixes, topk, toxicity, warc


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf, "pages"))


def op2_lines(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.drop_repeated_chunks(read(spark, sf, "documents"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf, "documents"))


def op4_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.score_texts(read(spark, sf, "documents"))


def op5_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.drop_repeated_bytes(read(spark, sf, "documents"), with_text=False)


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(read(spark, sf, "documents"), with_ids=False)


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read(spark, sf, "embeddings"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.drop_repeated_windows(read(spark, sf, "documents"), with_text=False)


def op11_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill.fill_in_middle(read(spark, sf, "documents"), with_output=False)


def op12_maintext(spark: SparkSession, sf: str) -> DataFrame:
    return maintext.extract(read(spark, sf, "pages"))


def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_lines": op2_lines,
        "op3_simhash": op3_simhash,
        "op4_ngrams": op4_ngrams,
        "op5_suffixes": op5_suffixes,
        "op6_bpe": op6_bpe,
        "op7_decontaminate": op7_decontaminate,
        "op8_topk": op8_topk,
        "op9_toxicity": op9_toxicity,
        "op10_substrings": op10_substrings,
        "op11_infill": op11_infill,
        "op12_maintext": op12_maintext,
        "op13_divergence": op13_divergence,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
 b AS (SELECT html, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
 CASE WHEN b.best IS NULL OR b.best = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN b.best <> p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS drawn, CAST('0x' || h[25:32] AS BIGINT) % 100 AS turn FROM d),
 f AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR drawn >= 50 THEN 'plain' WHEN turn < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM f
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS cnt FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
 v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM k GROUP BY lang),
 g AS (SELECT s.lang, s.source, coalesce(x.n, 0) AS n, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, source, sum(cnt) AS n FROM c GROUP BY ALL) x ON s.lang = x.lang AND s.source = x.source LEFT JOIN v ON s.lang = v.lang),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.cnt, 0) AS cnt, 1 + (1000000000 * (coalesce(c.cnt, 0) + 1)) // (g.n + g.v) AS p FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN (SELECT k.lang, k.term, 1 + (1000000000 * (k.total + 1)) // (v.n + v.v) AS q FROM k JOIN v ON k.lang = v.lang) q ON p.lang = q.lang AND p.term = q.term WHERE p.cnt > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op8_topk": OP8_SQL, "op11_infill": OP11_SQL, "op13_divergence": OP13_SQL}
