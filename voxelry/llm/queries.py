"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extraction, language_id, line_dedup, merkle, mixing, ngram_join, pii, secret_scan, spelling, suffix_dedup, token_counts, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.html_extraction(_read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digest(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_read(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_read(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every run does the whole work."""
    docs = _read(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, token_counts.fresh_cache(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digest(_read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_read(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_html_extraction, op3_language_id, op4_suffix_dedup, op5_line_dedup, op6_pii, op7_exact_topk, op8_token_counts, op9_decontamination, op10_mixing, op11_merkle, op12_spelling, op13_secret_scan)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_html_extraction": HTML_EXTRACTION, "op3_language_id": LANGUAGE_ID, "op1_ngram_join": NGRAM_JOIN, "op4_suffix_dedup": SUFFIX_DEDUP, "op7_exact_topk": topk.ORACLE, "op5_line_dedup": LINE_DEDUP, "op9_decontamination": decontamination.ORACLE, "op10_mixing": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op12_spelling": spelling.ORACLE, "op13_secret_scan": secret_scan.ORACLE}


#: For pages whose main text is an article element of headings and paragraphs.
HTML_EXTRACTION = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>') AS parts FROM pages
), b AS (
  SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]+>', '', 'g')) AS parts FROM a
), c AS (
  SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS parts FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

#: Where no language has more documents than are drawn, so that all that aren't held out are learned from.
LANGUAGE_ID = r"""
WITH d AS (
  SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ' AS t,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)) + i)), 4294967295::BIGINT) % 3 = 1 AS held_out
  FROM documents
), c AS (
  SELECT doc_id, unnest(string_split(t, '')) AS a, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE length(t) > 2
), w AS (
  SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest([a, a || b, a || b || c]) AS g FROM w) WHERE g IS NOT NULL GROUP BY 1, 2
), own AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS i FROM g WHERE g <> ' ' QUALIFY i < 300
), p AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r
  FROM (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL AND g <> ' ' GROUP BY 1, 2) QUALIFY r < 300
), far AS (
  SELECT doc_id, l.lang, sum(coalesce(abs(i - r), 300)) AS far, 300 * count(*) AS most
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = own.g GROUP BY 1, 2
), best AS (
  SELECT doc_id, lang, 1 - far / most AS score FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1
)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)
"""

#: Every line with its verdict.
LINES = """
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), r AS (
  SELECT doc_id, pos, line, coalesce(top <> doc_id, false) AS dropped FROM k LEFT JOIN g USING (key)
)
"""

LINE_DEDUP = LINES + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), h AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM h JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 5 * h.n >= 4 * (p.n + q.n - h.n)
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links
FROM documents
"""

SUFFIX_DEDUP = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT doc_id, c + j AS i, md5(substr(y, 2 * j + 1, 800)) AS m FROM (
    SELECT doc_id, c, substr(x, 2 * c + 1, 998) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399, 100)) AS c FROM h WHERE length(x) >= 800)
  ), range(100) AS r(j) WHERE length(y) >= 2 * j + 800
), r AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, sum(CASE WHEN step > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r
), v AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, g
), k AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM v
), t AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""
