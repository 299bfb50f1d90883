"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, flac, htmltext, lines, passages, pieces, quality, secrets, simhash, warc
from weftline.llm._common import materialize, table


def op1(spark: SparkSession, d: str) -> DataFrame:
    return decontam.find(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup(spark, table(spark, d, "documents"), counts=True)


def op3(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(spark, table(spark, d, "documents"), table(spark, d, "labels"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    return flac.digest(materialize(spark, flac.to_media(table(spark, d, "documents")), "media"))


def op5(spark: SparkSession, d: str) -> DataFrame:
    return htmltext.main_text(spark, table(spark, d, "pages"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return warc.read_records(warc.write_archives(spark, table(spark, d, "pages")))


def op7(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(spark, table(spark, d, "documents").select("doc_id", "text"), pieces.read_model()).drop("text")


def op8(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(spark, table(spark, d, "documents"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    base = tuple(r for r in secrets.RULES if r.base)
    found, _ = secrets.scan_versions(spark, docs, (base, secrets.RULES))
    return secrets.findings_by_path(docs, found).drop("blob_id")


def op10(spark: SparkSession, d: str) -> DataFrame:
    return simhash.components(spark, table(spark, d, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1,
    "op2_line_dedup": op2,
    "op3_quality_classifier": op3,
    "op4_media_columns": op4,
    "op5_html_extraction": op5,
    "op6_warc": op6,
    "op7_sentencepiece": op7,
    "op8_substring_dedup": op8,
    "op9_secret_scans": op9,
    "op10_simhash": op10,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), docs AS (
  SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), items AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_at AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM item_at
), sizes AS (SELECT DISTINCT k FROM windows),
doc_at AS (
  SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, sizes WHERE len(w) >= k
), doc_windows AS (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s FROM doc_at),
hits AS (SELECT d.r, d.k, d.i, b.item_id FROM doc_windows d JOIN windows b ON d.s = b.s AND d.k = b.k),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items m USING (r)
""",
    "op9_secret_scans": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT r, 0 AS o, 'assign' AS kind, t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p, 1 AS part, 12 AS least FROM docs
  UNION ALL SELECT r, 1, 'access', t, 'AKIA[A-Z0-9]+', 0, 18 FROM docs
  UNION ALL SELECT r, 2, 'hex', t, '[0-9a-f]+', 0, 16 FROM docs
  UNION ALL SELECT r, 3, 'pem', t, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0 FROM docs
  UNION ALL SELECT r, 4, 'forge', t, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 0 FROM docs
), cut AS (
  SELECT r, o, kind, least, regexp_extract_all(t, p, 0) AS g, CASE part WHEN 1 THEN regexp_extract_all(t, p, 1) ELSE regexp_extract_all(t, p, 0) END AS v, string_split_regex(t, p) AS s FROM found WHERE regexp_matches(t, p)
), hit AS (
  SELECT r, o, kind, least, unnest(g) AS g, unnest(v) AS v, unnest(s[1 : len(g)]) AS s, unnest(range(len(g))) AS n FROM cut
), spans AS (
  SELECT r, o, kind, least, v, CAST(sum(length(s) + length(g)) OVER (PARTITION BY r, o ORDER BY n) AS BIGINT) AS e, length(g) AS len FROM hit
), shown AS (
  SELECT r, o, kind, e - len AS a, kind || ':' || CAST(e - len AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS x FROM spans WHERE length(v) >= least
), per AS (
  SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    coalesce(string_agg(x, ',' ORDER BY a, o) FILTER (o < 3), '') AS base, string_agg(x, ',' ORDER BY a, o) AS spans
  FROM shown GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)
""",
}
