"""Queries of numbers in texts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators import figures


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _verified(texts: DataFrame) -> DataFrame:
    """Numbers up to 200 count as verified in their places."""
    return figures.pieces(texts, figures.NUMBER).where(F.col("match").cast("double") <= 200).select("id", "start", "end")


def open_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of numbers that nothing covers or excuses, with their places in their documents."""
    texts = _texts(spark, sf_dir)
    found = figures.judged(texts, _verified(texts)).where("open")
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "match")


def swept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those chains."""
    texts = _texts(spark, sf_dir)
    return figures.swept_texts(texts, _verified(texts)).select(F.col("id").alias("doc_id"), "text", "n_removed")


def restated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the first number, claimed with the eight characters before it (behind it, where it opens the text),
    is replaced by three times its number of digits, in every third document by a negative value, and removed in every
    third. One that is part of a longer number stays."""
    texts = _texts(spark, sf_dir)
    first = figures.whole_figures(texts).where("n = 0")
    around = F.when(F.col("before") == "", F.concat("match", F.left("after", F.lit(8)))).otherwise(F.concat(F.right("before", F.lit(8)), "match"))
    size = (3 * F.length("match")).cast("string")
    value = F.when(F.col("id") % 3 == 0, size).when(F.col("id") % 3 == 1, F.concat(F.lit("-"), size))
    claims = first.select("id", F.lit(0).alias("claim"), around.alias("said"), value.alias("value"))
    covered = F.array_join(F.transform("covered", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return figures.restated_texts(texts, claims).select(F.col("id").alias("doc_id"), "text", covered.alias("covered"))


_UNIT = rf"(?:(?:{'|'.join(C.PLAIN_UNITS)})(?:[^A-Za-z]|$)|%)"
_WORDS = ", ".join(f"'{w}'" for w in C.STRUCTURE_WORDS)


def _pieces(pattern: str) -> str:
    """A subquery of the pieces of every document with their running lengths."""
    return rf"""(SELECT *, CAST(sum(length(before) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS e, lead(before) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM
  (SELECT doc_id, generate_subscripts(b, 1) - 1 AS n, unnest(b) AS before, unnest(ms) AS m FROM
    (SELECT doc_id, string_split_regex(coalesce(text, ''), '(?i){pattern}') AS b, list_concat(regexp_extract_all(coalesce(text, ''), '(?i){pattern}'), [NULL]) AS ms FROM documents)))"""


#: A number is held against every range and chain of its text here, where the operator sweeps once over all of them.
_OPEN = rf"""c AS (SELECT *, e - coalesce(length(m), 0) AS s FROM {_pieces(figures.PHRASE)}), p AS (SELECT doc_id, e - length(m) AS s, e FROM {_pieces(figures.PLAIN)} WHERE m IS NOT NULL),
t AS (SELECT doc_id, e - length(m) AS s, e, CAST(m AS DOUBLE) <= 200 AS ok FROM {_pieces(figures.NUMBER)} WHERE m IS NOT NULL),
i AS (SELECT DISTINCT c.doc_id, c.n FROM c JOIN p ON c.doc_id = p.doc_id AND p.s <= c.s AND c.s < p.e), u AS (SELECT c.doc_id, c.n, bool_and(ok) AS ok FROM c JOIN t ON c.doc_id = t.doc_id AND c.s <= t.s AND t.e <= c.e WHERE m IS NOT NULL GROUP BY 1, 2),
j AS (SELECT c.*, m IS NOT NULL AND i.n IS NULL AND NOT coalesce(u.ok, false) AND NOT regexp_matches(coalesce(after, ''), '(?i)^{_UNIT}')
  AND lower(regexp_extract(before, '([A-Za-z]+)[^\pL\pN_]*$', 1)) NOT IN ({_WORDS}) AS live FROM c LEFT JOIN i ON c.doc_id = i.doc_id AND c.n = i.n LEFT JOIN u ON c.doc_id = u.doc_id AND c.n = u.n)"""
OPEN = f"WITH {_OPEN} SELECT doc_id, s AS start_at, e AS end_at, m AS match FROM j WHERE live"

SWEPT = rf"""WITH {_OPEN}, g AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY doc_id ORDER BY n), false) AS behind FROM j),
h AS (SELECT doc_id, n, m, live, CASE WHEN behind THEN regexp_replace(before, '(?i)^\s*(?:(?:{'|'.join(C.PLAIN_UNITS)})([^A-Za-z]|$)|%)', '\1') ELSE before END AS b FROM g),
k AS (SELECT doc_id, n, live, CASE WHEN live THEN CASE WHEN n = 0 THEN regexp_replace(b, '(^|\s)[-–—]\s*$', '\1') ELSE regexp_replace(b, '(\s)[-–—]\s*$', '\1') END ELSE b || coalesce(m, '') END AS part FROM h),
w AS (SELECT doc_id, string_agg(part, '' ORDER BY n) AS text, count(*) FILTER (WHERE live) AS n_removed FROM k GROUP BY 1)
SELECT doc_id, CASE WHEN n_removed > 0 THEN regexp_replace(regexp_replace(regexp_replace(text, '\s{{2,}}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS text, n_removed FROM w"""

RESTATED = rf"""WITH f AS (SELECT doc_id, n, before, m, after, e FROM {_pieces(figures.FIGURE)} WHERE n = 0),
v AS (SELECT f.*, coalesce(text, '') AS text, m IS NOT NULL AND NOT regexp_matches(before, '\.$') AND NOT regexp_matches(substr(coalesce(text, ''), e + 1), '^\.?[0-9]') AS placed,
  CASE f.doc_id % 3 WHEN 0 THEN CAST(3 * length(m) AS VARCHAR) WHEN 1 THEN '-' || 3 * length(m) END AS value, substr(coalesce(text, ''), e + 1) AS rest FROM f JOIN documents d ON d.doc_id = f.doc_id),
x AS (SELECT *, CASE WHEN value LIKE '-%' THEN regexp_replace(before, '[-–—]$', '') ELSE before END AS head, regexp_replace(regexp_replace(before, '(^|\s)[-–—]\s*$', '\1'), '\s+$', '') AS left_part, regexp_replace(rest, '(?i)^\s*(?:(?:{'|'.join(C.PLAIN_UNITS)})([^A-Za-z]|$)|%)', '\1') AS tail FROM v)
SELECT doc_id, CASE WHEN NOT placed THEN text WHEN value IS NOT NULL THEN head || value || rest
  ELSE left_part || CASE WHEN (regexp_matches(before, '\s$') OR regexp_matches(tail, '^\s')) AND trim(before) <> '' AND trim(tail) <> '' AND NOT regexp_matches(tail, '^\s*[.,;:!?]') THEN ' ' ELSE '' END || regexp_replace(tail, '^\s+', '') END AS text,
CASE WHEN placed AND value IS NOT NULL THEN length(head) || '-' || (length(head) + length(value)) ELSE '' END AS covered FROM x"""

QUERIES = {f.__name__: f for f in (open_numbers, swept_documents, restated_documents)}
ORACLE = {"open_numbers": OPEN, "swept_documents": SWEPT, "restated_documents": RESTATED}
