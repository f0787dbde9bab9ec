"""The query of the n-gram join, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read
from millrace.llm.ngram_join import ngram_join
from millrace.llm.registry import query

SIZE, PERCENT = 5, 80

# All pairs that share a shingle, and all that links reach: for small tables, as a check.
OP11_SQL = rf"""
WITH RECURSIVE doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, words[i : i + {SIZE - 1}] AS shingle
    FROM doc_words, unnest(range(1, greatest(len(words) - {SIZE - 2}, 2))) AS u(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * pairs.n >= {PERCENT} * (x.n + y.n - pairs.n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT doc_id, b FROM reached JOIN edges ON a = other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query(OP11_SQL)
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents", "doc_id", "text"), SIZE, PERCENT)
