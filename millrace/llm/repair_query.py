"""The query of conversation repair, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read
from millrace.llm.registry import query
from millrace.llm.repair import repaired

# The bits of each byte of the key, one by one.
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))))"""

# The programme row by row, over states 0 (nothing yet), 1 (s), 2 (u) and 3 (a).
OP12_SQL = rf"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), drawn AS (SELECT *, {_CRC32} % 20 AS kind FROM given),
damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM drawn, unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END)
), sorted AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i
    FROM damaged
), faulty AS (
    SELECT *, left(role, 1) AS ini, CASE
        WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM sorted
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || '/' || ini NOT IN ('s/u', 'u/a', 'a/u')) AS illegal, count(*) AS n
    FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty) GROUP BY conv_id
), ins(i0, i1, cost, audit, said) AS (
    VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:')
), moves(s0, s1, ini) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS (
    SELECT conv_id, i, s AS s0, s AS s1, 3 AS cost, 'D' AS audit, '' AS said FROM faulty, range(4) u(s)
    UNION ALL
    SELECT conv_id, i, s0, s1, (fault = 'truncated')::INTEGER, 'K', chr(10) || role || ':' || text
    FROM faulty JOIN moves ON moves.ini = faulty.ini WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT conv_id, i, s0, s1, 2 + (fault = 'truncated')::INTEGER, 'R', chr(10) || CASE moves.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
    FROM faulty, moves WHERE fault NOT IN ('blank', 'duplicate') AND moves.ini <> 's'
), ways AS (
    SELECT conv_id, i, i0 AS s0, s1, ins.cost + edits.cost AS cost, ins.audit || edits.audit AS audit, ins.said || edits.said AS said
    FROM edits JOIN ins ON i1 = s0
), names AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0, 'audit': '', 'said': ''}} AS e FROM names
    UNION ALL
    SELECT best.conv_id, best.i + 1, w.s1, min({{'cost': (e.cost + w.cost)::INTEGER, 'audit': e.audit || w.audit, 'said': e.said || w.said}})
    FROM best JOIN ways w ON w.conv_id IS NOT DISTINCT FROM best.conv_id AND w.i = best.i + 1 AND w.s0 = best.s
    GROUP BY best.conv_id, best.i, w.s1
), ended AS (
    SELECT best.conv_id, min({{'cost': e.cost + ins.cost, 'audit': e.audit || ins.audit, 'said': e.said || ins.said}}) AS e
    FROM best JOIN ins ON i0 = s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM best.conv_id
    WHERE best.i = coalesce(c.n, 0) AND i1 IN (0, 3) GROUP BY best.conv_id
)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.cost::BIGINT AS cost, e.audit AS audit,
    sha256(substr(e.said, 2)) AS repaired_sha256
FROM ended LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows damaged by the crc32 of ``conv_id:turn``, in twentieths; nulls are one space."""

    def whole(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(whole("text"), ".!?", "")).otherwise(whole("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    role = F.when(kind == 4, "user").otherwise(whole("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(True), copies).alias("copies"))
    return rows.withColumn("copies", F.explode("copies")).drop("copies")


@query(OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repaired(damaged(conversations), conversations)
