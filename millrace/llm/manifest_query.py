"""The query of the Merkle manifest, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read
from millrace.llm.manifest import FAN, FIELDS, manifest
from millrace.llm.registry import query

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The bits of each byte of the id, one by one.
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, x: xor(xor(s, x) >> 1, 3988292384::BIGINT * (xor(s, x) & 1))))"""


def _leaf_sql(text: str) -> str:
    values = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"


def _tree_sql(name: str, levels: int) -> str:
    """The levels above the nodes ``{name}0`` (t, pos, d), and the siblings ``{name}s{k}`` at each."""
    out = []
    for k in range(levels):
        group = f"OVER (PARTITION BY t, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(
            f"""{name}s{k} AS (
    SELECT t, pos, d, count(*) OVER (PARTITION BY t) > 1 AS many,
        coalesce(string_agg(d, '') {group} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') {group} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k}
), {name}{k + 1} AS (
    SELECT t, pos // {FAN} AS pos, CASE WHEN many THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d
    FROM {name}s{k} GROUP BY t, pos // {FAN}, many
)"""
        )
    return ",\n".join(out)


def _climb_sql(name: str, siblings: str, tree: str, levels: int) -> str:
    """The proofs and folds of the leaves ``{name}0``, level by level, in the column ``tree`` of the siblings."""
    out = []
    for k in range(levels):
        out.append(
            f"""{name}{k + 1} AS (
    SELECT c.* REPLACE (c.pos // {FAN} AS pos, proof || l || r AS proof, CASE WHEN many THEN sha256(l || fold || r) ELSE fold END AS fold)
    FROM {name}{k} c JOIN {siblings}s{k} s ON s.t = {tree} AND s.pos = c.pos
)"""
        )
    return ",\n".join(out)


# Levels that the SQL has: 16 million rows a language, and 4,096 languages.
_LEVELS, _UPPER_LEVELS = 8, 4

OP13_SQL = f"""
WITH leaves AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS fold
    FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
n0 AS (SELECT t, pos, leaf AS d FROM placed),
{_tree_sql("n", _LEVELS)},
u0 AS (SELECT 0 AS t, t AS pos, d FROM n{_LEVELS}),
{_tree_sql("u", _UPPER_LEVELS)},
c0 AS (SELECT *, '' AS proof FROM placed),
{_climb_sql("c", "n", "c.t", _LEVELS)},
v0 AS (SELECT * REPLACE (t AS pos) FROM c{_LEVELS}),
{_climb_sql("v", "u", "0", _UPPER_LEVELS)}
SELECT doc_id, leaf, n{_LEVELS}.d AS subroot, u{_UPPER_LEVELS}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
    fold = u{_UPPER_LEVELS}.d AS verified
FROM v{_UPPER_LEVELS} v JOIN n{_LEVELS} ON n{_LEVELS}.t = v.t, u{_UPPER_LEVELS}
"""


@query(OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by the crc32 of its id, is verified with its capitals made small."""
    docs = read(spark, sf_dir, "documents", *FIELDS)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text")))
