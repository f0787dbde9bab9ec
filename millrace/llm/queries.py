"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.chat import chain, formatted, read_digests
from millrace.llm.common import read
from millrace.llm.decontaminate import matched
from millrace.llm.language_model import scores, train
from millrace.llm.mixing import mixture
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.pii import personal_spans
from millrace.llm.quality import quality_verdicts
from millrace.llm.ranking import AT_THRESHOLD, scored
from millrace.llm.ranking import train as train_ranking
from millrace.llm.registry import query
from millrace.llm.sharding import interleaved_shards
from millrace.llm.token_output import read_index, write_tokens
from millrace.workspace import new_folder

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/tokens"
    write_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_path(), END_ID)
    return read_index(spark, path)


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keep = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    rows = interleaved_shards(read(spark, sf_dir, "documents"), shards=16, seed=7, keep=keep)
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


OP8_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, words[i : i + least(len(words), 10) - 1] AS win
    FROM item_words, unnest(range(1, greatest(len(words) - 8, 2))) AS u(i)
    WHERE len(words) > 0
), doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
runs AS (
    SELECT doc_id, i, n, words[i : i + n - 1] AS win
    FROM doc_words, sizes, unnest(range(1, greatest(len(words) - n + 2, 1))) AS u(i)
), found AS (SELECT DISTINCT doc_id, i, n, item_id FROM runs JOIN windows USING (win)),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _listed(spans: str) -> Column:
    """Spans as kind:start:end with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", personal_spans(F.col("text")).alias("found"))
    base = ("email", "ip", "card", "phone")
    rows = rows.withColumn("of_base", F.filter("found", lambda s: s["kind"].isin(*base)))
    kinds = F.transform("of_base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in base]
    added = (F.size("found") - F.size("of_base")).cast("long").alias("n_added")
    return rows.select(
        "doc_id", *counts, F.sha2(_listed("of_base"), 256).alias("base_sha256"), _listed("found").alias("spans"), added, F.size("found").cast("long").alias("n_spans")
    )


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


# All pairs that share a shingle, and all that links reach: for small tables, as a check.
OP6_SQL = r"""
WITH RECURSIVE doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, words[i : i + 2] AS shingle
    FROM doc_words, unnest(range(1, greatest(len(words) - 1, 2))) AS u(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT doc_id, b FROM reached JOIN edges ON a = other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query(OP6_SQL)
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), size=3, percent=85)


# The tree of the mixture: sources are dealt to three domains by their names.
DOMAINS = {"books": 2, "code": 1, "web": 3}
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 1}
MIX_SEED, MIX_EPOCHS, MIX_PERCENT = 11, 2, 80


def _weight(node: str, weights: dict[str, int]) -> Column:
    weight = F.lit(1)
    for name, value in weights.items():
        weight = F.when(F.col(node) == name, value).otherwise(weight)
    return weight


def mixed(docs: DataFrame, epochs: int = MIX_EPOCHS, percent: int = MIX_PERCENT) -> DataFrame:
    """Documents by the weights above: ``percent`` of the tokens there are."""
    name = F.coalesce("source", F.lit(""))
    digit = F.conv(F.substring(F.md5(name), 1, 1), 16, 10).cast("int") % len(DOMAINS)
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), digit + 1)
    weights = {"domain": _weight("_domain", DOMAINS), "lang": _weight("_lang", LANGUAGES), "source": F.lit(1)}
    path = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    budget = F.expr(f"available * {percent} div 100")
    return mixture(docs, path, weights, budget, epochs, MIX_SEED)


def _divided_sql(level: str, up: str, weight: str, parents: str) -> str:
    """One level of the tree as common table expressions: ``level`` names the nodes, ``up`` their parents' path."""
    path, group = f"{up}{level}", f"PARTITION BY {up.rstrip(', ')}" if up else ""
    before = f"OVER ({group} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    join = f"JOIN {parents} USING ({up.rstrip(', ')})" if up else f", {parents}"
    return f"""
{level}_nodes AS (
    SELECT {path}, pb, w, cap FROM (SELECT {path}, sum(cap) AS cap, {weight} AS w FROM leaves GROUP BY {path}) {join}
), {level}_full AS (
    SELECT *, cap * (sum(w) OVER ({group}) - coalesce(sum(w) {before}, 0)) <= w * (pb - coalesce(sum(cap) {before}, 0)) AS is_full
    FROM {level}_nodes
), {level}_rest AS (
    SELECT *, pb - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({group}) AS rest,
        sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({group}) AS free,
        sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({group} ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS upto
    FROM {level}_full
), {level}_budget AS (
    SELECT {path}, CASE WHEN is_full THEN cap ELSE rest * upto // free - rest * (upto - w) // free END AS pb FROM {level}_rest
)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END"


OP2_SQL = rf"""
WITH docs AS (
    SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
        {list(DOMAINS)}[('0x' || substr(md5(coalesce(source, '')), 1, 1))::INTEGER % {len(DOMAINS)} + 1] AS d,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS n
    FROM documents
), leaves AS (SELECT d, l, s, sum(n) AS available, sum(n) * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL),
root AS (SELECT least(sum(available) * {MIX_PERCENT} // 100, sum(cap)) AS pb FROM leaves),
{_divided_sql("d", "", _case("d", DOMAINS), "root")},
{_divided_sql("l", "d, ", _case("l", LANGUAGES), "d_budget")},
{_divided_sql("s", "d, l, ", "1", "l_budget")},
plan AS (SELECT d, l, s, pb // available AS whole, pb % available AS rest FROM s_budget JOIN leaves USING (d, l, s) WHERE pb > 0),
shuffled AS (
    SELECT docs.*, whole, rest, ('0x' || substr(md5('{MIX_SEED}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS h
    FROM docs JOIN plan USING (d, l, s)
), placed AS (
    SELECT *, coalesce(sum(n) OVER (
        PARTITION BY d, l, s ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM shuffled
)
SELECT doc_id, lang, source, epoch::BIGINT AS epoch, n::BIGINT AS take_tokens FROM shuffled, unnest(range(whole::BIGINT)) AS u(epoch)
UNION ALL
SELECT doc_id, lang, source, whole::BIGINT, least(n, rest - before)::BIGINT FROM placed WHERE before < rest
"""


@query(OP2_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "lang", "source", "epoch", "take_tokens")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", _remainder(7) == 2)
    # By region at every size, so that a small run does what a large one does.
    return scores(docs, train(docs.where("NOT held_out"), filter_bytes=0))


@query()
def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", _remainder(4) == 2)
    labels = read(spark, sf_dir, "labels").where(~(_remainder(4) == 2))
    ranking = train_ranking(docs.where("NOT held_out"), labels.select("doc_id", (F.col("quality") == 1).alias("good")))
    return scored(docs, ranking).withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))


OP5_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<turn >' || '</turn>' || chr(10)) + length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT
        AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query(OP5_SQL)
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    path = f"{new_folder(spark)}/chats"
    formatted(chain(rows.union(added))).write.parquet(path)
    digests = read_digests(spark, path)
    conv_id = F.when(F.col("tree") != "null", F.substring("tree", 2, 40).cast("long")).alias("conv_id")
    return digests.select(conv_id, *digests.columns[2:])
