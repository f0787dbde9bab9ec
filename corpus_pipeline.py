"""Documents to token ids: quality rules, near-dedup, decontamination, mixing, token output.

Each stage is a function of the rows that the one before it kept; ``run``
writes each stage's result and reads it again, so a lost executor repeats at
most the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read
from millrace.llm.decontaminate import decontaminated
from millrace.llm.near_dedup import without_near_duplicates
from millrace.llm.quality import good_documents
from millrace.llm.queries import END_ID, mixed, tokenizer_path
from millrace.llm.token_output import read_index, write_tokens
from millrace.workspace import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed limits and near the centre of their language and source."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 80 percent in common."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words of benchmark items cut out; those mostly of such words go."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights: one epoch, so that no copy comes back; the last one of a leaf stays whole."""
    return mixed(docs, epochs=1).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and where each document lies in them."""
    path = f"{new_folder(spark)}/tokens"
    write_tokens(docs, path, tokenizer_path(), END_ID)
    return read_index(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

# Models, signatures and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{new_folder(spark)}/stage"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
