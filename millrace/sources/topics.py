"""Topics as streams: a broker, or a file log with the same columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The columns of Spark's Kafka source.
TOPIC_RECORD = StructType(
    [
        StructField("key", BinaryType()),
        StructField("value", BinaryType()),
        StructField("topic", StringType()),
        StructField("partition", IntegerType()),
        StructField("offset", LongType()),
        StructField("timestamp", TimestampType()),
        StructField("timestampType", IntegerType()),
    ]
)

# A replay starts from the oldest record however old it is, so no file is ever
# skipped for its age; a batch takes files up to this size of each topic.
FILE_AGE_LIMIT = "36500d"
BATCH_BYTES = 1 << 34


_LOGGED = StructType([f for f in TOPIC_RECORD if f.name != "topic"])


def _names(topics: str | Sequence[str]) -> list[str]:
    names = topics.split(",") if isinstance(topics, str) else list(topics)
    return list(dict.fromkeys(name.strip() for name in names))


def _folder(log: str, topic: str) -> str:
    return f"{log}/topic={topic}"


def _records(spark: SparkSession, log: str, topic: str) -> DataFrame | None:
    """The records of one topic, or None while it has no folder."""
    try:
        return spark.read.schema(_LOGGED).parquet(_folder(log, topic))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _named(records: DataFrame, topic: str) -> DataFrame:
    return records.withColumn("topic", F.lit(topic)).select(*TOPIC_RECORD.names)


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topics: str | Sequence[str],
    starting: str = "earliest",
    **options: str,
) -> DataFrame:
    """Topics of a broker; needs Spark's Kafka package on the class path.

    Further options go to the source as they are: ``minPartitions`` reads a hot
    topic partition with several tasks, ``maxOffsetsPerTrigger`` bounds a batch.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(_names(topics)))
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )


def event_log(spark: SparkSession, log: str, topics: str | Sequence[str]) -> DataFrame:
    """The subscribed topics of a log as a bounded frame.

    The log has a folder per topic; those of other topics are not even listed.
    A topic the log does not know is empty.
    """
    found = [(topic, _records(spark, log, topic)) for topic in _names(topics)]
    frames = [_named(records, topic) for topic, records in found if records is not None]
    return reduce(DataFrame.union, frames or [spark.createDataFrame([], TOPIC_RECORD)])


def event_log_stream(
    spark: SparkSession,
    log: str,
    topics: str | Sequence[str],
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The subscribed topics of a log as a stream, from their oldest files on.

    Each topic is a file source of its own: the folders of other topics are not
    even listed. What is due is taken in batches of ``batch_bytes`` a topic, so
    that a restart with a checkpoint repeats one batch and not the whole log. A
    topic without events gets an empty file, and its stream waits for them.
    """

    def one(topic: str) -> DataFrame:
        if _records(spark, log, topic) is None:
            spark.createDataFrame([], _LOGGED).write.mode("append").parquet(_folder(log, topic))
        records = (
            spark.readStream.schema(_LOGGED)
            .option("maxFileAge", FILE_AGE_LIMIT)
            .option("maxBytesPerTrigger", batch_bytes)
            .parquet(_folder(log, topic))
        )
        return _named(records, topic)

    return reduce(DataFrame.union, [one(topic) for topic in _names(topics)])


def end_offset(spark: SparkSession, log: str, topic: str) -> int:
    """The offset that follows the highest one a topic holds."""
    last = event_log(spark, log, topic).agg(F.max("offset")).first()[0]
    return 0 if last is None else last + 1
