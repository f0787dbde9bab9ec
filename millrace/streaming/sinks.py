"""Where decoded streams go; all sinks append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.operators.preview import PREVIEW_ROWS
from millrace.workspace import drop_folder, new_folder

# Folders of queries whose checkpoint nobody needs after their end, by query.
_passing: dict[str, tuple[SparkSession, str]] = {}


def _writer(rows: DataFrame, checkpoint: str, bounded: bool) -> DataStreamWriter:
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if bounded else writer


def _start_passing(rows: DataFrame, bounded: bool, begin) -> StreamingQuery:
    """Start a query that replays from the beginning every time; ``finish`` removes its folder."""
    folder = new_folder(rows.sparkSession)
    query = begin(_writer(rows, f"{folder}/checkpoint", bounded))
    _passing[query.id] = (rows.sparkSession, folder)
    return query


def start_memory(rows: DataFrame, name: str, bounded: bool = False) -> StreamingQuery:
    """Keep the rows on the driver under a table name.

    The driver holds every row: this is for results of known small size, some
    100,000 rows at most. ``named_result`` has no such limit.
    """
    return _start_passing(rows, bounded, lambda writer: writer.format("memory").queryName(name).start())


def start_files(
    rows: DataFrame, path: str, checkpoint: str, bounded: bool = False
) -> StreamingQuery:
    """Write Parquet, each row once however often the query is started again."""
    return _writer(rows, checkpoint, bounded).format("parquet").option("path", path).start()


def start_console(
    rows: DataFrame,
    truncate: bool = True,
    shown: int = PREVIEW_ROWS,
    bounded: bool = False,
) -> StreamingQuery:
    """Print the first rows of every batch.

    Spark's console format carries whole batches to the driver to print twenty
    rows of them. Here a batch is a frame whose first rows are fetched, so that
    the size of a batch does not matter.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        line = "-" * 43
        print(f"{line}\nBatch: {batch_id}\n{line}")
        batch.show(shown, truncate)

    return _start_passing(rows, bounded, lambda writer: writer.foreachBatch(show).start())


def finish(query: StreamingQuery, timeout: float | None = None) -> None:
    """Wait until a query has ended; raise what it raised, or when time is up.

    The checkpoint of a console or memory query is removed, as nothing starts from it again.
    """
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"stream {query.name or query.id} did not end in {timeout} s")
    finally:
        if folder := _passing.pop(query.id, None):
            drop_folder(*folder)


def named_result(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is due and make its rows a table called ``name``.

    The rows go to Parquet files below ``folder``, however many they are, and
    the table is a view on them; run again with the same ``folder`` it only adds
    what is new. For a table on the driver see ``start_memory``.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark)
    finish(start_files(rows, f"{folder}/rows", f"{folder}/checkpoint", bounded=True))
    spark.read.schema(rows.schema).parquet(f"{folder}/rows").createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM `{name}`")
