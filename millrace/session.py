"""Session settings for the jobs; the work itself never depends on them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, at_least: int = 200) -> int:
    """Shuffle partitions that keep one partition near 128 MB of input."""
    return max(at_least, -(-input_bytes // SHUFFLE_PARTITION_BYTES))


def open_session(
    app: str,
    *,
    master: str | None = None,
    remote: str | None = None,
    input_bytes: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session, classic (``master``) or remote (``sc://host:port``).

    With neither, ``spark-submit`` or the environment decides. ``input_bytes``
    is the size of the largest shuffled input; only ``diff_to_events`` shuffles.
    """
    builder = SparkSession.builder.appName(app)
    if remote:
        builder = builder.remote(remote)
    elif master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true"}
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    settings.update(conf or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
