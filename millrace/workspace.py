"""Where a job may write what it needs between two steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one run, on storage that every executor reaches.

    The cluster names shared storage in ``spark.checkpoint.dir``. Only a local
    master, where driver and executors share one disk, may use ``/tmp`` instead.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"
    if spark.conf.get("spark.master", "").startswith("local"):
        return tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ``new_folder``; a remote session, which has no file access, leaves it."""
    if "run-" not in folder.rsplit("/", 1)[-1]:
        raise ValueError(f"not a folder of a run: {folder}")
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path for it; needs a classic session."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        raise ValueError("files are claimed and committed by the driver, which a remote session has not")
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found
