"""Stored rows leave no shuffle files behind."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from millrace.llm.common import stored


def test_stored_rows_leave_no_shuffles(spark):
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffles()
    rows = stored(counts.join(counts.withColumnRenamed("count", "n").hint("merge"), "k"))
    ends = time.monotonic() + 10
    while not shuffles() <= before and time.monotonic() < ends:
        time.sleep(0.1)
    assert shuffles() <= before
    assert rows.where("n = 100 AND count = 100").count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
