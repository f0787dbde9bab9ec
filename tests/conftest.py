from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from millrace.session import open_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = open_session(
        "tests",
        master=f"local[{os.environ.get('TEST_CPUS', '8')}]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.session.timeZone": "UTC",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.driver.extraJavaOptions": "-Dderby.stream.error.file=/tmp/derby-tests.log",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path: Path) -> str:
    return str(tmp_path)
