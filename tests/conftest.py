import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitefold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to every row of inline data and return the results in order."""

    def run(rows, schema, column):
        indexed = [(i, *row) for i, row in enumerate(rows)]
        df = spark.createDataFrame(indexed, "i int, " + schema)
        return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]

    return run
