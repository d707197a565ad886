import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fotolake.session import with_defaults  # noqa: E402


def _session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="fotolake-test-")
    session = (
        with_defaults(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{folder}/checkpoint")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


# Test modules name columns when they are imported, which needs a session.
SESSION = _session()


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def work():
    return tempfile.mkdtemp(prefix="fotolake-test-")


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of values (or tuples of values)."""

    def evaluate(expression, rows, schema):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        numbered = [(i, *row) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"_i int, {schema}")
        found = df.select("_i", expression.alias("v")).collect()
        return [row["v"] for row in sorted(found, key=lambda r: r["_i"])]

    return evaluate
