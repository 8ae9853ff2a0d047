import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

# The 16-node sample graph and its station blocks.
LINKS = [
    (1, 2), (2, 6), (3, 4), (4, 8), (5, 6), (6, 7), (6, 10), (7, 8), (9, 13), (10, 11), (11, 12),
    (11, 15), (12, 16), (13, 14), (14, 15),
]
STATIONS = {1: [1, 2, 5, 6], 2: [3, 4, 7, 8], 3: [9, 10, 13, 14], 4: [11, 12, 15, 16]}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[2]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def graph(spark):
    both = LINKS + [(b, a) for a, b in LINKS]
    return spark.createDataFrame(both, "src BIGINT, dst BIGINT")


@pytest.fixture(scope="session")
def neighbours():
    result = {n: set() for n in range(1, 17)}
    for a, b in LINKS:
        result[a].add(b)
        result[b].add(a)
    return result


def obs_frame(spark, rows):
    """Readings out of (batch, node, value) tuples."""
    return spark.createDataFrame(rows, "batch BIGINT, node BIGINT, value DOUBLE")


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
