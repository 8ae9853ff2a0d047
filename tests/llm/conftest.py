import os

import pytest

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """A documents table with a clashing extra column, out of (doc_id, text) pairs."""
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, key STRING"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], schema)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
