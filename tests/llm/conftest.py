import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixture_docs import fixture_rows, make  # noqa: E402

@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, []).limit(0)


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows without an id, and without anything."""
    return spark.createDataFrame([(None, "some text " * 60), (None, None), (4, "some text " * 60)], "doc_id long, text string")
