import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)
