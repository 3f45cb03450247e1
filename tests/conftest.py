import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changefeed.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def value(spark):
    """Value of one SQL or Column expression over a one-row frame of typed SQL literals."""

    def evaluate(build, literal):
        return spark.sql(f"SELECT {literal} AS x").select(build("x")).first()[0]

    return evaluate
