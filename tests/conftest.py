import os
import tempfile

import pytest

from hearsay.config import Settings
from hearsay.session import build_session
from tests.compare import connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="hearsay-tests-")
    session = build_session(
        "hearsay-tests", "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": f"{base}/warehouse",
            "spark.checkpoint.dir": f"{base}/shared",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def settings(spark, request):
    """A namespace of its own for every test."""
    name = f"ns_{abs(hash(request.node.nodeid)) % 10**10}"
    yield Settings(namespace=name)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
