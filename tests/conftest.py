import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

import oracle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = oracle.session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tight(spark):
    """Every group counts as too big and every lookup as too large."""
    for key, value in oracle.TIGHT.items():
        spark.conf.set(key, value)
    yield
    for key in oracle.TIGHT:
        spark.conf.unset(key)


@pytest.fixture(autouse=True)
def _clear(spark):
    yield
    spark.catalog.clearCache()
