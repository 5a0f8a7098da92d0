from __future__ import annotations

import pytest

from checks.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


@pytest.fixture(scope="session")
def bench(spark, small_dir):
    """A workbench on the smallest test data, shared by the tests that only read."""
    from checks.star import star_tables
    from stockloom import Workbench

    return Workbench(star_tables(spark, small_dir))
