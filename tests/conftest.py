import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tests.session import local_session

    return local_session()


@pytest.fixture(scope="session")
def tables(spark):
    from lifethread.plans.bindings import Tables

    return Tables(spark, "/root/testdata/sf0.001")
