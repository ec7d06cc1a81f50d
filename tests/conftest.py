import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    session = get_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from tessera.plans.fixtures import Fixtures

    return Fixtures(spark, f"{DATA}/sf0.001")
