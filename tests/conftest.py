import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from folioflow.session import local_session, release, ship_package

    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
