import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkrill.session import build_session, ship_package

    session = build_session("tests", cores=8, shuffle_partitions=4)
    ship_package(session)
    yield session
    session.stop()
