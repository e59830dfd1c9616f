import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from evigrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
