import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from buildlore.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), 4)
    yield session
    session.stop()
