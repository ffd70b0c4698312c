import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpuslab.session import clear_shared, local_session

    session = local_session(8, "corpuslab-tests")
    yield session
    clear_shared(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL
