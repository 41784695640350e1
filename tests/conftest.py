import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewire.session import local_session  # noqa: E402


def pytest_collection_finish(session):
    # Stand-in scorers live in test modules, which workers cannot import.
    for item in session.items:
        cloudpickle.register_pickle_by_value(item.module)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()
