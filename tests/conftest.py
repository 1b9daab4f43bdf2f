"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from webloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    one = session.local("tests", cores="4", shuffle=4)
    one.sparkContext.setLogLevel("ERROR")
    session.ship(one)
    yield one
    one.stop()
