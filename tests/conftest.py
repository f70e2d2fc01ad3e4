from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from skyloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "skyloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
