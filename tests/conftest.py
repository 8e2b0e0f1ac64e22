import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__  # noqa: E402,F401  (sets the workers' path)
from taxoflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "*", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
