from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from oddglass.session import get_session

    session = get_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="oddglass-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def place(tmp_path):
    return str(tmp_path)
