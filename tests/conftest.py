"""A local session, and a comparison of queries with their SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(work / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
