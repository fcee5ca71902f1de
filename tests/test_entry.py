"""The driver's entry imports and lists its queries without a session."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path


def test_lists_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, timeout=120).returncode == 0
