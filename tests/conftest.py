import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from geolake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(8, "geolake-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Every key above a few rows counts as hot, so the sliced paths run."""
    from geolake.operators import ordered

    monkeypatch.setattr(ordered, "ROW_LIMIT", 5)
    ordered._hot_memo.clear()
    yield
    ordered._hot_memo.clear()
