"""Work tables go when they are discarded or released."""

from __future__ import annotations

import os

from tidemark import storage


def test_work_tables_go(spark):
    folder = lambda t: t.work_path.removeprefix("file:")
    since = storage.mark()
    a, b, c = (storage.written(spark.range(n), "t") for n in (1, 2, 3))
    assert [t.count() for t in (a, b, c)] == [1, 2, 3]
    storage.discard(a, spark.range(1))
    assert [os.path.exists(folder(t)) for t in (a, b, c)] == [False, True, True]
    storage.release(since, c)
    assert [os.path.exists(folder(t)) for t in (a, b, c)] == [False, False, True]
    storage.release(since)
    assert not os.path.exists(folder(c)) and storage.mark() >= since + 3
