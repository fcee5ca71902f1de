"""Memory of exact vector search in a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.operators import retrieval


class Rows:
    """A table of which only what a task runs is wanted."""

    def __init__(self, rows=()):
        self.rows = rows

    def select(self, *_):
        return self

    def collect(self):
        return self.rows

    def mapInArrow(self, run, schema):
        return run


def test_a_task_holds_a_bounded_number_of_distances(spark):
    """1,000 queries against batches of 20,000 rows are compared in parts; the result is that of whole matrices, ties by id."""
    rng = np.random.default_rng(1)
    wanted, own = rng.integers(-2, 3, (1000, 4)) + 0.5, rng.integers(-2, 3, (22_000, 4)) + 0.5
    ids = rng.permutation(len(own))
    run = retrieval._near(Rows([(i, w) for i, w in enumerate(wanted)]), Rows(), 5, "query_id", "vec_id", "embedding")
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(own[a:b].tolist())], names=["vec_id", "embedding"]) for a, b in ((0, 3), (3, 20_000), (20_000, 22_000))]
    tracemalloc.start()
    got = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    found = np.array(got[0].column("vec_id")).reshape(1000, 5)
    for q in range(0, 1000, 97):
        far = 1 - retrieval._unit(wanted[q : q + 1]) @ retrieval._unit(own).T
        assert found[q].tolist() == ids[np.lexsort((ids, np.round(far[0], 6)))[:5]].tolist()
