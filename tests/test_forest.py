"""Trees that grow in tasks against plain ones on the same draws."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning

SCHEMA = "k long, a double, b double, extra string"


def frame(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 1) if i % 11 else None, rng.gauss(0, 1), "x") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(drawn, trees, size, seed=7):
    """Trees over the draws, grown here by recursion."""
    out = []
    for t in range(trees):
        own = sorted((r for r in drawn if r["tree"] == t), key=lambda r: (r["draw"], r["copy"]))[:size]
        out.append(np.array([[np.nan if r[f] is None else r[f] for f in ("f0", "f1")] for r in own], float))
    return out


@pytest.mark.parametrize("n, trees, size", [(3000, 12, 32), (100, 5, 64), (20, 3, 64)])
def test_scores_equal_a_plain_forest_on_the_same_draws(spark, n, trees, size):
    rows = frame(spark, n)
    own = rows.select("k", "a", "b")
    drawn = learning.draws(own, "k", ["a", "b"], n, trees, size).collect()
    samples = plain(drawn, trees, size)
    assert [len(s) for s in samples] == [min(n, size)] * trees
    data = {r["k"]: (np.nan if r["a"] is None else r["a"], r["b"]) for r in own.collect()}
    x = np.array([data[k] for k in range(n)])
    median = np.array([sorted(v for v in x[:, j] if not math.isnan(v))[(int((~np.isnan(x[:, j])).sum()) + 1) // 2 - 1] for j in (0, 1)])
    filled = np.where(np.isnan(x), median, x)
    center, scale = filled.mean(0), filled.std(0)
    usual = learning._path(np.array([float(min(n, size))]))[0]
    limit = math.ceil(math.log2(max(min(n, size), 2)))
    total = np.zeros(n)
    for t, sample in enumerate(samples):
        sample = (np.where(np.isnan(sample), median, sample) - center) / scale
        feature, cut, depth = learning._grown(sample, limit, np.random.default_rng([7, t]))
        for i, row in enumerate((filled - center) / scale):
            at = 1
            while feature[at] >= 0:
                at = 2 * at + int(row[feature[at]] >= cut[at])
            total[i] += depth[at]
    want = -np.power(2.0, -total / trees / usual)
    got = {r["k"]: r["raw_score"] for r in learning.anomaly_scores(rows, "k", ["a", "b"], trees, size).collect()}
    assert len(got) == n and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in range(n))


def test_draws_are_even_and_independent(spark):
    n, trees, size = 20_000, 8, 64
    drawn = learning.draws(frame(spark, n).select("k", "a", "b"), "k", ["a", "b"], n, trees, size).collect()
    sizes = [sum(r["tree"] == t for r in drawn) for t in range(trees)]
    assert all(64 <= s <= 200 for s in sizes) and {r["copy"] for r in drawn} == {1}
    own = {t: {r["f1"] for r in drawn if r["tree"] == t} for t in range(trees)}
    assert all(own[a] != own[b] for a in own for b in own if a < b)


def test_equal_rows_and_tables_without_rows(spark):
    same = spark.range(5000).select(F.lit(1).cast("long").alias("k"), F.lit(2.0).alias("a"), F.lit(None).cast("double").alias("b"))
    drawn = learning.draws(same, "k", ["a", "b"], 5000, 4, 16).groupBy("tree").count().collect()
    assert all(r["count"] <= 16 for r in drawn)  # copies are counted, not moved
    rows = spark.createDataFrame([(i, 1.0, 1.0, "x") for i in range(300)], SCHEMA)
    assert {r["score"] for r in learning.anomaly_scores(rows, "k", ["a", "b"], 5, 32).collect()} == {0.0}
    assert learning.anomaly_scores(rows.filter("k < 0"), "k", ["a", "b"], 5, 32).count() == 0


def test_an_outlier_that_is_drawn_stands_out(spark):
    rows = frame(spark, 400).withColumn("b", F.when(F.col("k") == 7, 50.0).otherwise(F.col("b")))
    got = {r["k"]: r["raw_score"] for r in learning.anomaly_scores(rows, "k", ["a", "b"], 60, 256).collect()}
    assert min(got, key=got.get) == 7
