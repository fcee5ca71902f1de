"""Searches of boxes and dates against the plain filter, and the files that they read."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.place_index import Box, PlaceIndex, curve

SCHEMA = "id long, latitude double, longitude double, ts timestamp, mode string, _file string"
T = dt.datetime(2024, 1, 1)


def rows(n=20_000):
    rng = random.Random(4)
    out = []
    for i in range(n):
        place = (57.0, 24.0) if i % 3 == 0 else (rng.uniform(50, 62), rng.uniform(5, 25))  # a port holds a third
        out.append((i, *place, T + dt.timedelta(minutes=rng.randrange(60 * 24 * 90)), rng.choice("ab"), "own"))
    return out + [(-1, None, 10.0, T, "a", None), (-2, 55.0, None, T, "a", None), (-3, 55.0, 10.0, None, "a", None)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    own = spark.createDataFrame(rows(), SCHEMA).drop("_file").withColumn("a b", F.lit(1)).repartition(7)
    return PlaceIndex.build(own, str(tmp_path_factory.mktemp("places") / "in dex"), file_rows=300), own


@pytest.mark.parametrize(
    "box",
    [
        Box(55, 56, 10, 11), Box(55, 56, 10, 11, T, T + dt.timedelta(days=9)), Box(start=T, end=T + dt.timedelta(days=2)), Box(), Box(56.9, 57.1, 23.9, 24.1),
        Box(south=61.5), Box(0, 1, 0, 1), Box(50, 62, 24.5, 5.5), Box(55, 55, 10, 10, T, T),
    ],
)
def test_equals_the_plain_filter(index, box):
    own, table = index
    for where in (None, {"mode": "a"}):
        want = table.filter(own.condition(box) & (F.col("mode") == "a" if where else F.lit(True)))
        got = own.search(box, where)
        ids = [r["id"] for r in got.select("id").collect()]
        assert sorted(ids) == sorted(r["id"] for r in want.select("id").collect()) and got.columns == table.columns


def test_few_files_are_read(index):
    own, _ = index
    total = own.bounds().count()
    assert total >= 60 and own.bounds().agg(F.sum("rows"), F.max("rows")).first()[0] == 20_003
    assert own.bounds().agg(F.max("rows")).first()[0] < 900  # the crowded port's rows are many files
    box = Box(55, 56, 10, 11)
    assert 0 < len(own.search(box).inputFiles()) == own.files(box).count() < total / 5
    # about four files a dimension: days alone can't be in fewer than a quarter of them
    assert own.files(Box(start=T, end=T + dt.timedelta(days=2))).count() < total / 3
    # what the filter finds lies in the files that were read
    plan = own.search(box)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(latitude" in plan  # the plan as text cuts long lists


def test_empty_equal_and_clashing(spark, tmp_path):
    none = PlaceIndex.build(spark.createDataFrame([], SCHEMA).drop("_file"), str(tmp_path / "none"))
    assert none.search(Box(0, 1)).count() == 0 and none.search(Box()).count() == 0
    one = PlaceIndex.build(spark.createDataFrame([(1, 5.0, 5.0, T, "a", None)] * 50, SCHEMA).drop("_file"), str(tmp_path / "one"), file_rows=10)
    assert one.search(Box(5, 5, 5, 5, T, T)).count() == 50


def test_neighbours_on_the_curve_are_neighbours(spark):
    points = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
    for names in (["x", "y"], ["x", "y", "z"]):
        order = frame.select(*names).distinct().withColumn("c", curve([F.col(c) for c in names], [(0.0, 8.0)] * len(names))).orderBy("c").collect()
        assert len({r["c"] for r in order}) == len(order) == 8 ** len(names)
        for a, b in zip(order, order[1:]):
            assert sum(abs(a[c] - b[c]) for c in names) == 1
    gap = spark.createDataFrame([(None, 1.0)], "x double, y double").select(curve([F.col("x"), F.col("y")], [(0.0, 8.0)] * 2)).first()[0]
    assert gap is None
