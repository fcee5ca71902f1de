"""Histories in ranges: the same rows as one window a vessel gives, and no task with a vessel's whole history."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km
from tidemark.operators import trajectory
from tidemark.operators.marts import micros

ROWS = "event_id long, mmsi long, ts timestamp_ntz, mode string, speed double, latitude double, longitude double, extra string"
START = dt.datetime(2024, 1, 1)


def positions(hot=1500, others=500, days=60):
    """One vessel has three quarters of all rows; there are days without any, ties in time, and rows without time or vessel."""
    rng, out = random.Random(4), []
    for i in range(hot + others):
        vessel = 1 if i < hot else rng.choice([2, 3, 4, 5, None])
        ts = START + dt.timedelta(minutes=10 * rng.randrange(days * 144)) if rng.random() < 0.98 else None
        if vessel == 5:
            ts = START + dt.timedelta(days=rng.choice([0, 20, 21]), hours=rng.randrange(24))
        out.append((i, vessel, ts, rng.choice(["transit", "berth"]), rng.choice([None, 1.0, 8.0, 20.0]), rng.uniform(50, 60), rng.uniform(0, 20), "x"))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(positions(), ROWS).repartition(5)


@pytest.fixture(params=[24, 1, 24 * 400])
def hours(monkeypatch, request):
    monkeypatch.setattr(trajectory, "RANGE_H", request.param)


def table(df, key="event_id"):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    found = {r[key]: tuple(plain(v) for v in r) for r in df.collect()}
    assert len(found) == df.count()
    return found


def whole(tie="event_id"):
    return Window.partitionBy("mmsi").orderBy("ts", tie)


def test_lagged(rows, hours):
    w = whole()
    prev = lambda c: F.lag(c).over(w)
    h = (micros("ts") - micros(prev("ts"))) / F.lit(3.6e9)
    want = rows.select("event_id", F.when(h > 0, h).alias("delta_h"), haversine_km(prev("latitude"), prev("longitude"), F.col("latitude"), F.col("longitude")).alias("step_km"), "extra")
    got = trajectory.lagged(rows)
    assert not {"_range", "_kind"} & set(got.columns)
    assert table(got.select("event_id", "delta_h", "step_km", "extra")) == table(want)


def test_rolling(rows, hours):
    out = []
    for n in (3, 10):
        w = whole().rowsBetween(-(n - 1), 0)
        out += [F.avg("speed").over(w), F.coalesce(F.stddev_samp("speed").over(w), F.lit(0.0))]
    got = trajectory.rolling(rows, "speed", (3, 10)).select("event_id", "speed_mean_3", "speed_std_3", "speed_mean_10", "speed_std_10")
    assert table(got) == table(rows.select("event_id", *out))


def one_level_intervals(rows):
    own = rows.withColumn("raw", (micros(F.lead("ts").over(whole())) - micros("ts")) / F.lit(3.6e9))
    usual = F.median(F.when((F.col("raw") > 0) & (F.col("raw") <= 2), F.col("raw"))).over(Window.partitionBy("mmsi"))
    kept = F.when((F.col("raw") > 0) & (F.col("raw") <= 6), F.col("raw"))
    return own.withColumn("duration_h", F.least(F.lit(6.0), F.greatest(F.lit(1 / 120), F.coalesce(kept, usual, F.lit(1 / 6)))))


def test_repaired_intervals(rows, hours):
    got = trajectory.repaired_intervals(rows)
    assert not {"_range", "_kind", "_usual"} & set(got.columns)
    assert table(got.select("event_id", "duration_h")) == table(one_level_intervals(rows).select("event_id", "duration_h"))


def test_segments(rows, hours):
    own = one_level_intervals(rows).withColumn("call_id", F.when(F.col("event_id") % 3 == 0, "a"))
    w = whole()
    prev = lambda c: F.lag(c).over(w)
    new = prev("mode").isNull() | (F.col("mode") != prev("mode")) | (F.coalesce(prev("duration_h"), F.lit(0.0)) > 0.5)
    new = new | (F.coalesce("call_id", F.lit("")) != F.coalesce(prev("call_id"), F.lit("")))
    want = own.withColumn("new", new.cast("int")).withColumn("ord", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = trajectory.segments(own, call="call_id")
    assert table(got.select("event_id", "new_segment", "segment_ord")) == table(want.select("event_id", "new", "ord"))


def visits(n=900):
    rng = random.Random(6)
    out = [(rng.choice([1, 1, 1, 2, 3, None]), START + dt.timedelta(minutes=10 * rng.randrange(-2000, 60 * 144)), i) for i in range(n)]
    return out + [(m, t, i + n) for i, (m, t, _) in enumerate(out[:200])]  # ties in time


def test_as_of(spark, rows, hours):
    right = visits()
    got = trajectory.as_of(rows, spark.createDataFrame(right, "mmsi long, arrival timestamp_ntz, call long"), "mmsi", "ts", "arrival", ["call"], ["call"])
    by = {}
    for m, t, c in right:
        by.setdefault(m, []).append((t, c))
    want = {}
    for event_id, m, ts, *_ in positions():
        fits = [x for x in by.get(m, []) if m is not None and ts is not None and x[0] <= ts]
        want[event_id] = max(fits)[1] if fits else None
    assert {r["event_id"]: r["call"] for r in got.collect()} == want


def test_as_of_numbers(spark):
    left = spark.createDataFrame([("k", 10.0 * 86_400 * i) for i in range(9)], "k string, t double")
    right = spark.createDataFrame([("k", 25.0 * 86_400, "a"), ("k", 26.0 * 86_400, "b"), ("j", 0.0, "c")], "k string, s double, v string")
    got = trajectory.as_of(left, right, "k", "t", "s", ["v"], ["v"])
    assert [r["v"] for r in got.orderBy("t").collect()] == [None] * 3 + ["b"] * 6


def test_no_task_has_a_vessel_s_history(spark, rows):
    """From raw positions to segments, the most rows of a task are those of a few ranges; a window a vessel has 1,500 in one."""
    found = spark.createDataFrame(visits(), "mmsi long, arrival_time timestamp_ntz, n long").selectExpr("mmsi", "arrival_time", "arrival_time + interval 3 hours AS departure_time", "cast(n AS string) AS call_id", "'p' AS port_key")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = trajectory.lagged(trajectory.attach_visits(trajectory.ranged(rows), found, keep_null=False))
        own = trajectory.segments(trajectory.repaired_intervals(own), call="call_id")
        sizes = sorted(Counter(r["task"] for r in own.select("segment_id", F.spark_partition_id().alias("task")).collect()).values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) > 1800 and len(sizes) > 30 and sizes[-1] < 200
