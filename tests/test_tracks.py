"""Streams of files in random order against the batch operators over all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import marts, trajectory
from tidemark.streaming import tracks

POSITION = "mmsi long, event_id long, ts timestamp, latitude double, longitude double, mode string, call string"
VISIT = "mmsi long, arrival_time timestamp, departure_time timestamp, call_id string, port_key string"
DAY = dt.datetime(2024, 1, 1)
FAR = DAY + dt.timedelta(days=30)


def positions(seed=1, n=240):
    rng, out = random.Random(seed), []
    at = {v: DAY for v in (1, 2, 3)}
    for i in range(n):
        v = rng.choice([1, 1, 2, 3])
        at[v] += dt.timedelta(minutes=rng.choice([0, 1, 5, 20, 30, 31, 90]))
        out.append((v, i, at[v], 54 + rng.random(), 10 + rng.random(), rng.choice(["moor", "moor", "sail", None]), rng.choice(["c", None, None])))
    return out


def visits(seed=2, n=40):
    rng, out = random.Random(seed), []
    for i in range(n):
        a = DAY + dt.timedelta(minutes=rng.randrange(0, 3000, 10))
        d = rng.choice([None, a, a + dt.timedelta(minutes=rng.randrange(300))])
        out.append((rng.choice([1, 2, 4]), a, d, f"v{i}", rng.choice(["A", "B"])))
    return out + [(1, out[0][1], None, "again", "C"), (None, DAY, None, "none", "D")]


def replay(spark, tmp_path, name, rows, schema, last, parts=4, seed=3):
    """A stream of files, rows dealt to them at random; rows of `last` come in one more file."""
    own, folder = list(rows), str(tmp_path / name)
    random.Random(seed).shuffle(own)
    for i in range(parts):
        spark.createDataFrame(own[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, tmp_path, name, stream):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state"))
    started = query.outputMode("append").trigger(availableNow=True).start()
    assert started.awaitTermination(150)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / f"{name}-out")), started


def state_rows(started):
    return sum(s["numRowsTotal"] for s in started.lastProgress["stateOperators"])


def same(got, want):
    got, want = ([tuple(r) for r in x.collect()] for x in (got, want))
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert len(got) == len(want) > 0 and sorted(got, key=key) == sorted(want, key=key)


END = [(99, -1, FAR, 0.0, 0.0, "m", None)]


@pytest.mark.parametrize("seed", [3, 4])
def test_jumps_in_any_order(spark, tmp_path, seed):
    rows = positions()
    lost = [(1, 9000, DAY - dt.timedelta(days=9), 0.0, 0.0, "m", None), (None, 1, DAY, 1.0, 1.0, "m", None), (1, 2, None, 1.0, 1.0, "m", None)]
    source = replay(spark, tmp_path, "p", rows, POSITION, END, seed=seed)
    spark.createDataFrame(lost, POSITION).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))  # too late, no vessel, no time
    own = spark.createDataFrame(rows, POSITION)
    got, started = run(spark, tmp_path, "jumps", tracks.jumps(source, late="7 days"))
    columns = ["mmsi", "event_id", "ts", F.round("minutes", 6).alias("minutes"), F.round("jump_km", 6).alias("jump_km"), "rule"]
    same(got.select(*columns), trajectory.suspicious_jumps(own).select(*columns))


def test_segments_in_any_order(spark, tmp_path):
    rows = positions(5)
    source = replay(spark, tmp_path, "p", rows, POSITION, END)
    got, _ = run(spark, tmp_path, "segments", tracks.segments(source, call="call", late="7 days"))
    own = spark.createDataFrame(rows, POSITION)
    gap = (F.unix_micros(F.lead("ts").over(trajectory.Window.partitionBy("mmsi").orderBy("ts", "event_id"))) - F.unix_micros("ts")) / F.lit(3.6e9)
    cut = trajectory.segments(own.withColumn("duration_h", gap), call="call")
    want = cut.groupBy("mmsi", "segment_id").agg(F.min_by("mode", F.struct("ts", "event_id")).alias("mode"), F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("rows"))
    columns = ["mmsi", "mode", "start", "last", "rows"]
    same(got.select(*columns), want.select(*columns))


def test_visits_of_another_stream(spark, tmp_path):
    rows, calls = positions(6), visits()
    left = replay(spark, tmp_path, "p", rows, POSITION, END)
    right = replay(spark, tmp_path, "v", calls, VISIT, [(99, FAR, FAR, "end", "E")], parts=2)
    got, _ = run(spark, tmp_path, "visits", tracks.attached_visits(left, right, late="7 days"))
    want = trajectory.attach_visits(spark.createDataFrame(rows, POSITION), spark.createDataFrame(calls, VISIT))
    columns = ["mmsi", "event_id", "ts", "call_id", "port_key", "arrival_time", "departure_time", "inside_call"]
    same(got.select(*columns), want.select(*columns))


def test_state_goes_and_late_rows_on_both_sides(spark, tmp_path):
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    row = lambda i, minutes, lat=54.0: (1, i, at(minutes), lat, 10.0, "m", None)
    folder = str(tmp_path / "p")
    for batch in ([row(1, 0), row(3, 20)], [row(4, 200)], [row(2, 10, 55.0), row(5, 210, 55.0)], [row(6, -600, 99.0), *END]):
        spark.createDataFrame(batch, POSITION).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(POSITION).option("maxFilesPerTrigger", 1).parquet(folder)
    got, started = run(spark, tmp_path, "late", tracks.jumps(source, late="4 hours"))
    # row 2 comes late and within the watermark, so it stands between 1 and 3; row 6 is older than the watermark
    assert sorted(r["event_id"] for r in got.collect()) == [2, 3, 5]
    left = [r for r in spark.read.format("statestore").option("path", str(tmp_path / "late-state")).option("stateVarName", "waiting").load().collect()]
    assert {r["key"]["mmsi"] for r in left} <= {99}
    kept = spark.read.format("statestore").option("path", str(tmp_path / "late-state")).option("stateVarName", "kept").load().collect()
    assert {r["key"]["mmsi"] for r in kept} <= {99}


def test_hours_count_vessels_exactly(spark, tmp_path):
    rows = positions(7)
    source = replay(spark, tmp_path, "p", [*rows, (None, 1, DAY, 1.0, 1.0, "moor", None)], POSITION, END)
    got, _ = run(spark, tmp_path, "hours", tracks.hourly_arrivals(source, ["mode"], late="7 days"))
    own = spark.createDataFrame([*rows, (None, 1, DAY, 1.0, 1.0, "moor", None)], POSITION)
    want = marts.arrivals(own, ["mode"], "ts", "hour")
    same(got.select("mode", "datetime_hour", "arrivals_events", "arrivals_vessels"), want.select("mode", "datetime_hour", "arrivals_events", "arrivals_vessels"))
