"""Marts kept up by deltas against one build of all rows."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
import statistics

import pytest

from tidemark.operators import sketches
from tidemark.operators.delta_marts import DeltaMarts

_SCHEMA = "mmsi long, port_key string, vessel_type_norm string, arrival_time timestamp, departure_time timestamp, mmsi_note string"


def rows(seed, days, n=300):
    rng, out = random.Random(seed), []
    for _ in range(n):
        at = dt.datetime(2024, 3, rng.choice(days), rng.randrange(24))
        stay = rng.choice([-5, 30, 90, 1440 * 50, 600])
        out.append((rng.choice([1, 2, 3, None]), rng.choice(["A", "A", "A", "B", None]), rng.choice(["x", "y"]), at, at + dt.timedelta(minutes=stay), "extra"))
    return out + [(9, "A", "x", None, None, None)]


def expected(held):
    day, port = {}, {}
    for m, p, t, a, d, _ in held:
        date = a and a.date()
        for table, key in ((day, (p, t, date)), (port, (p, date))):
            own = table.setdefault(key, [set(), 0, []])
            own[0].add(m)
            own[1] += 1
            if a and d and dt.timedelta() < d - a <= dt.timedelta(days=45):
                own[2].append((d - a).total_seconds() / 60)
    size = lambda s: len(s - {None})
    return (
        {(*k, size(s), n) for k, (s, n, _) in day.items()},
        {(*k, size(s), n, statistics.median(x) if x else None) for k, (s, n, x) in port.items()},
    )


def held_against(store, held):
    day, port = expected(held)
    got = [tuple(r) for r in store.arrivals().select("port_key", "vessel_type_norm", "date", "arrivals_vessels", "arrivals_events").collect()]
    assert len(got) == len(set(got)) and set(got) == day
    got = [tuple(r) for r in store.port_days().select("port_key", "date", "arrivals_vessels", "arrivals_events", "median_dwell_minutes").collect()]
    assert len(got) == len(set(got)) and set(got) == port


def deliver(spark, folder, own, files=1):
    spark.createDataFrame(own, _SCHEMA).coalesce(files).write.mode("overwrite").parquet(str(folder))


@pytest.fixture
def store(spark, tmp_path):
    return DeltaMarts(spark, str(tmp_path / "marts"))


def parts(store, table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.folder}/{table}/**/*.parquet", recursive=True)}


def test_batches_equal_one_build_and_leave_other_days_alone(spark, store, tmp_path):
    source, a, b, c = tmp_path / "in", rows(1, [1, 2, 3, 4, 5]), rows(2, [4, 5, 6]), rows(3, [6])
    deliver(spark, source / "a one", a)
    first = store.update([str(source)])
    assert (first.version, first.read, first.withdrawn, first.days) == (0, 1, 0, 6)
    held_against(store, a)
    before = parts(store, "arrivals_daily")
    deliver(spark, source / "b", b)
    assert store.update([str(source)]).days == 4
    held_against(store, a + b)
    deliver(spark, source / "c", c)
    assert store.update([str(source)]).days == 2
    held_against(store, a + b + c)
    after = parts(store, "arrivals_daily")
    assert before.items() <= after.items()
    days = {p.split("date=")[1].split("/")[0] for p in after if "/v=2/" in p}
    assert days == {"2024-03-06", "__HIVE_DEFAULT_PARTITION__"}
    assert store.update([str(source)]).version is None and store.versions() == [0, 1, 2]


def test_changed_and_vanished_files(spark, store, tmp_path):
    source, a, b = tmp_path / "in", rows(1, [1, 2, 3]), rows(2, [3, 4])
    deliver(spark, source / "a", a)
    deliver(spark, source / "b", b)
    store.update([str(source)])
    changed = rows(5, [2], 50)
    deliver(spark, source / "b", changed)  # another file takes its place
    got = store.update([str(source)])
    assert (got.read, got.withdrawn) == (1, 1)
    held_against(store, a + changed)  # day 4 is gone
    gone = store.update([str(source / "a")])
    assert (gone.read, gone.withdrawn) == (0, 1)
    held_against(store, a)
    store.update([str(source)])  # comes back
    held_against(store, a + changed)
    # the same place with other contents
    own = glob.glob(f"{source}/b/*.parquet")[0]
    deliver(spark, tmp_path / "other", rows(6, [1, 9], 20))
    os.replace(glob.glob(f"{tmp_path}/other/*.parquet")[0], own)
    os.unlink(f"{source}/b/.{os.path.basename(own)}.crc")
    got = store.update([str(source)])
    assert (got.read, got.withdrawn) == (1, 1)
    held_against(store, a + rows(6, [1, 9], 20))


@pytest.mark.parametrize("table", ["calls", "file_days", "touched", "arrivals_daily", "port_days", "ledger"])
def test_an_update_that_dies_is_done_again(spark, store, tmp_path, monkeypatch, table):
    source, a, b = tmp_path / "in", rows(1, [1, 2]), rows(2, [2, 3])
    deliver(spark, source / "a", a)
    store.update([str(source)])
    deliver(spark, source / "b", b)
    write = DeltaMarts._write

    def dies(self, own, name, v):
        if name == table:
            raise KeyboardInterrupt
        write(self, own, name, v)

    monkeypatch.setattr(DeltaMarts, "_write", dies)
    with pytest.raises(KeyboardInterrupt):
        store.update([str(source)])
    held_against(store, a)
    monkeypatch.undo()
    c = rows(3, [1, 7])  # the source has moved on when the update is done again
    deliver(spark, source / "c", c)
    assert store.update([str(source)]).version == 1
    held_against(store, a + b + c)


def test_no_files_and_no_rows(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    assert store.update([str(tmp_path / "in")]).version is None and store.arrivals().count() == store.congestion().count() == 0
    deliver(spark, tmp_path / "in" / "a", [])
    got = store.update([str(tmp_path / "in")])
    assert got.version == 0 and got.days == 0 and store.arrivals().count() == 0


def test_many_days_are_read_without_a_list(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.operators.delta_marts.MOST_LISTED", 2)
    a = rows(1, [1, 2, 3, 4])
    deliver(spark, tmp_path / "in", a, 3)
    store.update([str(tmp_path / "in")])
    held_against(store, a)


def test_days_merge_to_months(spark, store, tmp_path):
    a = [r for r in rows(1, list(range(1, 29)), 4000)]
    deliver(spark, tmp_path / "in", a)
    store.update([str(tmp_path / "in")])
    for r in sketches.told(store.roll_up(["port_key"], "month"), {"median": 0.5}).collect():
        own = sorted((d - t).total_seconds() / 60 for _, p, _, t, d, _ in a if p == r["port_key"] and t and dt.timedelta() < d - t <= dt.timedelta(days=45))
        assert r["visits"] == len(own) and r["minutes"] == sum(own) and r["distinct_vessels"] == 3
        below, upto = sum(x < r["median"] for x in own), sum(x <= r["median"] for x in own)
        assert below / len(own) - sketches.RANK_ERROR <= 0.5 <= upto / len(own) + sketches.RANK_ERROR
