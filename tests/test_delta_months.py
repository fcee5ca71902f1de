"""Folders of the tables that deltas write."""

from __future__ import annotations

import datetime as dt
import os

from tidemark.operators.delta_marts import DeltaMarts


def test_days_of_a_month_share_a_folder(spark, tmp_path):
    at = [dt.datetime(2024, 3, d, 5) for d in range(1, 29)] + [dt.datetime(2024, 4, 1), None]
    own = [(i, "A", "x", a, a and a + dt.timedelta(hours=2)) for i, a in enumerate(at)]
    spark.createDataFrame(own, "mmsi long, port_key string, vessel_type_norm string, arrival_time timestamp, departure_time timestamp").write.parquet(str(tmp_path / "in"))
    store = DeltaMarts(spark, str(tmp_path / "marts"))
    assert store.update([str(tmp_path / "in")]).days == 30
    for table in ("calls", "port_days"):
        folders = {f for f in os.listdir(f"{store.folder}/{table}/v=0") if "=" in f}
        assert folders == {"month=2024-03", "month=2024-04", "month=__HIVE_DEFAULT_PARTITION__"}
    assert store.port_days().count() == store.arrivals().count() == 30
