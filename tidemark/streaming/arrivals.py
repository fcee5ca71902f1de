"""The batch operators over unbounded input: hourly arrivals, sessions, jumps of position."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_arrivals(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Rows and (approximately) vessels an hour; windows close `late` after the newest row."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), *keys).agg(
        F.count("*").alias("arrivals_events"), F.approx_count_distinct("mmsi").alias("arrivals_vessels"),
    ).select(*keys, F.col("window.start").alias("datetime_hour"), "arrivals_events", "arrivals_vessels")


def sessions(stream: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a vessel's rows without a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), "mmsi").agg(F.count("*").alias("rows")).select(
        "mmsi", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows",
    )


def jumps(stream: DataFrame, max_minutes: float = 30, km: float = 20, knots: float = 40, least_km: float = 5, late: str = "2 hours") -> DataFrame:
    """trajectory.suspicious_jumps() of a stream: steps of up to max_minutes that are long, or fast and not short, with their
    rule. The state of a vessel is its latest position, and goes six hours (of the rows' time) after it; rows of one batch
    are ordered by time, and a row that is older than the state is compared with it and doesn't replace it."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        at = rows["ts"].map(pd.Timestamp.timestamp).to_numpy(float)
        lat, lon = rows["latitude"].to_numpy(float), rows["longitude"].to_numpy(float)
        last = state.get if state.exists else (np.nan, np.nan, np.nan)
        before = [np.concatenate([[x], own[:-1]]) for x, own in zip(last, (at, lat, lon), strict=True)]
        minutes, far = (at - before[0]) / 60, 111 * np.hypot(lat - before[1], lon - before[2])
        with np.errstate(divide="ignore", invalid="ignore"):
            fast = (far >= least_km) & (far / (minutes / 60) / 1.852 >= knots)
        found = (minutes > 0) & (minutes <= max_minutes) & ((far >= km) | fast)
        if not state.exists or at[-1] >= last[0]:
            last = (float(at[-1]), float(lat[-1]), float(lon[-1]))
        state.update(last)
        state.setTimeoutTimestamp(max(int(last[0] * 1000), state.getCurrentWatermarkMs()) + 6 * 3600 * 1000)
        if found.any():
            rule = np.where(far >= km, "distance_threshold", "speed_threshold")
            yield pd.DataFrame(
                {
                    "mmsi": key[0], "ts": rows["ts"].to_numpy()[found], "minutes": minutes[found], "jump_km": far[found],
                    "rule": rule[found],
                }
            )

    own = stream.select("mmsi", F.col("ts").cast("timestamp").alias("ts"), "latitude", "longitude").withWatermark("ts", late)
    return own.groupBy("mmsi").applyInPandasWithState(
        step, "mmsi long, ts timestamp, minutes double, jump_km double, rule string", "at double, lat double, lon double",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
