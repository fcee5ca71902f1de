"""Histories over unbounded input that equal the batch operators in whatever order rows arrive: steps and jumps, segments that
split on mode, call and gap, visits attached to positions, exact distinct vessels an hour.

A vessel's rows wait in its state until the watermark has passed them, and are then taken in order of time; a timer at the
earliest waiting row wakes the vessel, so a quiet one costs nothing. What is known of a vessel goes by a timer once no later
row can need it. State is thus the rows within `late` and one row a vessel lately seen.

Rows older than the watermark are dropped by Spark, as are rows without vessel or time here. The session needs the RocksDB
state store (session.build_session sets it). Results are appended when the watermark passes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import planar_km

_MINUTE = 60_000_000  # microseconds, as all times in state


class _InOrder(StatefulProcessor):
    """Subclasses name the columns that wait (`at` among them) and those that are kept, and say what a row does."""

    waits: str
    keeps: str
    gives: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [part.split()[0] for part in self.waits.split(",")]
        self.row = Row(*[part.split()[0] for part in self.gives.split(",")])
        self.waiting = handle.getListState("waiting", self.waits)
        self.first = handle.getValueState("first", "at long")
        self.kept = handle.getValueState("kept", self.keeps)

    def order(self, row: dict) -> tuple:
        raise NotImplementedError

    def take(self, kept: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        """What is kept after a row, and what it gives."""
        raise NotImplementedError

    def ends(self, kept: tuple) -> int:
        """The time after which no row can need what is kept."""
        raise NotImplementedError

    def end(self, kept: tuple) -> list[tuple]:
        return []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own = [tuple(r[n] for n in self.names) for r in rows]
        at = self.names.index("at")
        early = min(r[at] for r in own)
        self.waiting.appendList(own)
        if not self.first.exists() or early < self.first.get()[0]:
            self.first.update((early,))
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._settle(key, timerValues)

    def _settle(self, key: Any, timerValues: Any) -> Iterator[Row]:
        """Take the rows that the watermark has passed, and set the timer to what comes next."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.kept.get() if self.kept.exists() else None
        had, given = kept, []
        if self.first.exists() and self.first.get()[0] <= now:
            rows = [dict(zip(self.names, r, strict=True)) for r in self.waiting.get()]
            rest = [r for r in rows if r["at"] > now]
            for row in sorted((r for r in rows if r["at"] <= now), key=self.order):
                kept, out = self.take(kept, row)
                given += out
            if rest:
                self.waiting.put([tuple(r[n] for n in self.names) for r in rest])
                self.first.update((min(r["at"] for r in rest),))
            else:
                self.waiting.clear()
                self.first.clear()
        if kept is not None and self.ends(kept) <= now:
            given += self.end(kept)
            kept = None
        if kept is not None:
            self.kept.update(kept)
        elif had is not None:
            self.kept.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [self.first.get()[0]] if self.first.exists() else []
        due += [] if kept is None else [self.ends(kept)]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        for out in given:
            yield self.row(*key, *out)

    def close(self) -> None:
        pass


class _Steps(_InOrder):
    waits = "at long, tie long, latitude double, longitude double"
    keeps = "at long, latitude double, longitude double"
    gives = "mmsi long, tie long, at long, minutes double, prev_latitude double, prev_longitude double, latitude double, longitude double"

    def __init__(self, minutes: float):
        self.most = int(minutes * _MINUTE)

    def order(self, row: dict) -> tuple:
        return row["at"], row["tie"]

    def take(self, kept: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        place = (row["latitude"], row["longitude"])
        out = []
        if kept is not None and 0 < row["at"] - kept[0] <= self.most:
            out = [(row["tie"], row["at"], (row["at"] - kept[0]) / _MINUTE, kept[1], kept[2], *place)]
        return (row["at"], *place), out

    def ends(self, kept: tuple) -> int:
        return kept[0] + self.most


class _Segments(_InOrder):
    waits = "at long, tie long, mode string, call string"
    keeps = "mode string, call string, start long, last long, rows long, modes string"
    gives = "mmsi long, mode string, call string, start long, last long, rows long"
    gap = 30 * _MINUTE

    def order(self, row: dict) -> tuple:
        return row["at"], row["tie"]

    def take(self, kept: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        mode, call, at = row["mode"], row["call"], row["at"]
        fresh = (mode, call, at, at, 1, mode)
        if kept is None:
            return fresh, []
        before = kept[5]  # the mode of the row before; a row without one stays in its segment, and the next begins another
        if before is None or (mode is not None and mode != before) or at - kept[3] > self.gap or (call or "") != (kept[1] or ""):
            return fresh, self.end(kept)
        return (kept[0], call, kept[2], at, kept[4] + 1, mode), []

    def ends(self, kept: tuple) -> int:
        return kept[3] + self.gap

    def end(self, kept: tuple) -> list[tuple]:
        return [kept[:5]]


class _Attached(_InOrder):
    waits = "at long, side int, tie long, departure long, call_id string, port_key string"
    keeps = "arrival long, departure long, call_id string, port_key string"
    gives = "mmsi long, tie long, at long, call_id string, port_key string, arrival long, departure long, inside_call boolean"

    def order(self, row: dict) -> tuple:
        low = lambda x, least: (x is not None, least if x is None else x)
        return row["at"], row["side"], low(row["departure"], 0), low(row["call_id"], ""), low(row["tie"], 0)

    def take(self, kept: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        if not row["side"]:
            return (row["at"], row["departure"], row["call_id"], row["port_key"]), []
        inside = kept is not None and kept[1] is not None and row["at"] <= kept[1]
        found = (kept[2], kept[3], kept[0], kept[1]) if inside else (None,) * 4
        return kept, [(row["tie"], row["at"], *found, inside)]

    def ends(self, kept: tuple) -> int:
        # later positions are past its departure and stand alone
        return kept[0] if kept[1] is None else max(kept[0], kept[1])


def _timed(stream: DataFrame, time: str, late: str, *columns) -> DataFrame:
    own = stream.filter(F.col("mmsi").isNotNull() & F.col(time).isNotNull()).withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return own.select(F.col("mmsi").cast("long").alias("mmsi"), "_ts", F.unix_micros("_ts").alias("at"), *columns)


def _run(own: DataFrame, processor: _InOrder) -> DataFrame:
    return own.groupBy("mmsi").transformWithState(processor, processor.gives, "append", "eventTime")


def _back(at: str) -> Any:
    return F.timestamp_micros(F.col(at)).alias(at)


def jumps(
    stream: DataFrame, tie: str = "event_id", max_minutes: float = 30, km: float = 20, knots: float = 40, least_km: float = 5,
    late: str = "2 hours",
) -> DataFrame:
    """trajectory.suspicious_jumps() of a stream: (mmsi, tie, ts, minutes, jump_km, rule). Rows without a place are no steps."""
    placed = stream.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    own = _timed(placed, "ts", late, F.col(tie).cast("long").alias("tie"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    steps = _run(own, _Steps(max_minutes)).withColumn(
        "jump_km", planar_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")),
    )
    far = F.col("jump_km") >= km
    fast = (F.col("jump_km") >= least_km) & (F.col("jump_km") / (F.col("minutes") / 60.0) / 1.852 >= knots)
    rule = F.when(far, "distance_threshold").otherwise("speed_threshold").alias("rule")
    return steps.filter(far | fast).select("mmsi", F.col("tie").alias(tie), F.timestamp_micros("at").alias("ts"), "minutes", "jump_km", rule)


def segments(stream: DataFrame, tie: str = "event_id", call: str | None = None, late: str = "2 hours") -> DataFrame:
    """trajectory.segments() of a stream, one row a segment once it has ended: (mmsi, mode, call, start, last, rows). mode is its
    first row's. Gaps are of the rows' times, as a usual interval that repairs them isn't known in a stream."""
    mark = F.col(call).cast("string") if call else F.lit(None).cast("string")
    own = _timed(stream, "ts", late, F.col(tie).cast("long").alias("tie"), F.col("mode").cast("string").alias("mode"), mark.alias("call"))
    return _run(own, _Segments()).select("mmsi", "mode", "call", _back("start"), _back("last"), "rows")


def attached_visits(positions: DataFrame, visits: DataFrame, tie: str = "event_id", late: str = "2 hours") -> DataFrame:
    """trajectory.attach_visits() of two streams: each position with the latest visit begun at or before it, cleared past its
    departure. Either stream may run ahead: the watermark is the slower one's."""
    none = lambda kind: F.lit(None).cast(kind)
    left = _timed(
        positions, "ts", late, F.lit(1).alias("side"), F.col(tie).cast("long").alias("tie"), none("long").alias("departure"),
        none("string").alias("call_id"), none("string").alias("port_key"),
    )
    right = _timed(
        visits, "arrival_time", late, F.lit(0).alias("side"), none("long").alias("tie"),
        F.unix_micros(F.col("departure_time").cast("timestamp")).alias("departure"), F.col("call_id").cast("string").alias("call_id"),
        F.col("port_key").cast("string").alias("port_key"),
    )
    found = _run(left.unionByName(right), _Attached())
    return found.select(
        "mmsi", F.col("tie").alias(tie), F.timestamp_micros("at").alias("ts"), "call_id", "port_key", F.timestamp_micros("arrival").alias("arrival_time"),
        F.timestamp_micros("departure").alias("departure_time"), "inside_call",
    )


def hourly_arrivals(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Rows and exact distinct vessels an hour: vessels are gathered first, so a busy port's hour is many groups, and counted
    when the hour closes. A null vessel counts as rows only."""
    own = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    vessels = own.groupBy(F.window("_ts", "1 hour"), *keys, "mmsi").agg(F.count("*").alias("n"))
    hours = vessels.groupBy(F.window("window", "1 hour").alias("hour"), *keys)
    out = hours.agg(F.sum("n").alias("arrivals_events"), F.count("mmsi").alias("arrivals_vessels"))
    return out.select(*keys, F.col("hour.start").alias("datetime_hour"), "arrivals_events", "arrivals_vessels")
