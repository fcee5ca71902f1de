"""Visit marts kept up by deltas: a ledger of files read, and only the days that new, changed or vanished files touch are built again.

A folder has versions, one an update. Version v writes, each in a subfolder v=<v>, arrivals_daily by day, calls and port_days by month:
  calls            cleaned visits of the files read, with the file each row came from
  file_days        which days a file has rows of
  touched          the days that the update built again
  arrivals_daily, port_days   those days' marts
  ledger           files read or withdrawn; its success marker, written last, commits the version
Months keep files few where days have few rows; within a file rows are in order of days.
So files of untouched days stay as they are, a reader sees whole versions, and an update that dies leaves a number that the
next one writes over. One writer at a time.

Distinct vessels and medians of a day are exact. port_days also holds sketches, which roll_up() merges to longer spans
without another look at the rows.

Defined results: rows without an arrival time are the day null; a source without files gives empty marts; a file whose size or
time has changed is read again, and its former rows count no more; rows of a file that changes while it is read are left out
until the next update. The driver holds the paths of an update's new files and at most MOST_LISTED days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, written
from . import marts, sketches

#: Days named in a filter, so that other partitions aren't listed for reading; an update of more reads all.
MOST_LISTED = 4096

_KEYS = ["port_key", "vessel_type_norm"]
#: Partition columns of the tables that have any.
_PARTITIONS = {"calls": "month", "arrivals_daily": "date", "port_days": "month"}
_SCHEMAS = {
    "calls": "mmsi string, port_key string, vessel_type_norm string, dwell_minutes double, file_id long, date date, v int, month string",
    "file_days": "file_id long, date date, v int",
    "touched": "date date, v int",
    "arrivals_daily": "port_key string, vessel_type_norm string, arrivals_vessels long, arrivals_events long, v int, date date",
    "port_days": "port_key string, arrivals_vessels long, arrivals_events long, median_dwell_minutes double, visits long, minutes double, dwell binary, vessels binary, date date, v int, month string",
    "ledger": "file string, file_id long, v int",
}


def _month(date: Column) -> Column:
    """The partition of a day."""
    return F.date_format(date, "yyyy-MM")


def file_id() -> Column:
    """A file's identity as a reader's rows have it: its place, size and time."""
    return F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")


def parquet_visits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of Parquet files with visits, and file_id."""
    rows = spark.read.parquet(*paths)
    return rows.select("mmsi", *_KEYS, "arrival_time", "departure_time", file_id().alias("file_id"))


@dataclass(frozen=True)
class Update:
    """What an update did; version is None where nothing had changed."""

    version: int | None
    read: int = 0
    withdrawn: int = 0
    days: int = 0


class DeltaMarts:
    """Marts in a folder. reader: paths -> visits with file_id()."""

    def __init__(self, spark: SparkSession, folder: str, reader: Callable[[SparkSession, list[str]], DataFrame] = parquet_visits, pattern: str = "*.parquet"):
        self.spark, self.folder, self.reader, self.pattern = spark, folder.rstrip("/"), reader, pattern

    def versions(self) -> list[int]:
        """Committed versions."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(p.suffix("/_SUCCESS")))

    def _read(self, table: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        reader = self.spark.read.schema(_SCHEMAS[table]).option("basePath", f"{self.folder}/{table}")
        return reader.parquet(*[f"{self.folder}/{table}/v={v}" for v in versions])

    def _write(self, rows: DataFrame, table: str, v: int) -> None:
        to = f"{self.folder}/{table}/v={v}"
        if table not in _PARTITIONS:
            rows.write.mode("overwrite").parquet(to)
            return
        by = _PARTITIONS[table]
        own = rows.withColumn("month", _month(F.col("date"))) if by == "month" else rows
        # a large partition is split over several tasks
        own.hint("rebalance", by).sortWithinPartitions(*dict.fromkeys((by, "date"))).write.mode("overwrite").partitionBy(by).parquet(to)

    def _listing(self, paths: list[str]) -> DataFrame:
        """(path, file, file_id) of the source's files; contents aren't read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", True).load(paths)
        return found.select("path", F.col("_metadata.file_path").alias("file"), file_id().alias("file_id"))

    def files(self, versions: list[int]) -> DataFrame:
        """(file, file_id, v) of the files that count, and the version that read them: a file that comes back is read again."""
        last = self._read("ledger", versions).groupBy("file").agg(F.max_by("file_id", "v").alias("file_id"), F.max("v").alias("v"))
        return last.filter("file_id is not null")

    def update(self, paths: list[str]) -> Update:
        """Bring the marts to the files under paths as they are now."""
        had = self.versions()
        v = had[-1] + 1 if had else 0
        now, before = self._listing(paths), self.files(had).select("file", F.col("file_id").alias("was"))
        changes = written(now.join(before, "file", "full_outer").filter(~F.col("file_id").eqNullSafe(F.col("was"))), "changes")
        new, gone = changes.agg(F.count("file_id"), F.count("was")).first()
        if not new and not gone:
            discard(changes)
            return Update(None)
        named = [r["path"] for r in changes.filter("file_id is not null").select("path").toLocalIterator()]
        if new:
            self._write(_cleaned(self.reader(self.spark, named)), "calls", v)
        else:
            self._write(self.spark.createDataFrame([], _SCHEMAS["calls"]).drop("v", "month"), "calls", v)
        every = [*had, v]
        self._write(self._read("calls", [v]).select("file_id", "date").distinct(), "file_days", v)
        ids = changes.select(F.explode(F.array("file_id", "was")).alias("file_id")).filter("file_id is not null").distinct()
        self._write(self._read("file_days", every).join(ids, "file_id", "left_semi").select("date").distinct(), "touched", v)
        read = changes.select("file_id", F.lit(v).alias("v")).filter("file_id is not null")
        live = self.files(had).join(changes.select("file"), "file", "left_anti").select("file_id", "v").unionByName(read)
        touched = self._read("touched", [v]).select("date")
        calls = self._of_days(self._read("calls", every), touched).join(live, ["file_id", "v"], "left_semi")
        self._write(calls.groupBy(*_KEYS, "date").agg(F.count_distinct("mmsi").alias("arrivals_vessels"), F.count("*").alias("arrivals_events")), "arrivals_daily", v)
        self._write(_port_days(calls), "port_days", v)
        days = touched.count()
        self._write(changes.select("file", "file_id"), "ledger", v)  # commits
        discard(changes)
        return Update(v, new, gone, days)

    def _of_days(self, rows: DataFrame, days: DataFrame) -> DataFrame:
        """rows of some days, whose months' partitions alone are read."""
        few = [r[0] for r in days.limit(MOST_LISTED + 1).collect()]
        if len(few) > MOST_LISTED:
            return rows.join(days.withColumnRenamed("date", "_day"), F.col("date").eqNullSafe(F.col("_day")), "left_semi")
        known = [d for d in few if d is not None]
        own = F.col("month").isin(sorted({d.strftime("%Y-%m") for d in known})) & F.col("date").isin(known)
        return rows.filter(own | F.col("month").isNull() if None in few else own)

    def _newest(self, table: str) -> DataFrame:
        """Each day as its last update left it."""
        had = self.versions()
        last = self._read("touched", had).groupBy(F.col("date").alias("_day")).agg(F.max("v").alias("_v"))
        own = self._read(table, had).join(last, F.col("date").eqNullSafe(F.col("_day")) & (F.col("v") == F.col("_v")), "left_semi")
        return own.drop("v", "month")

    def arrivals(self) -> DataFrame:
        """Distinct vessels and rows by port, type and day."""
        return self._newest("arrivals_daily")

    def port_days(self) -> DataFrame:
        return self._newest("port_days").drop("visits", "minutes", "dwell", "vessels")

    def congestion(self) -> DataFrame:
        """marts.congestion(): a port's medians move with every day of it, so ratios are taken when this is read."""
        return marts.day_ratios(self.port_days())

    def roll_up(self, keys: list[str], unit: str | None = None) -> DataFrame:
        """Stays' sketches of days merged by keys and, with a unit, by month or year; see sketches.told()."""
        own = self._newest("port_days")
        span = [] if unit is None else [unit]
        if unit is not None:
            own = own.withColumn(unit, F.trunc("date", unit))
        return sketches.merged(own.filter("visits > 0"), [*keys, *span])


def _cleaned(visits: DataFrame) -> DataFrame:
    minutes = (marts.micros("departure_time") - marts.micros("arrival_time")) / F.lit(60e6)
    return visits.select(
        F.col("mmsi").cast("string").alias("mmsi"), *_KEYS, F.when((minutes > 0) & (minutes <= marts.MAX_DWELL_DAYS * 1440), minutes).alias("dwell_minutes"),
        "file_id", F.to_date("arrival_time").alias("date"),
    )


def _port_days(calls: DataFrame) -> DataFrame:
    """By port and day: exact counts and median of all rows, and the sketches of those with a stay."""
    stay = F.col("dwell_minutes").isNotNull()
    exact = calls.groupBy("port_key", "date").agg(
        F.count_distinct("mmsi").alias("arrivals_vessels"), F.count("*").alias("arrivals_events"),
    )
    parts = calls.groupBy("port_key", "date").agg(
        F.median("dwell_minutes").alias("median_dwell_minutes"), F.count("dwell_minutes").alias("visits"), F.sum("dwell_minutes").alias("minutes"),
        F.kll_sketch_agg_double(F.col("dwell_minutes"), sketches.K).alias("dwell"),
        F.hll_sketch_agg(F.when(stay, F.col("mmsi")), sketches.BITS).alias("vessels"),
    ).withColumnsRenamed({"port_key": "_port", "date": "_day"})
    same = F.col("port_key").eqNullSafe(F.col("_port")) & F.col("date").eqNullSafe(F.col("_day"))
    return exact.join(parts, same).drop("_port", "_day")
