"""From raw feeds to written marts: one lazy plan a mart, explicit writes, a capabilities document."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import code_of_destination, eta_minutes, hour_of_day, vessel_class
from ..operators import emissions, marts, retrieval, trajectory
from ..sources import files
from ..storage import written


@dataclass
class Built:
    """Rows written by mart."""

    folder: str
    capabilities: dict


def build_marts(spark: SparkSession, paths: list[str], folder: str) -> Built:
    """events, arrivals, dwell, occupancy, congestion, catalog and capabilities; ValueError where no file is of a known kind."""
    feeds = files.read_feeds(spark, paths)
    if not feeds:
        raise ValueError("no file has a known schema")
    visits = files.visits_from_raw(feeds["visits"]) if "visits" in feeds else None
    positions = files.positions_from_raw(feeds["positions"]) if "positions" in feeds else None
    keys = ["port_key", "vessel_type_norm"]
    daily, hourly = [], []
    if positions is not None:
        proxied = positions.withColumn("port_key", code_of_destination(F.col("destination_norm"))).filter("port_key != ''")
        daily.append(marts.arrivals(proxied, keys, "ts", "day", once_a_vessel=True).withColumn("source_kind", F.lit("positions")))
        hourly.append(marts.arrivals(proxied, keys, "ts", "hour", once_a_vessel=True).withColumn("source_kind", F.lit("positions")))
        tied = written(trajectory.lagged(positions.withColumn("event_id", F.xxhash64("mmsi", "ts", "latitude", "longitude")), course="course"), "lagged")
        for column, widths in (("speed", (3, 5, 10)), ("speed_estimated_kn", (5, 10)), ("course_change", (5, 10))):
            tied = trajectory.rolling(tied, column, widths, std=column == "speed")
        files.write_mart(tied, f"{folder}/events")
        files.write_mart(training_rows(positions), f"{folder}/training_rows")
    if visits is not None:
        daily.append(marts.arrivals(visits, keys, "arrival_time", "day").withColumn("source_kind", F.lit("visits")))
        hourly.append(marts.arrivals(visits, keys, "arrival_time", "hour").withColumn("source_kind", F.lit("visits")))
        stays = marts.dwell(visits)
        files.write_mart(stays, f"{folder}/dwell_time")
        files.write_mart(marts.occupancy(stays, ["port_key"]), f"{folder}/occupancy_hourly")
    for name, parts in (("arrivals_daily", daily), ("arrivals_hourly", hourly)):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        files.write_mart(whole, f"{folder}/{name}")
    arrivals = spark.read.parquet(f"{folder}/arrivals_daily")
    files.write_mart(marts.catalog(arrivals, ["port_key", "source_kind"]), f"{folder}/port_catalog")
    stays = spark.read.parquet(f"{folder}/dwell_time") if visits is not None else spark.createDataFrame(
        [], "port_key string, arrival_date date, dwell_minutes double",
    )
    totals = lambda kind: arrivals.filter(F.col("source_kind") == kind).groupBy("port_key", "date").agg(
        F.sum("arrivals_vessels").alias("arrivals_vessels"), F.sum("arrivals_events").alias("arrivals_events"),
    )
    files.write_mart(
        marts.congestion(marts.prefer_visits(totals("positions"), totals("visits"), ["port_key", "date"]), stays),
        f"{folder}/congestion_daily",
    )
    found = marts.capabilities(arrivals, stays).first().asDict()
    document = {k: str(v) if k.startswith("date") else v for k, v in found.items()}
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/capabilities")
    return Built(folder, document)


def build_inventory(positions: DataFrame, visits: DataFrame, folder: str, factors: dict | str | None = None) -> str:
    """Segments, daily and per-call emissions, evidence and the parameters' version; the hash of the parameters.

    factors: a registry, or the path of a factor document.
    """
    checksum = None
    if isinstance(factors, str):
        document, checksum = files.read_document(positions.sparkSession, factors)
        factors = emissions.from_document(document)
    used = factors or emissions.registry()
    digest = emissions.registry_hash(used)
    rows = trajectory.lagged(trajectory.attach_visits(trajectory.ranged(positions), visits, keep_null=False))  # dealt by vessel and day once
    rows = trajectory.repaired_intervals(emissions.assign_modes(rows))
    rows = emissions.row_emissions(
        emissions.add_factors(rows.withColumn("vessel_class", vessel_class(F.col("vessel_type_norm"))), used), used.get("sigmas"),
    )
    cut = trajectory.segments(rows, call="call_id").drop("_range")
    files.write_mart(emissions.with_evidence(emissions.segment_totals(cut), digest), f"{folder}/segments")
    cut_rows = positions.sparkSession.read.parquet(f"{folder}/segments")
    files.write_mart(emissions.roll_up(cut_rows.withColumn("date", F.to_date("timestamp_start")), ["date", "port_key"]), f"{folder}/daily_port")
    files.write_mart(emissions.roll_up(cut_rows.filter("call_id is not null"), ["call_id", "mmsi"]), f"{folder}/calls")
    files.write_mart(
        cut_rows.select(
            "evidence_id", "segment_id", "mmsi", "call_id", "port_key", "timestamp_start", "timestamp_end", "row_count",
            *emissions.POLLUTANTS,
        ),
        f"{folder}/evidence",
    )
    about = {"version": used.get("version", "built-in"), "hash": digest, "document_sha256": checksum, "interval": "analytic"}
    positions.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params_version")
    return digest


def ensure_inventory(positions: DataFrame, visits: DataFrame, folder: str, factors: dict | str | None = None) -> bool:
    """Build the inventory unless all its tables are there whole; whether it was built."""
    spark = positions.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marks = [there(f"{folder}/{name}/_SUCCESS") for name in ("segments", "daily_port", "calls", "evidence", "params_version")]
    if all(m.getFileSystem(conf).exists(m) for m in marks):
        return False
    build_inventory(positions, visits, folder, factors)
    return True


def training_rows(positions: DataFrame, destinations: DataFrame | None = None) -> DataFrame:
    """Rows that models learn from: features of lagged(), rolling() and the clock, the destination as label and minutes to
    the ETA (null unless positive); rows without a destination drop out. destinations: (destination_norm) to keep."""
    tied = positions if "event_id" in positions.columns else positions.withColumn("event_id", F.xxhash64("mmsi", "ts", "latitude", "longitude"))
    own = written(trajectory.lagged(trajectory.ranged(tied), course="course"), "lagged")  # read again for what each range begins with
    for column, widths in (("speed", (3, 5, 10)), ("speed_estimated_kn", (5, 10)), ("course_change", (5, 10))):
        own = trajectory.rolling(own, column, widths, std=column == "speed")
    own = own.withColumns(
        {
            "hour": hour_of_day(F.col("ts")), "weekday": F.weekday("ts"),
            "eta_minutes": eta_minutes(F.col("ts"), F.col("eta")) if "eta" in own.columns else F.lit(None).cast("double"),
        }
    )
    own = own.drop("_range").filter(F.col("destination_norm").isNotNull() & (F.col("destination_norm") != "UNKNOWN"))
    return own if destinations is None else own.join(
        F.broadcast(destinations.select("destination_norm").distinct().limit(80)), "destination_norm", "left_semi",
    )


def build_chunks(stays: DataFrame, proxy_days: DataFrame, folder: str) -> dict[str, int]:
    """The three chunking strategies as JSON lines, and how many each has."""
    days = marts.port_day(stays, [])
    return {
        "events": files.write_json_lines(retrieval.event_chunks(stays), f"{folder}/events"),
        "port_days": files.write_json_lines(retrieval.port_day_chunks(days, proxy_days), f"{folder}/port_days"),
        "windows": files.write_json_lines(retrieval.window_chunks(stays), f"{folder}/windows"),
    }
