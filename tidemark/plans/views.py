"""The engine's visits and positions over the star-schema tables, and the same as SQL for DuckDB.

Visits: a customer is a vessel, a nation a port, an order's date an arrival and a line's shipping date a departure.
Positions: events with coordinates that follow from their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line shipped within 45 days after its order."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("departure_time"))
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("vessel_type_norm"), F.col("o_orderdate").alias("arrival_time"),
    )
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("port_key"))
    own = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(
        (F.col("departure_time") > F.col("arrival_time")) & (
            F.col("departure_time") <= F.col("arrival_time") + F.expr("interval 45 days")
        )
    )
    own = own.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    call = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return own.select(F.col("o_custkey").alias("mmsi"), "port_key", "vessel_type_norm", "arrival_time", "departure_time", call.alias("call_id"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    lat, lon = F.lit(54.0) + (F.col("event_id") % 97) / 50.0, F.lit(10.0) + (F.col("event_id") % 89) / 25.0
    return e.select(
        F.col("user_id").alias("mmsi"), "event_id", "ts", F.col("event_type").alias("mode"), F.col("value").alias("speed"),
        lat.alias("latitude"), lon.alias("longitude"),
    )


CALLS = """calls AS (
  SELECT o_custkey AS mmsi, n_name AS port_key, o_orderpriority AS vessel_type_norm, o_orderdate AS arrival_time, l_shipdate AS departure_time,
    l_orderkey || '-' || l_linenumber AS call_id, o_orderdate::DATE AS arrival_date,
    (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60e6 AS dwell_minutes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 45 DAY)"""
POS = """pos AS (
  SELECT user_id AS mmsi, event_id, ts, event_type AS mode, value AS speed,
    54e0 + (event_id % 97) / 50e0 AS latitude, 10e0 + (event_id % 89) / 25e0 AS longitude FROM events)"""
DAILY = """daily AS (
  SELECT port_key, arrival_date AS date, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM calls GROUP BY ALL)"""
CONGESTION = """dwell_daily AS (
  SELECT port_key, arrival_date AS date, median(dwell_minutes) AS median_dwell_minutes FROM calls GROUP BY ALL
), ratios AS (
  SELECT d.*, median_dwell_minutes,
    coalesce(arrivals_vessels / nullif(median(arrivals_vessels) OVER (PARTITION BY d.port_key), 0), 0) AS arrivals_ratio,
    median_dwell_minutes / nullif(median(median_dwell_minutes) OVER (PARTITION BY d.port_key), 0) AS dwell_ratio
  FROM daily d LEFT JOIN dwell_daily w ON d.port_key = w.port_key AND d.date = w.date
), congestion AS (
  SELECT *, median_dwell_minutes IS NOT NULL AS has_dwell, arrivals_ratio + coalesce(dwell_ratio, 0) AS congestion_index FROM ratios)"""
