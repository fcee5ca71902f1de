"""Queries for marts that are kept up by deltas."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sketches
from ..operators.delta_marts import DeltaMarts
from ..registry import register
from ..storage import shared_dir, written
from .views import CALLS, CONGESTION, DAILY, visits


@lru_cache(maxsize=1)  # three queries read one store
def _kept_up(spark: SparkSession, d: str) -> DeltaMarts:
    """All visits as three deliveries, with a table that's delivered in error and taken back by the last update."""
    source = shared_dir(spark, "deliveries")
    own = written(visits(spark, d).withColumn("delivery", F.pmod(F.xxhash64("call_id"), F.lit(3))), "visits")
    own.write.partitionBy("delivery").parquet(source)
    own.drop("delivery").withColumn("port_key", F.lit("ERROR")).write.parquet(f"{source}/delivery=error")
    store = DeltaMarts(spark, shared_dir(spark, "delta-marts"))
    for names in ((0, "error"), (0, 1, "error"), (0, 1, 2)):
        store.update([f"{source}/delivery={n}" for n in names])
    return store


@register(
    "sk2_delta_arrivals",
    f"WITH {CALLS} SELECT port_key, vessel_type_norm, arrival_date AS date, count(DISTINCT mmsi) AS arrivals_vessels, count(*) AS arrivals_events FROM calls GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _kept_up(spark, d).arrivals().select("port_key", "vessel_type_norm", "date", "arrivals_vessels", "arrivals_events")


@register(
    "sk2_delta_congestion",
    f"WITH {CALLS}, {DAILY}, {CONGESTION} SELECT port_key, date, arrivals_vessels, arrivals_events, round(median_dwell_minutes, 6) AS median_dwell_minutes, has_dwell, round(congestion_index, 6) AS congestion_index FROM congestion",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _kept_up(spark, d).congestion().select(
        "port_key", "date", "arrivals_vessels", "arrivals_events", F.round("median_dwell_minutes", 6).alias("median_dwell_minutes"), "has_dwell",
        F.round("congestion_index", 6).alias("congestion_index"),
    )


@register(
    "sk2_delta_months",
    f"WITH {CALLS} SELECT port_key, date_trunc('month', arrival_date)::DATE AS month, count(*) AS visits, round(sum(dwell_minutes) / 60, 3) AS hours FROM calls GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Months from the days' parts; the sketches that they carry are held against exact values in the tests."""
    months = sketches.told(_kept_up(spark, d).roll_up(["port_key"], "month"), {"median": 0.5})
    return months.select("port_key", "month", "visits", F.round(F.col("minutes") / 60, 3).alias("hours"))
