"""Queries over scopes: whole-day and weekday ranges, call ids, evidence, per-call emissions, merged rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import canonical_call, evidence_id
from ..operators import emissions, findings, learning, marts, questions, retrieval
from ..registry import register
from .track_queries import _LABEL, _PARAMS, _ROWS, _r, _segments
from .views import CALLS, DAILY, POS, positions, read, visits

_FROM, _TO = "1998-01-01", "1998-03-31"
_SEGMENT = "1_seg_000001"


@register(
    "fi5_whole_days",
    f"WITH {CALLS} SELECT call_id, port_key, arrival_time::VARCHAR AS arrival FROM calls WHERE arrival_time >= TIMESTAMP '{_FROM}' AND arrival_time < TIMESTAMP '{_TO}' + INTERVAL 1 DAY",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = questions.dates_whole_days(visits(spark, d), "arrival_time", _FROM, _TO)
    return own.select("call_id", "port_key", F.date_format("arrival_time", "yyyy-MM-dd HH:mm:ss").alias("arrival"))


@register(
    "fi7_weekend_arrivals",
    f"WITH {CALLS}, {DAILY} SELECT port_key, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily WHERE isodow(date) >= 6 GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    daily = marts.arrivals(visits(spark, d), ["port_key"], "arrival_time", "day")
    return questions.weekday_filter(daily, "date", "Weekend").groupBy("port_key").agg(F.sum("arrivals_vessels").alias("arrivals"))


@register(
    "fi14_call_candidates",
    f"WITH {CALLS} SELECT regexp_replace(lower(call_id), '[^a-z0-9]', '', 'g') AS canonical, count(DISTINCT call_id)::BIGINT AS candidates, count(DISTINCT call_id) > 1 AS ambiguous FROM calls GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = visits(spark, d).groupBy(canonical_call(F.col("call_id")).alias("canonical")).agg(F.count_distinct("call_id").alias("candidates"))
    return own.withColumn("ambiguous", F.col("candidates") > 1)


@register(
    "fi17_evidence_lookup",
    f"WITH {_ROWS} SELECT segment_id, mode, row_count FROM segs WHERE substr(sha1(segment_id || '|{_PARAMS}'), 1, 24) = substr(sha1('{_SEGMENT}|{_PARAMS}'), 1, 24)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = evidence_id(F.lit(_SEGMENT), F.lit(_PARAMS))
    return _segments(spark, d).filter(F.col("evidence_id") == wanted).select("segment_id", "mode", "row_count").limit(1)


@register("ag24_call_emissions", f"""WITH {_ROWS}, a AS (SELECT call_id, mmsi, port_key, count(DISTINCT segment_id)::BIGINT AS segments, sum(wtw_co2e_t) AS w, sum(nox_kg) AS nox, least(0.95, greatest(0.05, avg(rel_sigma))) AS s, avg(fallback_usage_ratio) AS f FROM linked GROUP BY ALL),
b AS (SELECT *, CASE WHEN w > 0 THEN (greatest(0, w * (1 + 1.96 * s)) - greatest(0, w * (1 - 1.96 * s))) / w ELSE 1 END AS ci FROM a)
SELECT call_id, mmsi, port_key, segments, round(w, 4) AS wtw_co2e_t, round(nox, 3) AS nox_kg, round(w * (1 + 1.96 * s), 4) AS wtw_co2e_t_upper, {_LABEL} AS confidence_label FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = emissions.roll_up(emissions.call_linked(_segments(spark, d)), ["call_id", "mmsi", "port_key"])
    return own.select("call_id", "mmsi", "port_key", "segments", _r("wtw_co2e_t", 4), _r("nox_kg", 3), _r("wtw_co2e_t_upper", 4), "confidence_label")


@register(
    "ag26_call_trace",
    f"WITH {_ROWS} SELECT call_id, mmsi, min(vessel_class) AS vessel_class, strftime(min(timestamp_start), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(timestamp_end), '%Y-%m-%d %H:%M:%S') AS end, count(*)::BIGINT AS segments, round(sum(duration_h), 4) AS duration_h, round(sum(fuel_t), 4) AS fuel_t, round(sum(co2_t), 4) AS co2_t, round(sum(pm_kg), 3) AS pm_kg, true AS counted_once FROM linked GROUP BY call_id, mmsi",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own, time = findings.call_trace(_segments(spark, d)), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return own.select(
        "call_id", "mmsi", "vessel_class", time("start"), time("end"), "segments", _r("duration_h", 4), _r("fuel_t", 4),
        _r("co2_t", 4), _r("pm_kg", 3), "counted_once",
    )


@register(
    "ag32_arrivals_hourly_by_type",
    f"WITH {CALLS} SELECT port_key, vessel_type_norm, strftime(date_trunc('hour', arrival_time), '%Y-%m-%d %H') AS hour, count(DISTINCT mmsi)::BIGINT AS arrivals_vessels, count(*)::BIGINT AS arrivals_events FROM calls GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.arrivals(visits(spark, d), ["port_key", "vessel_type_norm"], "arrival_time", "hour")
    return own.select(
        "port_key", "vessel_type_norm", F.date_format("datetime_hour", "yyyy-MM-dd HH").alias("hour"), "arrivals_vessels",
        "arrivals_events",
    )


@register(
    "ag34_destination_proxy",
    f"WITH {POS} SELECT mode AS destination, ts::DATE::VARCHAR AS date, count(DISTINCT mmsi)::BIGINT AS vessels, count(*)::BIGINT AS positions FROM pos GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.arrivals(positions(spark, d), ["mode"], "ts", "day")
    return own.select(
        F.col("mode").alias("destination"), F.col("date").cast("string").alias("date"),
        F.col("arrivals_vessels").alias("vessels"), F.col("arrivals_events").alias("positions"),
    )


@register("ag39_class_counts", f"""WITH {CALLS}, c AS (SELECT port_key, count(*) AS n FROM calls GROUP BY ALL ORDER BY n DESC, port_key LIMIT 80),
t AS (SELECT coalesce(max(least), 1) AS least FROM (SELECT least FROM (VALUES (100), (50), (20), (5), (1)) v(least), c WHERE n >= least GROUP BY least HAVING count(*) >= 2))
SELECT port_key, n::BIGINT AS n FROM c, t WHERE n >= least""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return learning.frequent_classes(visits(spark, d), "port_key")


@register(
    "so2_merge_ranked",
    "SELECT * FROM (SELECT 'c' || c_custkey AS id, abs(c_acctbal - 5000) / 5000 AS distance FROM customer UNION ALL SELECT 's' || s_suppkey, abs(s_acctbal - 5000) / 5000 FROM supplier) ORDER BY distance, id LIMIT 20",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ranked = lambda table, key, balance, mark: read(spark, d, table).select(
        F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), (F.abs(F.col(balance) - 5000) / 5000).alias("distance"),
    )
    return retrieval.merge_ranked(ranked("customer", "c_custkey", "c_acctbal", "c"), ranked("supplier", "s_suppkey", "s_acctbal", "s"), 20, "id")
