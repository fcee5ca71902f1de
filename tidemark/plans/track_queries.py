"""Queries for trajectories, as-of joins, segments, emissions and forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import serialize
from ..functions.clean import vessel_class
from ..operators import emissions, findings, forecast, marts, serving, trajectory
from ..registry import register
from ..storage import written
from . import build
from .views import CALLS, POS, positions, read, visits

#: Events are of one month and of few vessels, orders of many years and customers: visits near them are the same visits with
#: arrivals 80 times and stays 20 times as dense, by vessels numbered modulo 15. Microseconds of the two starts.
_EVENTS_BEGIN, _ORDERS_BEGIN = 1_704_067_200_000_000, 788_918_400_000_000
_NEAR = f"""near AS (SELECT mmsi % 15 AS mmsi, port_key, vessel_type_norm, call_id, make_timestamp({_EVENTS_BEGIN} + (epoch_us(arrival_time) - {_ORDERS_BEGIN}) // 80) AS arrival_time,
  make_timestamp({_EVENTS_BEGIN} + (epoch_us(arrival_time) - {_ORDERS_BEGIN}) // 80 + (epoch_us(departure_time) - epoch_us(arrival_time)) // 20) AS departure_time FROM calls)"""


def _near_visits(spark: SparkSession, d: str) -> DataFrame:
    """The visits of _NEAR. Starts are taken as the session's own, as times without a zone are."""
    own = visits(spark, d)
    at = lambda us: F.unix_micros(F.timestamp_micros(F.lit(us)))
    zone = at(_EVENTS_BEGIN) - marts.micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    begin, end = marts.micros("arrival_time") + zone, marts.micros("departure_time") + zone
    near = F.lit(_EVENTS_BEGIN) + F.floor((begin - _ORDERS_BEGIN) / F.lit(80)).cast("long")
    stay = F.floor((end - begin) / F.lit(20)).cast("long")
    time = lambda us: F.timestamp_micros(us - zone).cast("timestamp_ntz")
    return own.withColumns({"mmsi": F.col("mmsi") % 15, "arrival_time": time(near), "departure_time": time(near + stay)})


_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1, greatest(0, pow(sin(radians(latitude - lag(latitude) OVER w) / 2), 2) + cos(radians(lag(latitude) OVER w)) * cos(radians(latitude)) * pow(sin(radians(longitude - lag(longitude) OVER w) / 2), 2)))))"
_W = "WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)"
_INTERVALS = """raw AS (
  SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9 AS duration_h_raw FROM src WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)
), timed AS (
  SELECT *, least(6.0, greatest(1 / 120e0, coalesce(CASE WHEN duration_h_raw > 0 AND duration_h_raw <= 6 THEN duration_h_raw END,
    median(CASE WHEN duration_h_raw > 0 AND duration_h_raw <= 2 THEN duration_h_raw END) OVER (PARTITION BY mmsi), 1 / 6e0)))::DOUBLE AS duration_h FROM raw
)"""


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), digits).alias(c)


@register("wi1_lag_features", f"""WITH {POS}, d AS (SELECT event_id, speed - lag(speed) OVER w AS ds, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km FROM pos {_W})
SELECT event_id, round(CASE WHEN h > 0 THEN h END, 6) AS delta_h, round(km, 5) AS step_km, round(km / nullif(CASE WHEN h > 0 THEN h END * 1.852, 0), 4) AS speed_estimated_kn, round(ds / nullif(CASE WHEN h > 0 THEN h END, 0), 5) AS acceleration FROM d""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.lagged(positions(spark, d)).select(
        "event_id", _r("delta_h"), _r("step_km", 5), _r("speed_estimated_kn", 4), _r("acceleration", 5),
    )


@register(
    "wi2_course_change",
    f"""WITH {POS}, c AS (SELECT *, (event_id * 37) % 360 AS course FROM pos) SELECT event_id, CASE WHEN lag(course) OVER w IS NOT NULL THEN least(abs(course - lag(course) OVER w), 360 - abs(course - lag(course) OVER w)) END::DOUBLE AS course_change FROM c {_W}""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = trajectory.lagged(positions(spark, d).withColumn("course", (F.col("event_id") * 37) % 360), course="course")
    return own.select("event_id", F.col("course_change").cast("double").alias("course_change"))


@register(
    "wi3_rolling",
    "WITH " + POS + " SELECT event_id, " + ", ".join(
        f"round(avg(speed) OVER w{n}, 6) AS speed_mean_{n}, round(coalesce(stddev_samp(speed) OVER w{n}, 0), 6) AS speed_std_{n}" for n in (3, 5, 10)
    ) + " FROM pos WINDOW " + ", ".join(f"w{n} AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 10)),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = trajectory.rolling(positions(spark, d), "speed")
    return own.select("event_id", *[_r(f"speed_{k}_{n}") for n in (3, 5, 10) for k in ("mean", "std")])


@register(
    "wi5_interval_repair",
    f"""WITH {POS}, src AS (SELECT * FROM pos), {_INTERVALS} SELECT event_id, round(duration_h, 6) AS duration_h, duration_h > 0.5 AS ais_gap_flag FROM timed""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.repaired_intervals(positions(spark, d)).select("event_id", _r("duration_h"), "ais_gap_flag")


@register("wi4_rolling_of_derived", f"""WITH {POS}, c AS (SELECT *, (event_id * 37) % 360 AS course FROM pos), d AS (SELECT *, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h,
  CASE WHEN lag(course) OVER w IS NOT NULL THEN least(abs(course - lag(course) OVER w), 360 - abs(course - lag(course) OVER w)) END::DOUBLE AS cc FROM c {_W}), e AS (SELECT *, km / (CASE WHEN h > 0 THEN h END * 1.852) AS kn FROM d)
SELECT event_id, """ + ", ".join(f"round(avg(kn) OVER w{n}, 5) AS speed_estimated_kn_mean_{n}, round(avg(cc) OVER w{n}, 5) AS course_change_mean_{n}" for n in (5, 10)) + " FROM e WINDOW " + ", ".join(f"w{n} AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10)))
def _(spark: SparkSession, d: str) -> DataFrame:
    own = trajectory.lagged(positions(spark, d).withColumn("course", (F.col("event_id") * 37) % 360), course="course")
    own = trajectory.rolling(trajectory.rolling(own, "speed_estimated_kn", (5, 10), std=False), "course_change", (5, 10), std=False)
    return own.select("event_id", *[_r(f"{c}_mean_{n}", 5) for n in (5, 10) for c in ("speed_estimated_kn", "course_change")])


@register("wi12_suspicious_jumps", f"""WITH {POS}, d AS (SELECT event_id, lag(latitude) OVER w AS prev_latitude, mode AS port, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS minutes, sqrt(pow((latitude - lag(latitude) OVER w) * 111, 2) + pow((longitude - lag(longitude) OVER w) * 111, 2)) AS km FROM pos {_W}),
k AS (SELECT *, km / nullif(minutes / 60, 0) / 1.852 AS kn FROM d)
SELECT event_id, round(prev_latitude, 6) AS prev_latitude, port, round(minutes, 6) AS minutes, round(km, 6) AS jump_km, CASE WHEN km >= 20 THEN 'distance_threshold' ELSE 'speed_threshold' END AS rule
FROM k WHERE minutes > 0 AND minutes <= 30 AND (km >= 20 OR (km >= 5 AND kn >= 40))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumn("locode_norm", F.lit(""))
    return trajectory.suspicious_jumps(rows, port=("locode_norm", "mode")).select(
        "event_id", _r("prev_latitude"), "port", _r("minutes"), _r("jump_km"), "rule",
    )


@register(
    "wi11_position_jumps",
    f"""WITH {POS}, d AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS m, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km FROM pos {_W}) SELECT event_id, coalesce(m > 0 AND m <= 30 AND km >= 80, false) AS jump_flag FROM d""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.position_jumps(positions(spark, d)).select("event_id", "jump_flag")


_SHIFTED = f"""{_NEAR}, placed AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE mmsi END AS vessel, ts AS t FROM pos), right_side AS (
  SELECT mmsi AS m, arrival_time, arg_max(call_id, (departure_time, call_id)) AS call_id, max(departure_time) AS departure_time FROM near GROUP BY ALL)"""


@register("jo1_as_of_visit", f"""WITH {POS}, {CALLS}, {_SHIFTED}
SELECT event_id, CASE WHEN t <= departure_time THEN call_id END AS call_id, coalesce(t <= departure_time, false) AS inside_call FROM placed ASOF LEFT JOIN right_side ON placed.vessel = right_side.m AND placed.t >= right_side.arrival_time""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = positions(spark, d).withColumn("mmsi", F.when(F.col("event_id") % 11 != 0, F.col("mmsi")))
    return trajectory.attach_visits(own, _near_visits(spark, d)).select("event_id", "call_id", "inside_call")


@register("wi6_segments", f"""WITH {POS}, {CALLS}, {_SHIFTED}, src AS (SELECT event_id, vessel AS mmsi, t AS ts, mode, CASE WHEN t <= departure_time THEN call_id END AS call_id FROM placed ASOF LEFT JOIN right_side ON placed.vessel = right_side.m AND placed.t >= right_side.arrival_time WHERE vessel IS NOT NULL), {_INTERVALS},
n AS (SELECT *, (lag(mode) OVER w IS NULL OR mode <> lag(mode) OVER w OR coalesce(call_id, '') <> coalesce(lag(call_id) OVER w, '') OR coalesce(lag(duration_h) OVER w, 0) > 0.5)::INT AS new FROM timed {_W}),
s AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ord FROM n)
SELECT mmsi || '_seg_' || lpad(ord::BIGINT::VARCHAR, 6, '0') AS segment_id, min(mode) AS mode, count(*)::BIGINT AS row_count, round(sum(duration_h), 6) AS duration_h FROM s GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = positions(spark, d).withColumn("mmsi", F.when(F.col("event_id") % 11 != 0, F.col("mmsi")))
    own = trajectory.attach_visits(trajectory.ranged(own), _near_visits(spark, d), keep_null=False)
    own = trajectory.segments(trajectory.repaired_intervals(own), call="call_id")
    return own.groupBy("segment_id").agg(
        F.min("mode").alias("mode"), F.count("*").alias("row_count"), F.round(F.sum("duration_h"), 6).alias("duration_h"),
    )


def _timed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positions with visits, modes and intervals; vessel types follow from vessel numbers."""
    kinds = F.element_at(
        F.array(*map(F.lit, ("oil tanker", "bulk carrier", "container ship", "passenger ship", "pilot", "yacht"))),
        (F.col("mmsi") % 6 + 1).cast("int"),
    )
    own = positions(spark, d).drop("mode").withColumn("speed", F.when(F.col("event_id") % 11 != 0, F.col("speed") % 25))
    # the as-of join deals rows by vessel, and all that follows keeps to that
    own = trajectory.lagged(trajectory.attach_visits(trajectory.ranged(own), _near_visits(spark, d), keep_null=False))
    own = emissions.assign_modes(own.withColumn("speed_estimated_kn", F.least(F.col("speed_estimated_kn"), F.lit(25.0))))
    return trajectory.repaired_intervals(own).withColumn("vessel_class", vessel_class(kinds))


def _emitted(rows: DataFrame) -> DataFrame:
    return emissions.row_emissions(emissions.add_factors(rows))


def _inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positions with visits, modes, intervals, factors and emissions."""
    return _emitted(_timed_rows(spark, d))


def _values(table: dict, *columns: str) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{float(x)}::DOUBLE"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in table.items()) + f") AS t({', '.join(columns)})"


def _flat(table: dict) -> dict:
    return {f"{a}|{b}": x for a, inner in table.items() for b, x in inner.items()}


_ROWS = f"""{POS}, {CALLS}, {_NEAR}, lags AS (
  SELECT mmsi, event_id, ts, CASE WHEN event_id % 11 <> 0 THEN speed % 25 END AS speed, latitude, longitude,
    (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km FROM pos {_W}
), est AS (SELECT *, CASE WHEN km / nullif(CASE WHEN h > 0 THEN h END * 1.852, 0) IS NOT NULL THEN least(km / (h * 1.852), 25.0) ELSE 25.0 END AS speed_estimated_kn FROM lags
), right_side AS (SELECT mmsi AS m, arrival_time, max(departure_time) AS departure_time, arg_max(call_id, (departure_time, call_id)) AS call_id, arg_max(port_key, (departure_time, call_id)) AS port_key FROM near GROUP BY ALL
), joined AS (SELECT e.*, arrival_time, departure_time, CASE WHEN ts <= departure_time THEN call_id END AS call_id, CASE WHEN ts <= departure_time THEN port_key END AS port_key, coalesce(ts <= departure_time, false) AS inside_call,
    speed IS NULL AND speed_estimated_kn IS NOT NULL AS speed_interpolated, greatest(coalesce(speed, speed_estimated_kn, 0), 0) AS speed_kn
  FROM est e ASOF LEFT JOIN right_side r ON e.mmsi = r.m AND e.ts >= r.arrival_time
), src AS (SELECT *, CASE WHEN NOT inside_call THEN 'transit'
    WHEN speed_kn BETWEEN 0.5 AND 8 AND (ts <= arrival_time + INTERVAL 1 HOUR OR ts >= departure_time - INTERVAL 1 HOUR) THEN 'manoeuvring'
    WHEN speed_kn <= 0.5 THEN 'berth' WHEN speed_kn <= 2 THEN 'anchorage' ELSE 'transit' END AS mode FROM joined
), {_INTERVALS}, vessel AS (SELECT * FROM {_values(emissions.VESSELS, 'vessel_class', 'mcr_kw', 'ref_speed_kn', 'fuel', 'engine')}
), fuel AS (SELECT * FROM {_values(emissions.FUELS, 'fuel', 'co2_factor', 'wtt_factor')}
), modes AS (SELECT * FROM {_values(emissions.MODES, 'mode', 'sfc_main', 'sfc_aux', 'sulfur')}
), aux AS (SELECT * FROM {_values(_flat(emissions.AUX_KW), 'k', 'aux_kw')}
), nox AS (SELECT * FROM {_values(_flat(emissions.NOX), 'k', 'nox_factor')}
), pm AS (SELECT * FROM {_values(_flat(emissions.PM), 'k', 'pm_factor')}
), classed AS (SELECT *, ['tanker', 'cargo', 'container', 'passenger', 'service', 'unknown'][mmsi % 6 + 1] AS vessel_class FROM timed
), full_rows AS (
  SELECT c.*, f.fuel, v.engine, co2_factor, wtt_factor, sulfur, nox_factor, pm_factor,
    greatest(0, (mcr_kw * CASE WHEN c.mode IN ('transit', 'manoeuvring') THEN least(1.0, greatest(0.2, pow(speed_kn / ref_speed_kn, 3))) ELSE 0 END * sfc_main + aux_kw * sfc_aux) * duration_h / 1e6) AS fuel_t,
    (c.vessel_class = 'unknown' OR f.fuel = 'MGO' OR v.engine = 'medium_speed_diesel') AS fallback
  FROM classed c JOIN vessel v ON c.vessel_class = v.vessel_class JOIN fuel f ON v.fuel = f.fuel JOIN modes m ON c.mode = m.mode
    JOIN aux ON aux.k = c.mode || '|' || c.vessel_class JOIN nox ON nox.k = v.engine || '|' || c.mode JOIN pm ON pm.k = v.engine || '|' || c.mode
), emitted AS (
  SELECT *, fuel_t * co2_factor AS co2_t, fuel_t * wtt_factor AS wtt_co2e_t, fuel_t * co2_factor + fuel_t * wtt_factor AS wtw_co2e_t, fuel_t * nox_factor AS nox_kg, fuel_t * sulfur * 2000 AS sox_kg, fuel_t * pm_factor AS pm_kg,
    least(0.95, greatest(0.05, sqrt(0.0228) + speed_interpolated::INT * 0.10 + (duration_h > 0.5)::INT * 0.08 + fallback::INT * 0.12)) AS rel_sigma FROM full_rows
), cut AS (SELECT *, (lag(mode) OVER w IS NULL OR mode <> lag(mode) OVER w OR coalesce(call_id, '') <> coalesce(lag(call_id) OVER w, '') OR coalesce(lag(duration_h) OVER w, 0) > 0.5)::INT AS new FROM emitted {_W}
), seg_rows AS (SELECT *, mmsi || '_seg_' || lpad((sum(new) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT::VARCHAR, 6, '0') AS segment_id FROM cut
), segs AS (SELECT segment_id, mmsi, mode, max(call_id) AS call_id, coalesce(max(port_key), 'AT_SEA') AS port_key, min(vessel_class) AS vessel_class, min(ts) AS timestamp_start, max(ts) AS timestamp_end, count(*)::BIGINT AS row_count, sum(duration_h) AS duration_h, avg(fallback::INT) AS fallback_usage_ratio, avg(rel_sigma) AS rel_sigma, sum(fuel_t) AS fuel_t,
    sum(co2_t) AS co2_t, sum(wtw_co2e_t) AS wtw_co2e_t, sum(nox_kg) AS nox_kg, sum(sox_kg) AS sox_kg, sum(pm_kg) AS pm_kg FROM seg_rows GROUP BY ALL), linked AS (SELECT * FROM segs WHERE call_id IS NOT NULL),
daily_port AS (SELECT timestamp_start::DATE AS date, port_key, count(*)::BIGINT AS segments, sum(duration_h) AS duration_h, sum(row_count) AS row_count, avg(fallback_usage_ratio) AS f, least(0.95, greatest(0.05, avg(rel_sigma))) AS s, sum(co2_t) AS co2_t, sum(wtw_co2e_t) AS w, sum(nox_kg) AS nox_kg FROM segs GROUP BY ALL)"""


@register("sfm_modes", f"WITH {_ROWS} SELECT event_id, mode, round(speed_kn, 6) AS speed_kn FROM emitted")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _inventory_rows(spark, d).select("event_id", "mode", _r("speed_kn"))


@register(
    "sfc_row_emissions",
    f"WITH {_ROWS} SELECT event_id, round(fuel_t, 6) AS fuel_t, round(co2_t, 6) AS co2_t, round(wtw_co2e_t, 6) AS wtw_co2e_t, round(nox_kg, 5) AS nox_kg, round(sox_kg, 5) AS sox_kg, round(pm_kg, 5) AS pm_kg, round(rel_sigma, 6) AS rel_sigma FROM emitted",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _inventory_rows(spark, d).select(
        "event_id", _r("fuel_t"), _r("co2_t"), _r("wtw_co2e_t"), _r("nox_kg", 5), _r("sox_kg", 5), _r("pm_kg", 5),
        _r("rel_sigma"),
    )


_PARAMS = "v1"


#: What a segment's totals follow from; segments are cut on these alone, and emissions are added to rows that are cut.
_CUT = (
    "mmsi", "_range", "event_id", "ts", "latitude", "longitude", "mode", "speed_kn", "speed_interpolated", "duration_h", "ais_gap_flag",
    "call_id", "port_key", "vessel_class",
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    cut = trajectory.segments(_timed_rows(spark, d).select(*_CUT), call="call_id")
    return emissions.with_evidence(emissions.segment_totals(_emitted(cut)), _PARAMS)


def _daily_port(segments: DataFrame) -> DataFrame:
    return emissions.roll_up(segments.withColumn("date", F.to_date("timestamp_start")), ["date", "port_key"])


_LABEL = "CASE WHEN ci <= 0.20 AND f <= 0.05 THEN 'high' WHEN ci <= 0.40 OR f <= 0.20 THEN 'medium' ELSE 'low' END"


@register("ag20_segment_totals", f"""WITH {_ROWS} SELECT segment_id, mode, row_count, round(duration_h, 5) AS duration_h, round(wtw_co2e_t, 5) AS wtw_co2e_t, round(nox_kg, 4) AS nox_kg,
  round(greatest(0, wtw_co2e_t * (1 - 1.96 * rel_sigma)), 5) AS wtw_co2e_t_lower, substr(sha1(segment_id || '|v1'), 1, 24) AS evidence_id FROM segs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select(
        "segment_id", "mode", "row_count", _r("duration_h", 5), _r("wtw_co2e_t", 5), _r("nox_kg", 4), _r("wtw_co2e_t_lower", 5),
        "evidence_id",
    )


@register("ag21_daily_roll_up", f"""WITH {_ROWS}, b AS (SELECT *, CASE WHEN w > 0 THEN (greatest(0, w * (1 + 1.96 * s)) - greatest(0, w * (1 - 1.96 * s))) / w ELSE 1 END AS ci FROM daily_port)
SELECT date::VARCHAR AS date, port_key, segments, round(w, 4) AS wtw_co2e_t, round(nox_kg, 3) AS nox_kg, round(w * (1 + 1.96 * s), 4) AS wtw_co2e_t_upper, {_LABEL} AS confidence_label FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = _daily_port(_segments(spark, d))
    return own.select(
        F.col("date").cast("string").alias("date"), "port_key", "segments", _r("wtw_co2e_t", 4), _r("nox_kg", 3),
        _r("wtw_co2e_t_upper", 4), "confidence_label",
    )


@register("ag23_port_emissions_monthly", f"""WITH {_ROWS}, r AS (
  SELECT strftime(timestamp_start, '%Y-%m') AS bucket, port_key, 'call_linked' AS basis, wtw_co2e_t AS w, co2_t, fallback_usage_ratio AS f, greatest(0, wtw_co2e_t * (1 - 1.96 * rel_sigma)) AS lo, greatest(0, wtw_co2e_t * (1 + 1.96 * rel_sigma)) AS hi FROM linked
  UNION ALL SELECT strftime(date, '%Y-%m'), port_key, 'daily_proxy', w, co2_t, f, greatest(0, w * (1 - 1.96 * s)), greatest(0, w * (1 + 1.96 * s)) FROM daily_port WHERE port_key NOT IN (SELECT port_key FROM linked)
), g AS (SELECT bucket, port_key, basis, count(*)::BIGINT AS rows, sum(w) AS w, sum(co2_t) AS co2_t, sum(lo) AS lo, sum(hi) AS hi, avg(f) AS f FROM r GROUP BY ALL), b AS (SELECT *, CASE WHEN w > 0 THEN (hi - lo) / w ELSE 1 END AS ci FROM g), l AS (SELECT *, {_LABEL} AS label FROM b)
SELECT bucket, port_key, basis, rows, round(co2_t, 4) AS co2_t, round(w, 4) AS wtw_co2e_t, round(lo, 4) AS wtw_co2e_t_lower, CASE WHEN basis = 'daily_proxy' AND label = 'high' THEN 'medium' ELSE label END AS confidence_label FROM l""")
def _(spark: SparkSession, d: str) -> DataFrame:
    segments = written(_segments(spark, d), "segments")  # a mart, which is read more than once
    own = emissions.port_emissions(segments, _daily_port(segments), "month")
    return own.select("bucket", "port_key", "basis", "rows", _r("co2_t", 4), _r("wtw_co2e_t", 4), _r("wtw_co2e_t_lower", 4), "confidence_label")


@register("ag25_scope_diagnostics", f"""WITH {_ROWS}, c AS (SELECT port_key, call_id, sum(wtw_co2e_t) AS t, sum(duration_h) AS h FROM linked GROUP BY ALL), p AS (SELECT port_key, count(*)::BIGINT AS calls, avg(t) AS mean_t, median(t) AS median_t, max(t) AS largest_t, max(h) AS longest FROM c GROUP BY ALL),
base AS (SELECT port_key, median(w) AS b FROM daily_port GROUP BY ALL), w AS (SELECT port_key, count(*)::BIGINT AS rows, sum(duration_h) AS h, sum(wtw_co2e_t) AS t FROM segs GROUP BY ALL)
SELECT port_key, rows, coalesce(calls, 0) AS calls, round(h, 4) AS total_duration_h, round(t, 4) AS total_t, round(mean_t, 4) AS mean_t, round(median_t, 4) AS median_t, 0::BIGINT AS repeated,
  concat_ws(',', CASE WHEN longest > 240 THEN 'implausible call duration' END, CASE WHEN largest_t > 500 THEN 'implausible call emissions' END, CASE WHEN b < 1 THEN 'baseline too small' END) AS warnings,
  CASE WHEN b < 1 THEN 'unstable baseline' WHEN longest > 240 OR largest_t > 500 THEN 'warning' ELSE 'checked' END AS sanity_status
FROM w LEFT JOIN p USING (port_key) LEFT JOIN base USING (port_key)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    needed = ("segment_id", "call_id", "port_key", "timestamp_start", "row_count", "duration_h", "fallback_usage_ratio", "rel_sigma", *emissions.POLLUTANTS)
    segments = written(_segments(spark, d).select(*needed), "segments")  # a mart, which is read more than once
    own = emissions.scope_diagnostics(segments, "wtw_co2e_t", ["port_key"], _daily_port(segments))
    return own.select(
        "port_key", "rows", "calls", _r("total_duration_h", 4), _r("total_t", 4), _r("mean_t", 4), _r("median_t", 4), "repeated",
        F.array_join("warnings", ",").alias("warnings"), "sanity_status",
    )


@register(
    "ag28_metrics",
    f"WITH {_ROWS} SELECT round(sum(co2_t), 3) AS total_t, count(DISTINCT call_id)::BIGINT AS calls, round(sum(co2_t) * 1000 / count(DISTINCT call_id), 3) AS kg_per_call, round(sum(co2_t) / count(DISTINCT timestamp_start::DATE), 4) AS t_per_day, round(sum(co2_t) * 1000 / sum(duration_h), 4) AS kg_per_hour FROM linked",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = emissions.call_linked(_segments(spark, d)).withColumn("date", F.to_date("timestamp_start"))
    return emissions.metrics(own, "co2_t").select(_r("total_t", 3), "calls", _r("kg_per_call", 3), _r("t_per_day", 4), _r("kg_per_hour", 4))


@register(
    "ag29_level_bands",
    f"WITH {_ROWS}, p AS (SELECT quantile_cont(wtw_co2e_t, [0.25, 0.5, 0.75]) AS q FROM segs) SELECT segment_id, CASE WHEN wtw_co2e_t <= q[1] THEN 'Low' WHEN wtw_co2e_t <= q[2] THEN 'Moderate' WHEN wtw_co2e_t <= q[3] THEN 'High' ELSE 'Very High' END AS level FROM segs, p",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return emissions.bands(_segments(spark, d), "wtw_co2e_t").select("segment_id", "level")


@register("ag22_monte_carlo_interval", f"""WITH {_ROWS}, t AS (SELECT timestamp_start::DATE::VARCHAR AS date, sum(wtw_co2e_t) AS w, least(0.95, greatest(0.05, avg(rel_sigma))) AS s FROM segs GROUP BY ALL),
n AS (SELECT date, w, s, (('0x' || substr(md5(date || '|a|' || i), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657e0 AS a, (('0x' || substr(md5(date || '|b|' || i), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657e0 AS b FROM t, range(1, 501) AS r(i)),
v AS (SELECT date, w, greatest(0, w * (1 + s * sqrt(-2 * ln(a)) * cos(2 * 3.141592653589793e0 * b))) AS v FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v) AS k FROM v)
SELECT date, round(any_value(w), 4) AS wtw_co2e_t, round(max(v) FILTER (WHERE k = 13), 4) AS wtw_co2e_t_lower, round(max(v) FILTER (WHERE k = 488), 4) AS wtw_co2e_t_upper FROM o GROUP BY date""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = emissions.roll_up(_segments(spark, d).withColumn("date", F.to_date("timestamp_start").cast("string")), ["date"])
    own = emissions.monte_carlo(own.select("date", "wtw_co2e_t", "rel_sigma_weighted"), "wtw_co2e_t", "rel_sigma_weighted", "date")
    return own.select("date", _r("wtw_co2e_t", 4), _r("wtw_co2e_t_lower", 4), _r("wtw_co2e_t_upper", 4))


@register(
    "ce1_estimate",
    """SELECT 'tanker' AS vessel_class, 'manoeuvring' AS mode, round((12000 * greatest(0.2, pow(6 / 13e0, 3)) * 195 + 1250 * 215) * 2 / 1e6, 6) AS fuel_t, round((12000 * greatest(0.2, pow(6 / 13e0, 3)) * 195 + 1250 * 215) * 2 / 1e6 * 3.114, 6) AS co2_t, round((12000 * greatest(0.2, pow(6 / 13e0, 3)) * 195 + 1250 * 215) * 2 / 1e6 * 3.114 * (1 + 1.96 * 0.30), 6) AS co2_t_upper""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return emissions.estimate(spark, "tanker", "manoeuvring", 2, 6).select("vessel_class", "mode", _r("fuel_t"), _r("co2_t"), _r("co2_t_upper"))


_SERIES = "s AS (SELECT o_orderpriority AS port_key, o_orderdate::DATE AS date, count(*)::DOUBLE AS value FROM orders GROUP BY ALL)"
_STEP = """st AS (SELECT *, lag(value) OVER w AS l1, greatest(0, 0.7e0 * coalesce(lag(value, 7) OVER w, lag(value) OVER w) + 0.3e0 * avg(value) OVER (PARTITION BY port_key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) AS prediction FROM s WINDOW w AS (PARTITION BY port_key ORDER BY date)), p AS (SELECT * FROM st WHERE l1 IS NOT NULL)"""


def _series(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("port_key"), F.to_date("o_orderdate").alias("date"), F.lit(1).alias("n"))
    return forecast.series(rows, ["port_key"], "date", "n")


@register("fc1_series", f"WITH {_SERIES} SELECT port_key, date::VARCHAR AS date, value FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).withColumn("date", F.col("date").cast("string"))


@register("wi8_one_step", f"WITH {_SERIES}, {_STEP} SELECT port_key, date::VARCHAR AS date, round(prediction, 6) AS prediction FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.one_step(_series(spark, d), ["port_key"]).select("port_key", F.col("date").cast("string").alias("date"), _r("prediction"))


@register(
    "fc3_residual_std",
    f"WITH {_SERIES}, {_STEP} SELECT port_key, round(stddev_samp(value - prediction), 6) AS residual_std FROM p GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.residual_std(_series(spark, d), ["port_key"]).select("port_key", _r("residual_std"))


_GROWN = f"""WITH RECURSIVE {_SERIES}, {_STEP}, sd AS (SELECT port_key, stddev_samp(value - prediction) AS r FROM p GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS rn FROM s),
seed AS (SELECT port_key, list(value ORDER BY date) AS h, max(date) AS last FROM ranked WHERE rn <= 7 GROUP BY ALL),
f AS (SELECT port_key, last, h, 0 AS step, NULL::DOUBLE AS prediction FROM seed
  UNION ALL SELECT port_key, last, list_concat(h[2:], [greatest(0, 0.7e0 * h[1] + 0.3e0 * list_avg(h))]), step + 1, greatest(0, 0.7e0 * h[1] + 0.3e0 * list_avg(h)) FROM f WHERE step < 28)"""


@register(
    "fc2_recursive_forecast",
    f"""{_GROWN} SELECT f.port_key, step::INT AS step, (last + step::INT)::DATE::VARCHAR AS date, round(prediction, 6) AS prediction, round(greatest(0, prediction - 1.96 * r * sqrt(step)), 5) AS lower, round(prediction + 1.96 * r * sqrt(step), 5) AS upper FROM f JOIN sd USING (port_key) WHERE step > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(_series(spark, d), ["port_key"], 28, least=14).select(
        "port_key", "step", F.col("date").cast("string").alias("date"), _r("prediction"), _r("lower", 5), _r("upper", 5),
    )


@register(
    "fc5_weekday_forecast",
    f"""{_GROWN} SELECT port_key, round(avg(prediction), 6) AS prediction, count(*)::BIGINT AS days FROM f WHERE step > 0 AND isodow(last + step::INT) = 5 GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.congestion_on_weekday(_series(spark, d), ["port_key"], 4).select("port_key", _r("prediction"), "days")


@register(
    "fc9_compare_forecasts",
    f"""{_GROWN} SELECT port_key, round(avg(prediction), 6) AS mean_prediction, round(max(prediction), 6) AS peak_prediction FROM f WHERE step > 0 GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.compare(_series(spark, d), ["port_key"], 28).select("port_key", _r("mean_prediction"), _r("peak_prediction"))


@register("fc7_seasonal_analog", f"""WITH {_SERIES}, t AS (SELECT DATE '1999-06-16' AS d), x AS (SELECT port_key, value, date, month(date) = month(d) AS m, isodow(date) = isodow(d) AS w, abs(day(date) - day(d)) AS gap, weekofyear(date) = weekofyear(d) AS wk FROM s, t WHERE date < d),
c AS (SELECT *, [m AND gap = 0, m AND w AND gap <= 3, m AND w, wk, m, w, true] AS tiers FROM x),
k AS (SELECT port_key, CASE WHEN count(*) FILTER (WHERE tiers[1]) >= 1 THEN 1 WHEN count(*) FILTER (WHERE tiers[2]) >= 2 THEN 2 WHEN count(*) FILTER (WHERE tiers[3]) >= 3 THEN 3 WHEN count(*) FILTER (WHERE tiers[4]) >= 3 THEN 4 WHEN count(*) FILTER (WHERE tiers[5]) >= 5 THEN 5 WHEN count(*) FILTER (WHERE tiers[6]) >= 5 THEN 6 ELSE 7 END AS tier FROM c GROUP BY ALL),
r AS (SELECT port_key, tier, avg(value) AS prediction, count(*)::BIGINT AS samples, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM c JOIN k USING (port_key) WHERE tiers[tier] GROUP BY ALL)
SELECT port_key, tier::INT AS tier, round(prediction, 6) AS prediction, samples, round(CASE WHEN samples = 1 THEN prediction * 0.8 ELSE lo END, 6) AS lower, round(CASE WHEN samples = 1 THEN prediction * 1.2 ELSE hi END, 6) AS upper FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.seasonal_analog(_series(spark, d), ["port_key"], "1999-06-16").select(
        "port_key", "tier", _r("prediction"), "samples", _r("lower"), _r("upper"),
    )


@register("fc8_backtest", f"""WITH {_SERIES}, {_STEP}, e AS (SELECT *, abs(value - prediction) AS err, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS rn FROM p)
SELECT port_key, round(avg(err), 6) AS mae, round(avg(err / greatest(abs(value), 1) * 100), 5) AS mape, count(*)::BIGINT AS days FROM e WHERE rn <= 28 GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.backtest(_series(spark, d), ["port_key"]).select("port_key", _r("mae"), _r("mape", 5), "days")


@register("ag37_backtest_mean", f"""WITH {_SERIES}, {_STEP}, e AS (SELECT *, abs(value - prediction) AS err, row_number() OVER (PARTITION BY port_key ORDER BY date DESC) AS rn FROM p), m AS (SELECT port_key, avg(err) AS mae, avg(err / greatest(abs(value), 1) * 100) AS mape FROM e WHERE rn <= 28 GROUP BY ALL)
SELECT count(*)::BIGINT AS series, round(avg(mae), 6) AS mean_mae, round(avg(mape), 5) AS mean_mape FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return forecast.mean_errors(forecast.backtest(_series(spark, d), ["port_key"])).select("series", _r("mean_mae"), _r("mean_mape", 5))


@register("fc6_for_date", f"""{_GROWN}, l AS (SELECT max(date) AS last FROM s), t AS (SELECT last AS day FROM l UNION ALL SELECT last + 5 FROM l)
SELECT port_key, 'observed' AS basis, date::VARCHAR AS date, round(value, 6) AS prediction FROM s JOIN t ON date = day
UNION ALL SELECT port_key, 'model', day::DATE::VARCHAR, round(prediction, 6) FROM f JOIN t ON (f.last + step::INT)::DATE = day WHERE step > 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.port_key = f.port_key AND s.date = day)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d)
    last = rows.agg(F.max("date")).first()[0]  # one date
    found = [forecast.for_date(rows, ["port_key"], str(day), 28) for day in (last, last + dt.timedelta(days=5))]
    own = found[0].unionByName(found[1]).filter(F.col("basis").isin("observed", "model"))
    return own.select("port_key", "basis", F.col("date").cast("string").alias("date"), _r("prediction"))


@register(
    "wi17_even_sample",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rk, count(*) OVER () AS n FROM events), k AS (SELECT DISTINCT floor(g * ((SELECT max(n) FROM r) - 1)::DOUBLE / 99)::BIGINT AS rk FROM range(100) AS t(g)) SELECT event_id FROM r JOIN k USING (rk)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.even_sample(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 100).select("event_id")


@register(
    "wi18_time_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rk, count(*) OVER () AS n FROM events) SELECT event_id, rk >= floor(n * 0.8e0) AS is_test FROM r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.time_split(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "is_test")


@register(
    "fi18_recent_points",
    """SELECT event_id FROM events WHERE user_id = 8 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 10""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.recent_points(positions(spark, d), 8, start="2024-01-05", end="2024-01-20").select("event_id")


_COURSED = f"""{POS}, c AS (SELECT *, (event_id * 37) % 360 AS course FROM pos), d AS (SELECT mmsi, event_id, ts, speed, speed - lag(speed) OVER w AS ds, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km,
  CASE WHEN lag(course) OVER w IS NOT NULL THEN least(abs(course - lag(course) OVER w), 360 - abs(course - lag(course) OVER w)) END::DOUBLE AS cc FROM c {_W}), a AS (SELECT *, ds / CASE WHEN h > 0 THEN h END AS acc FROM d)"""


def _coursed(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.lagged(positions(spark, d).withColumn("course", (F.col("event_id") * 37) % 360), course="course")


@register(
    "ag38_rule_thresholds",
    f"""WITH {_COURSED} SELECT round(quantile_cont(abs(acc), 0.99), 4) AS spike_kn_h, round(quantile_cont(cc, 0.95), 4) AS jitter_deg, 80.0::DOUBLE AS jump_km, 30.0::DOUBLE AS jump_minutes FROM a""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return serving.thresholds(_coursed(spark, d)).select(_r("spike_kn_h", 4), _r("jitter_deg", 4), "jump_km", "jump_minutes")


_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS age FROM a) WHERE age <= 10)"


@register("ml4_rule_flags", f"""WITH {_COURSED}, {_LAST}, g AS (SELECT mmsi, count(*)::BIGINT AS points, max(abs(acc)) AS acc, stddev_samp(cc) AS cc, bool_or(coalesce(km > 80 AND h * 60 <= 30, false)) AS j FROM l GROUP BY ALL)
SELECT mmsi, points, CASE WHEN points >= 5 THEN 'ok' ELSE 'not_enough_data' END AS status, CASE WHEN points >= 5 THEN concat_ws(',', CASE WHEN acc > 25 THEN 'speed_spike' END, CASE WHEN cc > 35 THEN 'course_jitter' END, CASE WHEN j THEN 'position_jump' END) ELSE '' END AS flags FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = serving.rule_flags(serving.last_points(_coursed(spark, d)))
    return own.select("mmsi", "points", "status", F.array_join("flags", ",").alias("flags"))


@register("ml5_eta_confidence", f"""WITH {_COURSED}, {_LAST}, n AS (SELECT mmsi, count(*) AS points FROM l GROUP BY ALL), p AS (SELECT l.mmsi, ts, CASE WHEN points >= 5 THEN greatest(0, speed * 10 - 100) END AS minutes FROM l JOIN n USING (mmsi) WHERE age = 1)
SELECT mmsi, CASE WHEN minutes IS NULL THEN 'not_enough_data' ELSE 'ok' END AS status, round(minutes, 4) AS eta_minutes, strftime(make_timestamp(epoch_us(ts) + trunc(minutes * 60e6)::BIGINT), '%Y-%m-%d %H:%M:%S') AS eta, round(greatest(0, least(1, 1 - 45 / greatest(minutes, 60))), 6) AS confidence FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    points = serving.last_points(positions(spark, d)).filter("_age = 1")
    guess = F.when(F.col("_points") >= serving.LEAST, F.greatest(F.lit(0.0), F.col("speed") * 10 - 100))  # in place of a model's
    own = serving.confident(points.withColumn("minutes", guess), 45.0)
    return own.select("mmsi", "status", _r("eta_minutes", 4), F.date_format("eta", "yyyy-MM-dd HH:mm:ss").alias("eta"), _r("confidence"))


@register("wi13_findings", f"""WITH {_ROWS}, d AS (SELECT timestamp_start::DATE AS date, round(sum(wtw_co2e_t), 6) AS v FROM segs GROUP BY ALL), c AS (SELECT *, round(v - lag(v) OVER (ORDER BY date), 6) AS ch FROM d),
f AS (SELECT 1 AS k, 'highest' AS finding, arg_min(date, (-v, date)) AS date FROM c UNION ALL SELECT 2, 'lowest', arg_min(date, (v, date)) FROM c
  UNION ALL SELECT 3, 'largest rise', arg_min(date, (-ch, date)) FILTER (WHERE ch > 0) FROM c UNION ALL SELECT 4, 'largest drop', arg_min(date, (ch, date)) FILTER (WHERE ch < 0) FROM c
  UNION ALL SELECT 5, 'selected', arg_min(date, (abs(date - DATE '2024-01-12'), date)) FROM c)
SELECT finding, date::VARCHAR AS date, round(v, 4) AS value FROM f JOIN d USING (date)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    days = _segments(spark, d).groupBy(F.to_date("timestamp_start").alias("date")).agg(F.round(F.sum("wtw_co2e_t"), 6).alias("v"))
    return findings.findings(days, "date", "v", target="2024-01-12").select("finding", F.col("date").cast("string").alias("date"), _r("value", 4))


@register("ag27_uncertainty_summary", f"""WITH {_ROWS} SELECT 'wtw_co2e_t' AS metric, round(sum(wtw_co2e_t), 3) AS point, round(sum(greatest(0, wtw_co2e_t * (1 - 1.96 * rel_sigma))), 3) AS lower, round(sum(greatest(0, wtw_co2e_t * (1 + 1.96 * rel_sigma))), 3) AS upper FROM segs
UNION ALL SELECT 'nox_kg', round(sum(nox_kg), 3), round(sum(greatest(0, nox_kg * (1 - 1.96 * rel_sigma))), 3), round(sum(greatest(0, nox_kg * (1 + 1.96 * rel_sigma))), 3) FROM segs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = findings.uncertainty_summary(_segments(spark, d)).filter(F.col("metric").isin("wtw_co2e_t", "nox_kg"))
    return own.select("metric", _r("point", 3), _r("lower", 3), _r("upper", 3))


@register(
    "ag35_filtered_count",
    "SELECT count(*)::BIGINT AS n, (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE user_id = 8 ORDER BY event_id LIMIT 50)) AS ids FROM events WHERE user_id = 8",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = findings.filtered_count(positions(spark, d), F.col("mmsi") == 8, "event_id")
    return own.select("n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register("pr16_position_records", f"""WITH {POS} SELECT replace(replace(mmsi || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || printf('%.5f', latitude) || '_' || printf('%.5f', longitude), ' ', '_'), ':', '-') AS id,
  'Vessel ' || mmsi || ' at ' || strftime(ts, '%Y-%m-%d %H:%M') || ' was at ' || printf('%.5f', latitude) || ', ' || printf('%.5f', longitude) || ' moving at ' || printf('%.1f', round(speed, 0)) || ' knots.' AS text FROM pos""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return serialize.position_records(positions(spark, d).withColumn("speed", F.round("speed", 0))).select("id", "text")


@register(
    "pr17_visit_records",
    f"""WITH {CALLS} SELECT 'Vessel ' || mmsi || ' called at ' || port_key || ', arriving ' || strftime(arrival_time, '%Y-%m-%d %H:%M') || ' and departing ' || strftime(departure_time, '%Y-%m-%d %H:%M') || '.' AS text FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return serialize.visit_records(visits(spark, d)).select("text")


@register("pr16_position_metadata", f"""WITH {POS} SELECT event_id, mmsi::VARCHAR AS mmsi, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_full, latitude, round(speed, 6) AS speed, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 360 END::DOUBLE AS course, 'UNKNOWN' AS flag_norm, mode AS nav_status_norm,
  CASE WHEN event_id % 5 = 0 THEN 'SEGOT' ELSE 'UNKNOWN' END AS destination_norm, 'UNK' AS country_prefix FROM pos""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumns(
        {
            "course": F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 360), "nav_status": F.upper("mode"),
            "destination": F.when(F.col("event_id") % 5 == 0, "se got"), "source_file": F.col("event_id").cast("string"),
        }
    )
    m = F.col("metadata")
    names = ("mmsi", "timestamp_full", "latitude", "course", "flag_norm", "nav_status_norm", "destination_norm", "country_prefix")
    return serialize.position_records(rows).select(
        m["source_file"].cast("long").alias("event_id"), *[m[c].alias(c) for c in names], F.round(m["speed"], 6).alias("speed"),
    )


@register(
    "pr17_visit_metadata",
    f"""WITH {CALLS} SELECT call_id, mmsi::VARCHAR AS mmsi, strftime(arrival_time, '%Y-%m-%dT%H:%M:%S') AS arrival_full, strftime(departure_time, '%Y-%m-%dT%H:%M:%S') AS departure_full, port_key AS port_name, lower(port_key) AS port_name_norm, 'NA' AS country_prefix, 'RIGA' AS destination_norm, NULL::DOUBLE AS speed FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d).withColumns(
        {
            "locode_norm": F.upper(F.left("port_key", F.lit(5))), "destination_arrival": F.lit("riga!"),
            "source_file": F.col("call_id"),
        }
    )
    m = F.col("metadata")
    names = ("mmsi", "arrival_full", "departure_full", "port_name", "port_name_norm", "country_prefix", "destination_norm", "speed")
    return serialize.visit_records(rows).select(m["source_file"].alias("call_id"), *[m[c].alias(c) for c in names])


@register("sk1_training_rows", f"""WITH {POS}, p AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' ELSE mode END AS destination_norm FROM pos), d AS (SELECT *, CASE WHEN lag(latitude) OVER w IS NOT NULL THEN {_HAVERSINE} END AS km, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h FROM p {_W}),
e AS (SELECT *, km / (CASE WHEN h > 0 THEN h END * 1.852) AS kn FROM d), r AS (SELECT *, avg(kn) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5 FROM e)
SELECT event_id, destination_norm, round(m5, 5) AS speed_estimated_kn_mean_5, round(hour(ts) + minute(ts) / 60e0, 6) AS hour, (isodow(ts) - 1)::INT AS weekday, CASE WHEN event_id % 3 > 0 THEN (event_id % 3) * 60.0 END::DOUBLE AS eta_minutes FROM r WHERE destination_norm <> 'UNKNOWN'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumns(
        {
            "course": (F.col("event_id") * 37) % 360,
            "destination_norm": F.when(F.col("event_id") % 4 == 0, "UNKNOWN").otherwise(F.col("mode")),
            "eta": F.col("ts") + F.make_interval(hours=(F.col("event_id") % 3).cast("int")),
        }
    )
    return build.training_rows(rows).select("event_id", "destination_norm", _r("speed_estimated_kn_mean_5", 5), _r("hour"), "weekday", "eta_minutes")
