"""Queries for visit tables and the questions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts, questions
from ..registry import register
from .views import CALLS, CONGESTION, DAILY, POS, positions, read, visits

_PORT, _PORTS = "NATION_6", ["NATION_6", "NATION_2", "NATION_18"]


def _day() -> F.Column:
    return F.col("date").cast("string").alias("date")


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return marts.dwell(visits(spark, d))


def _daily(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return marts.arrivals(visits(spark, d), ["port_key", *keys], "arrival_time", "day")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return marts.congestion(_daily(spark, d), _stays(spark, d))


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), digits).alias(c)


@register(
    "ag1_arrivals_daily_positions",
    f"""WITH {POS} SELECT mode, ts::DATE::VARCHAR AS date, count(DISTINCT mmsi)::BIGINT AS arrivals_vessels, count(DISTINCT mmsi)::BIGINT AS arrivals_events FROM pos GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.arrivals(positions(spark, d), ["mode"], "ts", "day", once_a_vessel=True)
    return own.select("mode", _day(), "arrivals_vessels", "arrivals_events")


@register(
    "ag2_arrivals_hourly_positions",
    f"""WITH {POS} SELECT mode, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(DISTINCT mmsi)::BIGINT AS arrivals_vessels, count(DISTINCT mmsi)::BIGINT AS arrivals_events FROM pos GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.arrivals(positions(spark, d), ["mode"], "ts", "hour", once_a_vessel=True)
    return own.select("mode", F.date_format("datetime_hour", "yyyy-MM-dd HH").alias("hour"), "arrivals_vessels", "arrivals_events")


@register(
    "ag3_arrivals_daily_visits",
    f"""WITH {CALLS} SELECT port_key, vessel_type_norm, arrival_date::VARCHAR AS date, count(DISTINCT mmsi)::BIGINT AS arrivals_vessels, count(*)::BIGINT AS arrivals_events FROM calls GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d, "vessel_type_norm").select("port_key", "vessel_type_norm", _day(), "arrivals_vessels", "arrivals_events")


@register(
    "ag4_arrivals_hourly_visits",
    f"""WITH {CALLS} SELECT port_key, strftime(date_trunc('hour', arrival_time), '%Y-%m-%d %H') AS hour, count(DISTINCT mmsi)::BIGINT AS arrivals_vessels, count(*)::BIGINT AS arrivals_events FROM calls GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.arrivals(visits(spark, d), ["port_key"], "arrival_time", "hour")
    return own.select("port_key", F.date_format("datetime_hour", "yyyy-MM-dd HH").alias("hour"), "arrivals_vessels", "arrivals_events")


@register("ag5_dwell", f"""WITH {CALLS} SELECT call_id, port_key, round(dwell_minutes, 6) AS dwell_minutes FROM calls""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _stays(spark, d).select("call_id", "port_key", _r("dwell_minutes"))


@register("ag6_occupancy_hourly", f"""WITH {CALLS} SELECT port_key, strftime(h, '%Y-%m-%d %H') AS hour, count(DISTINCT mmsi)::BIGINT AS occupancy_vessels, count(*)::BIGINT AS occupancy_events
FROM calls, unnest(generate_series(date_trunc('hour', arrival_time), date_trunc('hour', departure_time), INTERVAL 1 HOUR)) AS g(h) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.occupancy(visits(spark, d), ["port_key"])
    return own.select("port_key", F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "occupancy_vessels", "occupancy_events")


@register(
    "ag7_congestion_daily",
    f"""WITH {CALLS}, {DAILY}, {CONGESTION} SELECT port_key, date::VARCHAR AS date, arrivals_vessels::BIGINT AS arrivals_vessels, arrivals_events::BIGINT AS arrivals_events, round(median_dwell_minutes, 6) AS median_dwell_minutes, has_dwell, round(arrivals_ratio, 6) AS arrivals_ratio, round(dwell_ratio, 6) AS dwell_ratio, round(congestion_index, 6) AS congestion_index FROM congestion""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select(
        "port_key", _day(), "arrivals_vessels", "arrivals_events", _r("median_dwell_minutes"), "has_dwell", _r("arrivals_ratio"),
        _r("dwell_ratio"), _r("congestion_index"),
    )


@register("jo2_prefer_visits_full_outer", """WITH proxy AS (SELECT event_type AS port_key, ts::DATE AS date, count(*) AS n FROM events GROUP BY ALL), own AS (
  SELECT event_type AS port_key, ts::DATE AS date, count(DISTINCT user_id) AS n FROM events WHERE value > 60 GROUP BY ALL UNION ALL SELECT 'extra', DATE '2024-01-01', 1)
SELECT coalesce(o.port_key, p.port_key) AS port_key, coalesce(o.date, p.date)::VARCHAR AS date, coalesce(o.n, p.n)::BIGINT AS n FROM proxy p FULL OUTER JOIN own o ON p.port_key = o.port_key AND p.date = o.date""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("port_key"), F.to_date("ts").alias("date"), "user_id", "value")
    own = e.filter("value > 60").groupBy("port_key", "date").agg(F.count_distinct("user_id").alias("n"))
    own = own.union(spark.sql("SELECT 'extra', DATE '2024-01-01', 1L"))
    return marts.prefer_visits(
        e.groupBy("port_key", "date").agg(F.count("*").alias("n")), own, ["port_key", "date"],
    ).withColumn("date", F.col("date").cast("string"))


@register(
    "ag8_port_catalog",
    f"""WITH {CALLS}, {DAILY} SELECT port_key, min(date)::VARCHAR AS first_seen, max(date)::VARCHAR AS last_seen, sum(arrivals_vessels)::BIGINT AS arrivals_total FROM daily GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.catalog(_daily(spark, d), ["port_key"])
    return own.select("port_key", F.col("first_seen").cast("string"), F.col("last_seen").cast("string"), "arrivals_total")


@register(
    "ag9_capabilities",
    f"""WITH {CALLS}, {DAILY} SELECT min(date)::VARCHAR AS date_min, max(date)::VARCHAR AS date_max, count(DISTINCT port_key)::BIGINT AS ports, count(*) > 0 AS has_port_calls, (SELECT count(dwell_minutes) > 0 FROM calls) AS has_dwell FROM daily""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.capabilities(_daily(spark, d), _stays(spark, d))
    return own.select(F.col("date_min").cast("string"), F.col("date_max").cast("string"), "ports", "has_port_calls", "has_dwell")


@register(
    "ag10_arrivals_range",
    f"""WITH {CALLS}, {DAILY} SELECT date::VARCHAR AS date, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily WHERE port_key = '{_PORT}' AND date BETWEEN '1996-01-01' AND '1997-12-31' AND isodow(date) >= 6 GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = questions.port_filter(_daily(spark, d), _PORT, ("port_key",), ("port_key",))
    own = questions.weekday_filter(questions.dates(own, "date", "1996-01-01", "1997-12-31"), "date", "Weekend")
    return questions.by_day(own).select(_day(), "arrivals")


@register(
    "fi4_last_weeks",
    f"""WITH {CALLS}, {DAILY} SELECT port_key, date::VARCHAR AS date, arrivals_vessels::BIGINT AS arrivals_vessels FROM daily WHERE date > (SELECT max(date) FROM daily) - 56""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.dates(_daily(spark, d), "date", last_weeks=8).select("port_key", _day(), "arrivals_vessels")


@register(
    "fi3_loose_port",
    f"""WITH {CALLS} SELECT call_id, port_key FROM calls WHERE contains(regexp_replace(upper(port_key), '[^A-Z0-9]', '', 'g'), 'NATION1') AND arrival_time >= TIMESTAMP '1996-01-01' AND arrival_time < TIMESTAMP '1998-01-01'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = questions.port_filter_loose(visits(spark, d), "nation-1", ("port_key",))
    return questions.dates_whole_days(own, "arrival_time", "1996-01-01", "1997-12-31").select("call_id", "port_key")


@register(
    "tk1_top_ports",
    f"""WITH {CALLS}, {DAILY} SELECT port_key, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY ALL ORDER BY arrivals DESC, port_key LIMIT 10""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.top_ports(_daily(spark, d))


@register(
    "tk2_peak_day",
    f"""WITH {CALLS}, {DAILY} SELECT date::VARCHAR AS date, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY date ORDER BY arrivals DESC, daily.date LIMIT 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.peak_day(_daily(spark, d)).select(_day(), "arrivals")


@register(
    "ag11_by_weekday",
    f"""WITH {CALLS}, {DAILY} SELECT (isodow(date) - 1)::INT AS weekday, dayname(date) AS day_name, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.by_weekday(_daily(spark, d))


@register(
    "ag11_busiest_weekday",
    f"""WITH {CALLS}, {DAILY} SELECT (isodow(date) - 1)::INT AS weekday, dayname(date) AS day_name, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY ALL ORDER BY arrivals DESC, weekday LIMIT 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.busiest_weekday(_daily(spark, d))


@register("ag12_compare_weekdays", f"""WITH {CALLS}, {DAILY}, t AS (SELECT coalesce(sum(arrivals_vessels) FILTER (WHERE isodow(date) = 1), 0)::BIGINT AS total_a, coalesce(sum(arrivals_vessels) FILTER (WHERE isodow(date) = 5), 0)::BIGINT AS total_b FROM daily)
SELECT total_a, total_b, round(total_a / greatest(total_b, 1), 6) AS ratio, CASE WHEN total_a > total_b THEN 'Monday' ELSE 'Friday' END AS winner FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.compare_weekdays(_daily(spark, d), "Monday", "Friday").select("total_a", "total_b", _r("ratio"), "winner")


@register(
    "ag13_busiest_hour",
    f"""WITH {POS}, h AS (SELECT mode, date_trunc('hour', ts) AS t, count(DISTINCT mmsi) AS n FROM pos GROUP BY ALL) SELECT hour(t)::INT AS hour, sum(n)::BIGINT AS arrivals FROM h GROUP BY ALL ORDER BY arrivals DESC, hour LIMIT 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.busiest_hour(marts.arrivals(positions(spark, d), ["mode"], "ts", "hour", once_a_vessel=True))


@register(
    "ag14_dwell_by_type",
    f"""WITH {CALLS} SELECT vessel_type_norm, round(median(dwell_minutes), 6) AS median_minutes, round(avg(dwell_minutes), 6) AS mean_minutes, count(*)::BIGINT AS visits FROM calls GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.dwell_summary(_stays(spark, d), "vessel_type_norm").select(
        "vessel_type_norm", _r("median_minutes"), _r("mean_minutes"), "visits",
    )


@register(
    "ag14_dwell_overall",
    f"""WITH {CALLS} SELECT round(median(dwell_minutes), 6) AS median_minutes, round(avg(dwell_minutes), 6) AS mean_minutes, count(*)::BIGINT AS visits FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.dwell_summary(_stays(spark, d)).select(_r("median_minutes"), _r("mean_minutes"), "visits")


@register(
    "ag15_vessel_stays",
    f"""WITH {CALLS}, one AS (SELECT mmsi FROM calls GROUP BY mmsi ORDER BY count(*) DESC, mmsi LIMIT 1) SELECT mmsi, count(*)::BIGINT AS stays, round(sum(dwell_minutes) / 60, 6) AS total_hours, round(median(dwell_minutes), 6) AS median_minutes FROM calls WHERE mmsi IN (SELECT mmsi FROM one) GROUP BY mmsi""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = _stays(spark, d)
    one = own.groupBy("mmsi").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "mmsi").first()["mmsi"]
    return questions.stay_totals(questions.vessel_stays(own, str(one))).select(
        F.lit(one).alias("mmsi"), "stays", _r("total_hours"), _r("median_minutes"),
    )


@register(
    "ag16_congestion_by_day",
    f"""WITH {CALLS}, {DAILY}, {CONGESTION} SELECT date::VARCHAR AS date, round(avg(congestion_index), 6) AS mean_index, sum(arrivals_vessels)::BIGINT AS arrivals, round(median(median_dwell_minutes), 6) AS median_dwell FROM congestion GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.congestion_by_day(_index(spark, d)).select(_day(), _r("mean_index"), "arrivals", _r("median_dwell"))


@register(
    "ag16_congestion_peak",
    f"""WITH {CALLS}, {DAILY}, {CONGESTION}, m AS (SELECT date, avg(congestion_index) AS i FROM congestion GROUP BY ALL) SELECT round(avg(i), 6) AS overall_mean, round(max(i), 6) AS peak_index, arg_min(date, (-i, date))::VARCHAR AS peak_date FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return questions.congestion_peak(_index(spark, d)).select(
        _r("overall_mean"), _r("peak_index"), F.col("peak_date").cast("string").alias("peak_date"),
    )


@register("jo5_port_day_with_proxies", f"""WITH {CALLS}, p AS (SELECT port_key, arrival_date AS date, count(*)::BIGINT AS arrivals FROM calls GROUP BY ALL), k AS (SELECT port_key, arrival_date AS date, vessel_type_norm, count(*) AS n FROM calls GROUP BY ALL),
m AS (SELECT port_key, date, arg_min(vessel_type_norm, (-n, vessel_type_norm)) AS top_type FROM k GROUP BY ALL), o AS (SELECT n_name AS port_key, o_orderdate::DATE AS date, count(*)::BIGINT AS positions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT port_key, date::VARCHAR AS date, arrivals, top_type, positions FROM p LEFT JOIN m USING (port_key, date) LEFT JOIN o USING (port_key, date)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    stays = _stays(spark, d)
    modes = marts.most_frequent(
        stays.withColumn("date", F.col("arrival_date")), ["port_key", "date"], "vessel_type_norm",
    ).withColumnRenamed("vessel_type_norm", "top_type")
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    )
    proxy = orders.groupBy(F.col("n_name").alias("port_key"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("positions"))
    own = marts.joined_days(marts.port_day(stays, []), modes, proxy)
    return own.select("port_key", _day(), "arrivals", "top_type", "positions")


@register("ag17_compare_ports", f"""WITH {CALLS}, {DAILY}, {CONGESTION},
a AS (SELECT port_key, sum(arrivals_vessels)::BIGINT AS arrivals FROM daily GROUP BY ALL),
t AS (SELECT port_key, vessel_type_norm, median(dwell_minutes) AS m FROM calls GROUP BY ALL), w AS (SELECT port_key, round(median(m), 6) AS dwell FROM t GROUP BY ALL),
cd AS (SELECT port_key, date, avg(congestion_index) AS m FROM congestion GROUP BY ALL), c AS (SELECT port_key, round(avg(m), 6) AS congestion FROM cd GROUP BY ALL)
SELECT port_key, arrivals, dwell, congestion FROM a LEFT JOIN w USING (port_key) LEFT JOIN c USING (port_key) WHERE port_key IN ('NATION_6', 'NATION_2', 'NATION_18')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = questions.compare_ports_of(_PORTS, visits(spark, d))
    return own.select("port_key", "arrivals", _r("dwell"), _r("congestion"))


@register("ag18_diagnose_day", f"""WITH {CALLS}, day AS (SELECT port_key, arrival_date FROM calls GROUP BY ALL ORDER BY count(*) DESC, port_key, arrival_date LIMIT 1), mine AS (SELECT c.* FROM calls c JOIN day USING (port_key, arrival_date))
SELECT vessel_type_norm, count(DISTINCT mmsi)::BIGINT AS arrivals, round(median(dwell_minutes), 6) AS median_dwell, count(*)::BIGINT AS stays FROM mine GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = _stays(spark, d)
    day = own.groupBy("port_key", "arrival_date").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "port_key", "arrival_date").first()
    return questions.diagnose(
        _daily(spark, d, "vessel_type_norm"), own, day["port_key"], str(day["arrival_date"]),
    ).select("vessel_type_norm", "arrivals", _r("median_dwell"), "stays")


@register(
    "ag19_coverage",
    f"""WITH {CALLS} SELECT min(arrival_date)::VARCHAR AS first, max(arrival_date)::VARCHAR AS last, count(DISTINCT port_key)::BIGINT AS sources, count(*)::BIGINT AS rows FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = questions.coverage(_stays(spark, d), "arrival_date", "port_key")
    return own.select(F.col("first").cast("string"), F.col("last").cast("string"), "sources", "rows")


@register("wi9_arrival_spikes", """WITH d AS (SELECT o_orderpriority AS port_key, o_orderdate::DATE AS date, count(*)::BIGINT AS n FROM orders GROUP BY ALL),
w AS (SELECT *, avg(n) OVER f AS m, stddev_samp(n) OVER f AS s, count(n) OVER f AS k FROM d WINDOW f AS (PARTITION BY port_key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT port_key, date::VARCHAR AS date, n, round(m, 6) AS mean_before, round(s, 6) AS std_before FROM w WHERE k >= 3 AND n > round(m + 2 * s, 9)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    daily = read(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("port_key"), F.to_date("o_orderdate").alias("date"),
    ).agg(F.count("*").alias("n"))
    return questions.spikes(daily, ["port_key"], "n").select("port_key", _day(), "n", _r("mean_before"), _r("std_before"))


@register(
    "wi10_dwell_flags",
    f"""WITH {CALLS} SELECT call_id, dwell_minutes < quantile_cont(dwell_minutes, 0.1) OVER (PARTITION BY port_key) AS short_dwell, dwell_minutes > quantile_cont(dwell_minutes, 0.9) OVER (PARTITION BY port_key) AS long_dwell FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return marts.dwell_flags(_stays(spark, d)).select("call_id", "short_dwell", "long_dwell")


@register("ag30_port_day", f"""WITH {CALLS}, f AS (SELECT *, dwell_minutes < quantile_cont(dwell_minutes, 0.1) OVER (PARTITION BY port_key) AS s, dwell_minutes > quantile_cont(dwell_minutes, 0.9) OVER (PARTITION BY port_key) AS l FROM calls)
SELECT port_key, arrival_date::VARCHAR AS date, count(*)::BIGINT AS arrivals, count(DISTINCT mmsi)::BIGINT AS vessels, round(avg(dwell_minutes), 6) AS mean_dwell, round(median(dwell_minutes), 6) AS median_dwell, sum(s::INT)::BIGINT AS short_dwells, sum(l::INT)::BIGINT AS long_dwells FROM f GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.port_day(marts.dwell_flags(_stays(spark, d)), ["short_dwell", "long_dwell"])
    return own.select("port_key", _day(), "arrivals", "vessels", _r("mean_dwell"), _r("median_dwell"), "short_dwells", "long_dwells")


@register("ag31_port_day_mode", f"""WITH {CALLS}, k AS (SELECT port_key, arrival_date, vessel_type_norm, count(*) AS n FROM calls GROUP BY ALL)
SELECT port_key, arrival_date::VARCHAR AS date, arg_min(vessel_type_norm, (-n, vessel_type_norm)) AS vessel_type_norm FROM k GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = marts.most_frequent(_stays(spark, d).withColumn("date", F.col("arrival_date")), ["port_key", "date"], "vessel_type_norm")
    return own.select("port_key", _day(), "vessel_type_norm")


@register(
    "ag33_route_frequency",
    f"""WITH {CALLS} SELECT port_key, vessel_type_norm, count(*)::BIGINT AS trips, count(DISTINCT mmsi)::BIGINT AS vessels FROM calls GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return marts.route_frequency(visits(spark, d), "port_key", "vessel_type_norm")
