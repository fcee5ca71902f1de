"""The analytical questions over visit tables; each returns a small, lazily computed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import marts

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def port_filter(rows: DataFrame, port: str, codes: tuple[str, ...] = ("port_key",), names: tuple[str, ...] = ()) -> DataFrame:
    """Equal code, or a name that contains the token."""
    code, low = port.strip().upper(), port.strip().lower()
    test: Column = F.lit(False)
    for c in codes:
        test = test | (F.upper(c) == code)
    for c in names:
        test = test | F.lower(c).contains(low)
    return rows.filter(test)


def port_filter_loose(rows: DataFrame, token: str, codes: tuple[str, ...]) -> DataFrame:
    """Codes that contain the token, letters and digits only, or the token as it is typed in any case."""
    import re

    bare, low = re.sub("[^A-Z0-9]", "", token.upper()), token.strip().lower()
    test: Column = F.lit(not low)
    for c in codes:
        test = test | F.lower(c).contains(low) if low else test
        test = test | F.regexp_replace(F.upper(c), "[^A-Z0-9]", "").contains(bare) if bare else test
    return rows.filter(F.coalesce(test, F.lit(False)))


def dates(rows: DataFrame, column: str, start: str | None = None, end: str | None = None, last_weeks: int | None = None) -> DataFrame:
    """Inclusive range; last_weeks counts back from the latest date among these rows."""
    own = F.col(column)
    if last_weeks is not None:
        latest = rows.agg(F.max(F.to_date(column)).alias("_latest"))
        rows = rows.crossJoin(F.broadcast(latest)).filter(F.to_date(own) > F.date_sub("_latest", 7 * last_weeks)).drop("_latest")  # one row
    if start is not None:
        rows = rows.filter(own >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(own <= F.lit(end).cast("timestamp_ntz"))
    return rows


def dates_whole_days(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Range whose last day counts to its end."""
    return rows.filter(
        (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (
            F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        )
    )


def weekday_filter(rows: DataFrame, column: str, day: str) -> DataFrame:
    """A weekday's name, Weekend or Weekday."""
    n = F.weekday(column)
    if day == "Weekend":
        return rows.filter(n >= 5)
    if day == "Weekday":
        return rows.filter(n < 5)
    return rows.filter(n == WEEKDAYS.index(day))


def call_linked(rows: DataFrame) -> DataFrame:
    """Rows with a call id that says something."""
    return rows.filter(F.coalesce(F.col("call_id").cast("string"), F.lit("")) != "")


def by_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.sum("arrivals_vessels").alias("arrivals"))


def peak_day(daily: DataFrame) -> DataFrame:
    return by_day(daily).orderBy(F.desc("arrivals"), "date").limit(1)


def top_ports(daily: DataFrame, n: int = 10) -> DataFrame:
    return daily.groupBy("port_key").agg(F.sum("arrivals_vessels").alias("arrivals")).orderBy(F.desc("arrivals"), "port_key").limit(n)


def by_weekday(daily: DataFrame) -> DataFrame:
    return daily.groupBy(
        F.weekday("date").alias("weekday"), F.date_format("date", "EEEE").alias("day_name"),
    ).agg(F.sum("arrivals_vessels").alias("arrivals"))


def busiest_weekday(daily: DataFrame) -> DataFrame:
    return by_weekday(daily).orderBy(F.desc("arrivals"), "weekday").limit(1)


def compare_weekdays(daily: DataFrame, a: str, b: str) -> DataFrame:
    """Totals of two weekdays, their ratio (denominator at least 1) and the winner (the second on a tie)."""
    of = lambda d: F.coalesce(F.sum(F.when(F.weekday("date") == WEEKDAYS.index(d), F.col("arrivals_vessels"))), F.lit(0))
    own = daily.agg(of(a).alias("total_a"), of(b).alias("total_b"))
    return own.select(
        "*", (F.col("total_a") / F.greatest("total_b", F.lit(1))).alias("ratio"),
        F.when(F.col("total_a") > F.col("total_b"), a).otherwise(b).alias("winner"),
    )


def busiest_hour(hourly: DataFrame) -> DataFrame:
    own = hourly.groupBy(F.hour("datetime_hour").cast("int").alias("hour")).agg(F.sum("arrivals_vessels").alias("arrivals"))
    return own.orderBy(F.desc("arrivals"), "hour").limit(1)


def dwell_summary(stays: DataFrame, by: str | None = None) -> DataFrame:
    own = stays.groupBy(by) if by else stays.groupBy()
    return own.agg(F.median("dwell_minutes").alias("median_minutes"), F.avg("dwell_minutes").alias("mean_minutes"), F.count("*").alias("visits"))


def vessel_stays(stays: DataFrame, mmsi: str) -> DataFrame:
    """One vessel's stays, matched on digits."""
    return stays.filter(F.regexp_replace(F.col("mmsi").cast("string"), r"\D", "") == mmsi)


def stay_totals(stays: DataFrame) -> DataFrame:
    return stays.agg(
        F.count("*").alias("stays"), (F.sum("dwell_minutes") / 60).alias("total_hours"),
        F.median("dwell_minutes").alias("median_minutes"),
    )


def congestion_by_day(index: DataFrame) -> DataFrame:
    return index.groupBy("date").agg(
        F.avg("congestion_index").alias("mean_index"), F.sum("arrivals_vessels").alias("arrivals"),
        F.median("median_dwell_minutes").alias("median_dwell"),
    )


def congestion_peak(index: DataFrame) -> DataFrame:
    days = congestion_by_day(index)
    return days.agg(
        F.avg("mean_index").alias("overall_mean"), F.max("mean_index").alias("peak_index"),
        F.max_by("date", F.struct("mean_index", -F.unix_date("date"))).alias("peak_date"),
    )


def compare_ports(ports: list[str], daily: DataFrame, stays: DataFrame, index: DataFrame) -> DataFrame:
    """Arrivals, the median of per-type median dwell, and the mean of daily mean index for each port, in one pass each."""
    a = daily.filter(F.col("port_key").isin(ports)).groupBy("port_key").agg(F.sum("arrivals_vessels").alias("arrivals"))
    d = stays.filter(F.col("port_key").isin(ports)).groupBy("port_key", "vessel_type_norm").agg(F.median("dwell_minutes").alias("m")).groupBy("port_key").agg(F.median("m").alias("dwell"))
    c = index.filter(F.col("port_key").isin(ports)).groupBy("port_key", "date").agg(F.avg("congestion_index").alias("m")).groupBy("port_key").agg(F.avg("m").alias("congestion"))
    return a.join(d, "port_key", "left").join(c, "port_key", "left")


def compare_ports_of(ports: list[str], visits: DataFrame) -> DataFrame:
    """compare_ports() from visits alone: those of the ports are written once, and the three tables are built from them."""
    own = written(
        visits.filter(F.col("port_key").isin(ports)).select(
            "mmsi", "port_key", "vessel_type_norm", "arrival_time", "departure_time",
        ),
        "compared",
    )
    daily, stays = marts.arrivals(own, ["port_key"], "arrival_time", "day"), marts.dwell(own)
    return compare_ports(ports, daily, stays, marts.congestion(daily, stays))


def diagnose(daily_by_type: DataFrame, stays: DataFrame, port: str, day: str) -> DataFrame:
    """One port and day: arrivals by type with that type's dwell."""
    own = daily_by_type.filter(
        (F.col("port_key") == port) & (F.col("date") == F.lit(day).cast("date"))
    ).groupBy("vessel_type_norm").agg(F.sum("arrivals_vessels").alias("arrivals"))
    there = stays.filter(
        (F.col("port_key") == port) & (F.col("arrival_date") == F.lit(day).cast("date"))
    ).groupBy("vessel_type_norm").agg(F.median("dwell_minutes").alias("median_dwell"), F.count("*").alias("stays"))
    return own.join(there, "vessel_type_norm", "left")


def spikes(daily: DataFrame, keys: list[str], value: str, before: int = 7, least: int = 3, sigmas: float = 2.0) -> DataFrame:
    """Rows above mean + sigmas * standard deviation (rounded to nine digits) of up to `before` earlier rows, where there are `least` or more."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-before, -1)
    own = daily.select(
        "*", F.avg(value).over(w).alias("mean_before"), F.stddev_samp(value).over(w).alias("std_before"),
        F.count(value).over(w).alias("n_before"),
    )
    return own.filter((F.col("n_before") >= least) & (F.col(value) > F.round(F.col("mean_before") + sigmas * F.col("std_before"), 9)))


def coverage(rows: DataFrame, date: str, source: str) -> DataFrame:
    return rows.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(source).alias("sources"), F.count("*").alias("rows"))
