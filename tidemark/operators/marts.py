"""Visit tables: arrivals, dwell, occupancy, congestion, catalog, capabilities.

Visits have (mmsi, port_key, vessel_type_norm, arrival_time, departure_time); any columns may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DWELL_DAYS = 45


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def dwell(visits: DataFrame) -> DataFrame:
    """dwell_minutes of visits of more than 0 and at most 45 days; others drop out."""
    minutes = (micros("departure_time") - micros("arrival_time")) / F.lit(60e6)
    return visits.withColumn("dwell_minutes", minutes).filter(
        (F.col("dwell_minutes") > 0) & (F.col("dwell_minutes") <= MAX_DWELL_DAYS * 1440)
    ).withColumn("arrival_date", F.to_date("arrival_time"))


def arrivals(rows: DataFrame, keys: list[str], time: str, unit: str, once_a_vessel: bool = False) -> DataFrame:
    """Distinct vessels and rows by keys and day or hour; once_a_vessel: a vessel counts once in a group (position reports)."""
    bucket = F.to_date(time).alias("date") if unit == "day" else F.date_trunc("hour", F.col(time)).alias("datetime_hour")
    own = rows.select("mmsi", *keys, bucket)
    names = [*keys, "date" if unit == "day" else "datetime_hour"]
    if once_a_vessel:
        own = own.dropDuplicates(["mmsi", *names])
        return own.groupBy(*names).agg(F.count("*").alias("arrivals_vessels"), F.count("*").alias("arrivals_events"))
    return own.groupBy(*names).agg(F.count_distinct("mmsi").alias("arrivals_vessels"), F.count("*").alias("arrivals_events"))


def occupancy(visits: DataFrame, keys: list[str], unit: str = "hour", max_rows: int | None = None) -> DataFrame:
    """Vessels and stays present in each hour (or day), both ends included; max_rows: no rows if more buckets would arise.

    A stay is +1 in its first bucket and -1 after its last one; for vessels, overlapping stays of one vessel are merged
    first. The changes are summed by bucket and then along the buckets of a group, so rows follow the number of stays and
    of buckets, never their product; only groups' buckets stand in a window.
    """
    if unit == "hour":
        number = lambda c: F.floor(micros(c) / F.lit(3_600_000_000)).cast("int")
        back = lambda n: F.timestamp_seconds(n.cast("long") * 3600).cast(kind)
    else:
        number = lambda c: F.unix_date(F.to_date(c))
        back = lambda n: F.date_from_unix_date(n).cast(kind)
    kind = visits.schema["arrival_time"].dataType
    own = visits.select("mmsi", *keys, number("arrival_time").alias("first"), number("departure_time").alias("last")).filter("last >= first")
    if max_rows is not None and (own.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0) > max_rows:
        own = own.limit(0)
    vessel = Window.partitionBy("mmsi", *keys).orderBy("first", "last")
    reach = F.max("last").over(vessel.rowsBetween(Window.unboundedPreceding, -1))
    # a stay that begins within what the vessel's earlier ones reach only adds what lies beyond
    added = F.when(reach.isNull() | (F.col("first") > reach), F.col("first")).otherwise(reach + 1)
    spans = own.withColumn("begin", F.when(F.col("mmsi").isNotNull(), added))
    change = lambda at, vessels, stays: F.struct(
        at.alias("at"), vessels.cast("long").alias("vessels"), F.lit(stays).cast("long").alias("stays"),
    )
    some = (F.col("begin") <= F.col("last")).cast("int")
    changes = spans.select(*keys, F.inline(F.array(
        change(F.col("first"), F.lit(0), 1), change(F.col("last") + 1, F.lit(0), -1),
        change(F.coalesce("begin", "first"), F.coalesce(some, F.lit(0)), 0), change(F.col("last") + 1, -F.coalesce(some, F.lit(0)), 0),
    )))
    summed = changes.groupBy(*keys, "at").agg(F.sum("vessels").alias("vessels"), F.sum("stays").alias("stays"))
    group = Window.partitionBy(*keys).orderBy("at") if keys else Window.partitionBy(F.lit(0)).orderBy("at")
    run = group.rowsBetween(Window.unboundedPreceding, 0)
    levels = summed.select(
        *keys, "at", F.lead("at").over(group).alias("next"), F.sum("vessels").over(run).alias("occupancy_vessels"),
        F.sum("stays").over(run).alias("occupancy_events"),
    )
    levels = levels.filter("occupancy_events > 0")
    return levels.select(
        *keys, F.explode(F.sequence("at", F.col("next") - 1)).alias("n"), "occupancy_vessels", "occupancy_events",
    ).select(*keys, back(F.col("n")).alias("bucket"), "occupancy_vessels", "occupancy_events")


def prefer_visits(proxy: DataFrame, visits: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of daily totals of two sources; the visits' values come first. Keys that repeat multiply."""
    a, b = proxy.alias("a"), visits.alias("b")
    own = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    values = [c for c in visits.columns if c not in keys]
    return own.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in values])


def congestion(daily: DataFrame, stays: DataFrame) -> DataFrame:
    """Arrivals over the port's median, and dwell likewise where there is any; the index is their sum.

    daily: (port_key, date, arrivals_vessels, arrivals_events); stays: dwell().
    """
    by_day = stays.groupBy("port_key", F.col("arrival_date").alias("date")).agg(F.median("dwell_minutes").alias("median_dwell_minutes"))
    return day_ratios(daily.join(by_day, ["port_key", "date"], "left"))


def day_ratios(days: DataFrame) -> DataFrame:
    """congestion() of days that have median_dwell_minutes already; a window holds a port's days."""
    port = Window.partitionBy("port_key")
    arrivals_ratio = F.try_divide(F.col("arrivals_vessels"), F.nullif(F.median("arrivals_vessels").over(port), F.lit(0)))
    dwell_ratio = F.try_divide(F.col("median_dwell_minutes"), F.nullif(F.median("median_dwell_minutes").over(port), F.lit(0)))
    own = days.select(
        "*", F.col("median_dwell_minutes").isNotNull().alias("has_dwell"),
        F.coalesce(arrivals_ratio, F.lit(0.0)).alias("arrivals_ratio"), dwell_ratio.alias("dwell_ratio"),
    )
    return own.withColumn("congestion_index", F.col("arrivals_ratio") + F.coalesce("dwell_ratio", F.lit(0.0)))


def catalog(daily: DataFrame, keys: list[str]) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.sum("arrivals_vessels").alias("arrivals_total"),
    )


def capabilities(daily: DataFrame, stays: DataFrame) -> DataFrame:
    """One row: what there is to ask about."""
    a = daily.agg(
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count_distinct("port_key").alias("ports"),
        (F.count("*") > 0).alias("has_port_calls"),
    )
    return a.crossJoin(F.broadcast(stays.agg((F.count("dwell_minutes") > 0).alias("has_dwell"))))  # one row by one row


def dwell_flags(stays: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """short_dwell and long_dwell: below and above the port's quantiles, which are aggregated once a port and joined."""
    cuts = stays.groupBy(F.col("port_key").alias("_port")).agg(F.percentile("dwell_minutes", F.array(F.lit(low), F.lit(high))).alias("_cuts"))
    own = stays.join(cuts, F.col("port_key").eqNullSafe(F.col("_port")), "left")
    return own.withColumns(
        {"short_dwell": F.col("dwell_minutes") < F.col("_cuts")[0], "long_dwell": F.col("dwell_minutes") > F.col("_cuts")[1]}
    ).drop("_port", "_cuts")


def port_day(stays: DataFrame, flags: list[str]) -> DataFrame:
    """Count, vessels, mean and median dwell, and sums of flags by port and day."""
    return stays.groupBy("port_key", F.col("arrival_date").alias("date")).agg(
        F.count("*").alias("arrivals"), F.count_distinct("mmsi").alias("vessels"), F.avg("dwell_minutes").alias("mean_dwell"),
        F.median("dwell_minutes").alias("median_dwell"), *[F.sum(F.col(f).cast("long")).alias(f"{f}s") for f in flags],
    )


def joined_days(days: DataFrame, *others: DataFrame) -> DataFrame:
    """Days of ports with what other tables, of one row a port and day, say of them."""
    for other in others:
        days = days.join(other, ["port_key", "date"], "left")
    return days


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value; of several the smallest."""
    return rows.groupBy(*keys).agg(F.mode(value, True).alias(value))


def route_frequency(rows: DataFrame, source: str, target: str) -> DataFrame:
    return rows.groupBy(source, target).agg(F.count("*").alias("trips"), F.count_distinct("mmsi").alias("vessels"))
