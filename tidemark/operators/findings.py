"""What stands out in a small series, and summaries of emissions results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .emissions import POLLUTANTS


def findings(series: DataFrame, date: str, value: str, target: str | None = None, most: int = 5) -> DataFrame:
    """(finding, date, value): highest, lowest (where it is another bucket), largest rise and largest drop to the bucket
    before (the value of the bucket), selected (the bucket nearest to target); earliest on ties, `most` at most.

    series has one row a bucket, so that it is a chart's worth of rows.
    """
    change = F.col(value) - F.lag(value).over(Window.orderBy(date))
    own = series.select(
        F.col(date).alias("date"), F.col(value).cast("double").alias("value"), change.cast("double").alias("change"),
    ).filter(F.col("value").isNotNull())
    late = -F.unix_date(F.col("date").cast("date"))
    row = F.struct("date", "value")
    pick = lambda test, by: F.max_by(row, F.when(test, F.struct(by, late)))
    parts = {
        "highest": pick(F.lit(True), F.col("value")), "lowest": pick(F.lit(True), -F.col("value")),
        "largest rise": pick(F.col("change") > 0, F.col("change")), "largest drop": pick(F.col("change") < 0, -F.col("change")),
    }
    if target is not None:
        parts["selected"] = pick(F.lit(True), -F.abs(F.datediff(F.col("date").cast("date"), F.lit(target).cast("date"))))
    got = own.agg(*[c.alias(n) for n, c in parts.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("finding"), F.col(f"`{n}`.date").alias("date"), F.col(f"`{n}`.value").alias("value")) for n in parts])
    kept = F.filter(rows, lambda x: x["value"].isNotNull() & ~((x["finding"] == "lowest") & (x["date"] == F.col("highest.date"))))
    return got.select(F.inline(F.slice(kept, 1, most)))


def uncertainty_summary(table: DataFrame) -> DataFrame:
    """(metric, point, lower, upper) summed over a table with bounds."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = table.agg(*[total(f"{m}{s}").alias(f"{m}{s}") for m in POLLUTANTS for s in ("", "_lower", "_upper")])
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).alias("point"), F.col(f"{m}_lower").alias("lower"),
                F.col(f"{m}_upper").alias("upper"),
            ) for m in POLLUTANTS
        ]
    )
    return sums.select(F.inline(rows))


def call_trace(segments: DataFrame) -> DataFrame:
    """One row a call and vessel: span, hours, segments and sums; counted_once: no segment of it is there twice."""
    extra = [F.min("vessel_class").alias("vessel_class")] if "vessel_class" in segments.columns else []
    once = F.count_distinct("segment_id")
    return segments.filter(F.coalesce(F.col("call_id").cast("string"), F.lit("")) != "").groupBy("call_id", "mmsi").agg(
        F.min("timestamp_start").alias("start"), F.max("timestamp_end").alias("end"), F.sum("duration_h").alias("duration_h"), once.alias("segments"),
        (F.count("*") == once).alias("counted_once"), F.sum("fuel_t").alias("fuel_t"), *extra, *[F.sum(m).alias(m) for m in POLLUTANTS],
    )


def filtered_count(rows: DataFrame, condition: F.Column, id_col: str, most: int = 50) -> DataFrame:
    """One row: how many match, and the smallest ids of them."""
    own = rows.filter(condition)
    few = own.select(id_col).orderBy(id_col).limit(most).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    return own.agg(F.count("*").alias("n")).crossJoin(F.broadcast(few))  # one row by one row


def comparison_bars(current: float, cuts: tuple[float, float, float], spark) -> DataFrame:
    """Four labelled values for a chart."""
    return spark.createDataFrame([("current", current), ("p25", cuts[0]), ("p50", cuts[1]), ("p75", cuts[2])], "label string, value double")
