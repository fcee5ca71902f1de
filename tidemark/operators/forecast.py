"""Seasonal forecasts and their backtests. Series are rows in date order; gaps aren't filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(rows: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Sums by keys and date; missing values drop out."""
    return rows.filter(
        F.col(value).isNotNull() & F.col(date).isNotNull()
    ).groupBy(*keys, F.col(date).alias("date")).agg(F.sum(value).cast("double").alias("value"))


def one_step(rows: DataFrame, keys: list[str]) -> DataFrame:
    """prediction: 0.7 * the value seven rows back (else the last) + 0.3 * the mean of up to seven rows, not below 0; from the second row on."""
    w = Window.partitionBy(*keys).orderBy("date")
    own = rows.withColumns(
        {
            "_last": F.lag("value").over(w), "_week": F.lag("value", 7).over(w),
            "_mean": F.avg("value").over(w.rowsBetween(-7, -1)), "n_before": F.row_number().over(w) - 1,
        }
    )
    own = own.filter(F.col("_last").isNotNull())
    return own.withColumn(
        "prediction", F.greatest(F.lit(0.0), 0.7 * F.coalesce("_week", "_last") + 0.3 * F.col("_mean")),
    ).drop("_last", "_week", "_mean")


def residual_std(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviation of residuals from three on, else population deviation of the values, else 0.15 * max(value, 1)."""
    spread = one_step(rows, keys).groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_samp(F.col("value") - F.col("prediction")).alias("_s"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_k"), F.stddev_pop("value").alias("_p"), F.max("value").alias("_m"))
    std = F.when(F.col("_n") >= 3, F.col("_s")).when(F.col("_k") > 1, F.col("_p")).otherwise(0.15 * F.greatest("_m", F.lit(1.0)))
    return whole.join(spread, keys, "left").select(*keys, std.alias("residual_std"))


def forecast(rows: DataFrame, keys: list[str], days: int, least: int = 1) -> DataFrame:
    """(keys, step, date, prediction, lower, upper): steps feed back; bounds widen with the root of the step.

    All series at once: the last seven values of each (by date) are folded over the steps in one expression.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    last = rows.withColumn("_r", F.row_number().over(w)).filter("_r <= 7").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", "value"))).alias("_h"), F.max("date").alias("_to"),
    )
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    own = last.join(counts, keys).join(residual_std(rows, keys), keys)

    def step(h: Column, _: Column) -> Column:
        tail = F.slice(h, F.greatest(F.size(h) - 6, F.lit(1)), F.lit(7))
        mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)
        week = F.when(F.size(h) >= 7, F.element_at(h, F.size(h) - 6)).otherwise(F.element_at(h, -1))
        return F.concat(h, F.array(F.greatest(F.lit(0.0), 0.7 * week + 0.3 * mean)))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(days)), F.transform("_h", lambda x: x["value"]), step)
    out = own.select(*keys, "_to", "residual_std", F.posexplode(F.slice(grown, F.size("_h") + 1, days)).alias("_i", "prediction"))
    half = 1.96 * F.col("residual_std") * F.sqrt(F.col("_i") + 1)
    return out.select(
        *keys, (F.col("_i") + 1).alias("step"), F.date_add("_to", F.col("_i") + 1).alias("date"), "prediction",
        F.greatest(F.lit(0.0), F.col("prediction") - half).alias("lower"), (F.col("prediction") + half).alias("upper"),
    )


def congestion_on_weekday(rows: DataFrame, keys: list[str], weekday: int, weeks: int = 4) -> DataFrame:
    """Mean forecast over the coming days of one weekday (Monday 0)."""
    return forecast(rows, keys, 7 * weeks).filter(F.weekday("date") == weekday).groupBy(*keys).agg(
        F.avg("prediction").alias("prediction"), F.count("*").alias("days"),
    )


def backtest(rows: DataFrame, keys: list[str], test_days: int = 28, least_history: int = 60, top: int = 20) -> DataFrame:
    """MAE and MAPE (denominator at least 1) of one-step forecasts over each series' last rows; the largest series."""
    size = rows.groupBy(*keys).agg(
        F.count("*").alias("_k"), F.sum("value").alias("_total"),
    ).filter(F.col("_k") >= least_history + test_days).orderBy(F.desc("_total"), *keys).limit(top)
    newest = Window.partitionBy(*keys).orderBy(F.desc("date"))
    chosen = rows.join(F.broadcast(size.select(*keys)), keys, "left_semi")  # top rows at most
    tested = one_step(chosen, keys).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= test_days)
    err = F.abs(F.col("value") - F.col("prediction"))
    return tested.groupBy(*keys).agg(
        F.avg(err).alias("mae"), F.avg(err / F.greatest(F.abs("value"), F.lit(1.0)) * 100).alias("mape"),
        F.count("*").alias("days"),
    )


def mean_errors(tested: DataFrame) -> DataFrame:
    """One row: the means of backtest()'s errors over series."""
    return tested.agg(F.count("*").alias("series"), F.avg("mae").alias("mean_mae"), F.avg("mape").alias("mean_mape"))


def for_date(rows: DataFrame, keys: list[str], day: str, days: int, least: int = 14) -> DataFrame:
    """(keys, date, prediction, lower, upper, basis) of each series on one day: observed where the day is in the series (the
    bounds are its value), model where it is at most `days` ahead and the series has `least` rows, else analog."""
    t = F.lit(day).cast("date")
    bounds = lambda c: [F.col(c).alias(n) for n in ("prediction", "lower", "upper")]
    seen = rows.filter(F.col("date") == t).select(*keys, "date", *bounds("value"), F.lit("observed").alias("basis"))
    ahead = forecast(rows, keys, days, least=least).filter(F.col("date") == t).select(
        *keys, "date", "prediction", "lower", "upper", F.lit("model").alias("basis"),
    )
    found = seen.unionByName(ahead.join(seen.select(*keys), keys, "left_anti"))
    like = seasonal_analog(rows, keys, day).select(*keys, t.alias("date"), "prediction", "lower", "upper", F.lit("analog").alias("basis"))
    return found.unionByName(like.join(found.select(*keys), keys, "left_anti"))


#: Tiers of likeness to a date, and how many days each needs.
_TIERS = (1, 2, 3, 3, 5, 5, 1)


def seasonal_analog(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Mean and 10 % / 90 % quantiles over like days; the first tier with enough of them counts.

    Tiers: same month and day; same month and weekday within 3 days of the month; same month and weekday; same ISO week;
    same month; same weekday; any.
    """
    d, t = F.col("date"), F.lit(day).cast("date")
    month, dow = F.month(d) == F.month(t), F.weekday(d) == F.weekday(t)
    tests = (
        month & (F.day(d) == F.day(t)), month & dow & (F.abs(F.day(d) - F.day(t)) <= 3), month & dow,
        F.weekofyear(d) == F.weekofyear(t), month, dow, F.lit(True),
    )
    own = rows.filter(d < t).withColumn("_in", F.array(*tests))
    counts = own.groupBy(*keys).agg(*[F.count_if(F.col("_in")[k]).alias(f"_c{k}") for k in range(len(tests))])
    tier = F.coalesce(*[F.when(F.col(f"_c{k}") >= n, k) for k, n in enumerate(_TIERS)])
    used = own.join(counts.select(*keys, tier.alias("_tier")), keys).filter(F.get("_in", F.col("_tier")))
    out = used.groupBy(*keys, (F.col("_tier") + 1).alias("tier")).agg(
        F.avg("value").alias("prediction"), F.count("*").alias("samples"), F.percentile("value", 0.1).alias("_lo"),
        F.percentile("value", 0.9).alias("_hi"),
    )
    one = F.col("samples") == 1
    return out.select(
        *keys, "tier", "prediction", "samples", F.when(one, F.col("prediction") * 0.8).otherwise(F.col("_lo")).alias("lower"),
        F.when(one, F.col("prediction") * 1.2).otherwise(F.col("_hi")).alias("upper"),
    )


def compare(rows: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Mean forecast of each series over the horizon, largest first."""
    return forecast(rows, keys, days).groupBy(*keys).agg(
        F.avg("prediction").alias("mean_prediction"), F.max("prediction").alias("peak_prediction"),
    ).orderBy(F.desc("mean_prediction"), *keys)


def congestion_level(index: Column) -> Column:
    return F.when(index < 0.8, "low").when(index < 1.2, "normal").when(index < 1.6, "elevated").otherwise("high")
