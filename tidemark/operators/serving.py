"""Serving of learned models on vessels' last points, rule flags, and measures of models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .learning import top_classes

# Points that are looked at and that are needed; limits where training gave none; minutes below which an ETA's error counts as a share of an hour.
LAST, LEAST = 10, 5
SPIKE_KN_H, JITTER_DEG, JUMP_KM, JUMP_MINUTES = 25.0, 35.0, 80.0, 30.0
ETA_FLOOR = 60.0
# End of the fixed values.


def last_points(rows: DataFrame, n: int = LAST, tie: str = "event_id", start: str | None = None, end: str | None = None) -> DataFrame:
    """The latest n rows of each vessel, with _age from 1 (the latest) and _points, how many there are; dates are inclusive."""
    day = F.date_format("ts", "yyyy-MM-dd")
    own = rows if start is None else rows.filter(day >= F.lit(start))
    own = own if end is None else own.filter(day <= F.lit(end))
    age = F.row_number().over(Window.partitionBy("mmsi").orderBy(F.desc("ts"), F.desc(tie)))
    return own.withColumn("_age", age).filter(F.col("_age") <= n).withColumn("_points", F.count("*").over(Window.partitionBy("mmsi")))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row: the limits that training gives the rules, from all rows of lagged() with a course."""
    return rows.agg(
        F.percentile(F.abs("acceleration"), 0.99).alias("spike_kn_h"), F.percentile("course_change", 0.95).alias("jitter_deg"),
        F.lit(JUMP_KM).alias("jump_km"), F.lit(JUMP_MINUTES).alias("jump_minutes"),
    )


def rule_flags(
    points: DataFrame, spike: float | Column = SPIKE_KN_H, jitter: float | Column = JITTER_DEG, jump_km: float = JUMP_KM,
    minutes: float = JUMP_MINUTES,
) -> DataFrame:
    """(mmsi, points, status, flags) of vessels from last_points() of lagged() rows with a course: speed_spike for an
    acceleration beyond the limit, course_jitter for a deviation of course changes, position_jump for a far step."""
    far = (F.col("step_km") > jump_km) & (F.col("delta_h") * 60 <= minutes)
    own = points.groupBy("mmsi").agg(
        F.max("_points").alias("points"), F.max(F.abs("acceleration")).alias("a"), F.stddev_samp("course_change").alias("c"),
        F.bool_or(F.coalesce(far, F.lit(False))).alias("j"),
    )
    limit = lambda x: F.lit(x) if isinstance(x, float) else x
    tests = ((F.col("a") > limit(spike), "speed_spike"), (F.col("c") > limit(jitter), "course_jitter"), (F.col("j"), "position_jump"))
    enough = F.col("points") >= LEAST
    flags = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    return own.select(
        "mmsi", "points", F.when(enough, "ok").otherwise("not_enough_data").alias("status"),
        F.when(enough, flags).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def rescaled(raw: Column, q01: Column, q50: Column) -> Column:
    """1 at or below the 1 % quantile of scores, 0 at or above the median, in between a line."""
    return F.when(raw <= q01, 1.0).when(raw >= q50, 0.0).otherwise((q50 - raw) / F.greatest(q50 - q01, F.lit(1e-6)))


def with_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with those features that they lack as null numbers."""
    return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in names if c not in rows.columns])


def available(rows: DataFrame, names: list[str]) -> list[str]:
    """Those features that rows have, in order."""
    return [c for c in names if c in rows.columns]


@dataclass
class Models:
    """Models by name under one folder, each read when it is first asked for; None where it isn't there."""

    spark: SparkSession
    folder: str
    _read: dict[str, PipelineModel | None] = field(default_factory=dict)

    def get(self, name: str) -> PipelineModel | None:
        if name not in self._read:
            path = f"{self.folder}/{name}"
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
            there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
            self._read[name] = PipelineModel.load(path) if there else None
        return self._read[name]


def serve_destination(model: PipelineModel | None, points: DataFrame, names: list[str], label: str, k: int = 5) -> DataFrame:
    """(mmsi, status, rank, label, probability): the k likeliest classes of each vessel's latest point; vessels of too few
    points, or without a model, have one row with the status alone."""
    latest = with_features(points.filter("_age = 1"), names)
    short = F.lit(True) if model is None else F.col("_points") < LEAST
    why = F.when(F.col("_points") < LEAST, "not_enough_data").otherwise("skipped")
    rest = latest.filter(short).select("mmsi", why.alias("status"))
    if model is None:
        return rest.select(
            "*", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias(label),
            F.lit(None).cast("double").alias("probability"),
        )
    named = latest.filter(~short).drop(label).withColumn(label, F.lit("?"))
    found = top_classes(model, named, "mmsi", label, k).select(
        "mmsi", F.lit("ok").alias("status"), F.col("rank").cast("int").alias("rank"), label, "probability",
    )
    return found.unionByName(rest, allowMissingColumns=True)


def serve_eta(model: PipelineModel | None, points: DataFrame, names: list[str], mae: float) -> DataFrame:
    """(mmsi, status, eta_minutes, eta, confidence) of each vessel's latest point; confidence: 1 - mae / max(minutes, 60),
    from 0 to 1."""
    latest = with_features(points.filter("_age = 1"), names)
    enough = F.col("_points") >= LEAST
    if model is None:
        return latest.select(
            "mmsi", F.when(enough, "skipped").otherwise("not_enough_data").alias("status"),
            F.lit(None).cast("double").alias("eta_minutes"), F.lit(None).cast("timestamp_ntz").alias("eta"),
            F.lit(None).cast("double").alias("confidence"),
        )
    return confident(model.transform(latest).withColumn("minutes", F.when(enough, F.greatest(F.lit(0.0), F.col("prediction")))), mae)


def confident(rows: DataFrame, mae: float) -> DataFrame:
    """(mmsi, status, eta_minutes, eta, confidence) from rows with mmsi, ts and predicted minutes (null: not enough data)."""
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(float(mae)) / F.greatest("minutes", F.lit(ETA_FLOOR))))
    eta = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("minutes") * 60e6).cast("long")).cast("timestamp_ntz")
    return rows.select(
        "mmsi", F.when(F.col("minutes").isNull(), "not_enough_data").otherwise("ok").alias("status"),
        F.col("minutes").alias("eta_minutes"), eta.alias("eta"), F.when(F.col("minutes").isNotNull(), trust).alias("confidence"),
    )


def top_k_accuracy(predictions: DataFrame, truth: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """One row: the share of truth's rows (key, label) whose label is among their first k predictions (key, rank, label)."""
    own = predictions.filter(F.col("rank") <= k).groupBy(key).agg(F.collect_set(label).alias("_found"))
    hit = F.coalesce(F.array_contains("_found", F.col(label)), F.lit(False))
    return truth.select(key, label).join(own, key, "left").agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("rows"))
