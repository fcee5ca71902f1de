"""Mergeable sketches of visits: quantiles of dwell (KLL) and distinct vessels (HLL) as columns of a mart.

A sketch is made once for each port and month, and sketches are merged to ports, months and all by aggregates that Spark combines
before the shuffle, so a quantile of any roll-up is one pass over the mart rather than a sort of its visits.

Errors: a quantile's rank is off by at most RANK_ERROR, and a distinct count by COUNT_ERROR of itself, but for a chance of
about one in a hundred; counts and sums are exact. A group with at most K values has exact quantiles.

Defined results: null values and vessels are in no sketch; a group without values has null quantiles; a null key is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of quantile sketches, and the rank error that it gives; bits of distinct counts, and their relative error.
K, RANK_ERROR = 400, 0.02
BITS, COUNT_ERROR = 12, 0.05


def visit_sketches(stays: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and month: visits, minutes, and the sketches dwell and vessels. stays: marts.dwell()."""
    month = F.trunc("arrival_date", "month").alias("month")
    return stays.groupBy(*keys, month).agg(
        F.count("*").alias("visits"), F.sum("dwell_minutes").alias("minutes"),
        F.kll_sketch_agg_double(F.col("dwell_minutes").cast("double"), K).alias("dwell"),
        F.hll_sketch_agg(F.col("mmsi").cast("string"), BITS).alias("vessels"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same by fewer keys: what one pass over the visits would give, within the error."""
    return sketches.groupBy(*keys).agg(
        F.sum("visits").alias("visits"), F.sum("minutes").alias("minutes"), F.kll_merge_agg_double("dwell", K).alias("dwell"),
        F.hll_union_agg("vessels").alias("vessels"),
    )


def quantile(sketch: str, rank: float) -> Column:
    """The value of a rank; null where the sketch holds none."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))


def told(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """sketches with a column for each rank and vessels as a number, without the sketches."""
    own = sketches.select("*", *[quantile("dwell", r).alias(name) for name, r in ranks.items()], F.hll_sketch_estimate("vessels").alias("distinct_vessels"))
    return own.drop("dwell", "vessels")


def score_quantiles(scored: DataFrame, keys: list[str], column: str = "raw_score", ranks: tuple[float, ...] = (0.01, 0.05, 0.5)) -> DataFrame:
    """q01, q05, q50 of scores by keys, and over all where keys is empty, from one merge of sketches."""
    sketch = scored.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), K).alias("scores"), F.count(column).alias("rows"))
    return sketch.select(*keys, "rows", *[quantile("scores", r).alias(f"q{round(100 * r):02d}") for r in ranks])
