"""Distances, angles and vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE = 6371.0088, 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    # least() skips nulls, so a missing place must stay missing by itself
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow((lat2 - lat1) * KM_PER_DEGREE, 2) + F.pow((lon2 - lon1) * KM_PER_DEGREE, 2))


def angle_between(a: Column, b: Column) -> Column:
    raw = F.abs(a - b)
    return F.when(raw.isNotNull(), F.least(raw, 360 - raw))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector has no length. Elements are taken as doubles."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(1 - F.try_divide(dot, norm(a) * norm(b)), F.lit(1.0))
