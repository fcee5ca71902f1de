"""Sketches that are merged against the rows themselves."""

from __future__ import annotations

import datetime as dt
import random

from tidemark.operators import sketches


def stays(n=20_000):
    rng = random.Random(2)
    out = [(rng.randrange(3000), rng.choice(["A", "A", "A", "B", None]), dt.date(2024, rng.randint(1, 12), 3), rng.lognormvariate(5, 1)) for _ in range(n)]
    return out + [(None, "C", dt.date(2024, 1, 1), None), (7, "D", dt.date(2024, 1, 1), 5.0)]


def test_merged_quantiles_and_counts(spark):
    rows = stays()
    months = sketches.visit_sketches(spark.createDataFrame(rows, "mmsi long, port_key string, arrival_date date, dwell_minutes double").repartition(6), ["port_key"])
    for keys in (["port_key"], ["month"], []):
        for r in sketches.told(sketches.merged(months, keys), {"low": 0.05, "mid": 0.5, "high": 0.95}).collect():
            own = [x for x in rows if all((x[1] if k == "port_key" else x[2].replace(day=1)) == r[k] for k in keys)]
            values, vessels = [x[3] for x in own if x[3] is not None], {x[0] for x in own if x[0] is not None}
            assert r["visits"] == len(own) and abs(r["distinct_vessels"] - len(vessels)) <= sketches.COUNT_ERROR * len(vessels) + 1
            if not values:
                assert r["low"] is None and r["high"] is None
                continue
            for name, rank in (("low", 0.05), ("mid", 0.5), ("high", 0.95)):
                below, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
                assert below / len(values) - sketches.RANK_ERROR <= rank <= upto / len(values) + sketches.RANK_ERROR


def test_score_quantiles(spark):
    rows = spark.createDataFrame([(i % 2, float(i)) for i in range(100)] + [(0, None)], "k int, raw_score double")
    got = {r["k"]: r for r in sketches.score_quantiles(rows, ["k"]).collect()}
    assert got[0]["rows"] == 50 and abs(got[0]["q50"] - 49) <= 2 and got[1]["q01"] == 1.0
    assert sketches.score_quantiles(rows, []).first()["rows"] == 100
    assert sketches.score_quantiles(rows.filter("raw_score is null"), []).first()["q05"] is None
