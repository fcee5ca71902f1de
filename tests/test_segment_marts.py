"""Factors by one look-up against factors one by one, and what the inventory's queries write on their way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.oracle import DATA
from tidemark import catalog
from tidemark.operators import emissions, trajectory
from tidemark.plans import track_queries

STATED = {"mcr_kw": "double", "ref_speed_kn": "double", "fuel_type": "string", "engine_family": "string", "aux_power_kw": "double"}


def test_factors_by_one_look_up(spark):
    """Rows that state nothing, against the path for rows that state some, with only nulls in those columns."""
    own = emissions.registry()
    odd = {
        **own, "vessels": {**own["vessels"], "ferry": (900, 20, "no fuel", "no engine")}, "modes": {"transit": own["modes"]["transit"]},
        "aux_kw": {**own["aux_kw"], "drifting": {"tug": 7, "unknown": 8}}, "nox": {**own["nox"], emissions.DEFAULT_ENGINE: {"drifting": 3}},
    }
    classes, modes = [*own["vessels"], "ferry", "tug", "submarine", "", None], [*own["modes"], "drifting", "other", "", None]
    rows = spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate((c, m) for c in classes for m in modes)], "i int, vessel_class string, mode string")
    for factors in (None, odd):
        got = emissions.add_factors(rows, factors)
        want = emissions.add_factors(rows.withColumns({c: F.lit(None).cast(t) for c, t in STATED.items()}), factors)
        assert sorted(got.columns) == sorted(want.columns)
        table = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=lambda r: r[sorted(want.columns).index("i")])
        assert table(got) == table(want)


def test_scope_diagnostics_write_what_they_read(spark, monkeypatch):
    """Segments are cut on what their totals follow from, and the mart has what is read of it: no factors, places or bounds."""
    seen = {}
    for module in (trajectory, track_queries):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: seen.setdefault(name, f(df, name)))
    assert catalog.queries()["ag25_scope_diagnostics"](spark, DATA).count() > 0
    assert not {"fuel_t", "mcr_kw", "wtw_co2e_t", "step_km", "departure_time"} & set(seen["track"].columns)
    assert not {"lat_start", "evidence_id", "wtw_co2e_t_lower"} & set(seen["segments"].columns)
