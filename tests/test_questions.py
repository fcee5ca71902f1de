"""Reading of questions, ports against a catalog, states of answers, evidence, units, serving."""

from __future__ import annotations

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import units
from tidemark.operators import emissions, evidence, forecast, marts, serving, trajectory
from tidemark.plans import ports, router
from tidemark.plans.engine import Engine


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("arrivals at hamburg", ["hamburg"]), ("at lv rix", ["LVRIX"]), ("Port of Riga arrivals", ["Riga"]), ("Compare Riga and Gdansk", ["Riga", "Gdansk"]),
        ("congestion between Tallinn and Helsinki in March 2024", ["Tallinn", "Helsinki"]), ("arrivals in the port of Klaipeda last 3 weeks", ["Klaipeda"]),
        ("Arrivals in SE GOT and LVVNT", ["SEGOT", "LVVNT"]), ("in general, for a tanker at berth for 5 hours", []), ("Compare Monday and Friday arrivals", []), ("to", []), ("", []),
    ],
)
def test_ports_of(text, want):
    assert router.ports_of(text) == want


def test_dates_and_numbers():
    today = dt.date(2024, 5, 1)
    read = lambda t: router.parse(t, today)
    assert (read("on March 5, 2024").target_date, read("in 2023-11").date_to, read("from 2024-02-01 to 2024-01-01").date_from) == ("2024-03-05", "2023-11-30", "2024-01-01")
    assert read("on March 45, 2024").target_date is None and read("on 2024-13-45").date_from is None
    assert (read("mmsi:219000123").mmsi, read("MMSI 12").mmsi, read("IMO #1234567").imo) == ("219000123", None, "1234567")
    assert [read(t).call_id for t in ("call id 12-3", "call_id=12-3", "callid: a_b", "Call-ID x9?", "a call")] == ["12-3", "12-3", "a_b", "x9", None]


def test_scenarios():
    assert router.assumptions("Estimate emissions for a cargo at berth for 5 hours") == {"vessel_type": "cargo ship", "mode": "berth", "hours": 5.0, "speed_kn": 10.0}
    full = router.assumptions("Scenario: ferry maneuvering 2.5h at 6 knots, 9000 kW, reference speed 14 kn, LNG")
    assert full == {"vessel_type": "ferry", "mode": "manoeuvring", "hours": 2.5, "speed_kn": 6.0, "fuel": "LNG", "mcr_kw": 9000.0, "ref_speed_kn": 14.0}
    assert router.assumptions("Estimate emissions") is None and router.assumptions("at berth for 5 hours") is None


def test_estimates_take_overrides(spark):
    base = emissions.estimate(spark, "tanker", "transit", 1, 13).first()
    stated = emissions.estimate(spark, "tanker", "transit", 1, 13, fuel="lng", mcr_kw=6000, ref_speed_kn=26).first()
    assert base["load_factor"] == 1 and base["fuel_t"] == pytest.approx((12000 * 185 + 900 * 210) / 1e6)
    assert stated["load_factor"] == 0.2 and stated["fuel_t"] == pytest.approx((6000 * 0.2 * 185 + 900 * 210) / 1e6)
    assert stated["co2_t"] == pytest.approx(stated["fuel_t"] * 2.75)
    assert emissions.estimate(spark, hours=-3, speed_kn=-1).first()["fuel_t"] == 0
    odd = emissions.estimate(spark, "cargo", "adrift", 1, 5, fuel="water").first()
    assert odd["fuel_t"] == pytest.approx(600 * 220 / 1e6) and odd["nox_kg"] == pytest.approx(odd["fuel_t"] * 45) and odd["co2_t"] == pytest.approx(odd["fuel_t"] * 3.206)


CATALOG = [ports.Port("SEGOT", "SEGOT", "Gothenburg (SEGOT)", "gothenburg", 50, True), ports.Port("GOTEBORG_ROADS", "", "Goteborg Roads", "goteborg roads", 90), ports.Port("LVRIX", "LVRIX", "Riga (LVRIX)", "riga", 10, True), ports.Port("HAMBURG", "", "Hamburg", "hamburg", 5), ports.Port("HAMBURG_WEST", "", "Hamburg West", "hamburg west", 7)]


@pytest.mark.parametrize(
    ("token", "want"),
    [("Göteborg", "SEGOT"), ("port of  Riga", "LVRIX"), ("hamburg", "HAMBURG"), ("burg", "SEGOT"), ("hambrug", "HAMBURG"), ("Kotka", "KOTKA"), ("lv rix", "LVRIX"), ("Gothenbourg", "SEGOT"), ("Atlantis", "Atlantis"), ("", None), (None, None)],
)
def test_resolution(token, want):
    assert ports.Catalog(CATALOG).resolve(token) == want


def test_resolution_by_likeness_is_brute_force():
    own = ports.Catalog(CATALOG)
    for token in ("hamburgg", "rigaa roads", "gothenbrg", "gotebrg roads", "xxxx", "ham west"):
        best = max((max(SequenceMatcher(None, token, x).ratio() for x in (ports.plain(p.label), ports.plain(p.name))), p.structured, p.arrivals, p.key) for p in CATALOG)
        inside = [p for p in CATALOG if token in p.name or token in p.label.lower()]
        if not inside and best[0] >= ports.LEAST_RATIO:
            alike = [p for p in CATALOG if max(SequenceMatcher(None, token, x).ratio() for x in (ports.plain(p.label), ports.plain(p.name))) >= ports.LEAST_RATIO]
            assert own.resolve(token) in {p.key for p in alike if p.structured or not any(q.structured for q in alike)}
        elif not inside:
            assert own.resolve(token) == token


def test_scope():
    own = ports.Catalog(CATALOG)
    read = lambda text, override=None: own.scope(router.parse(text), override)
    assert (read("arrivals at Riga").port, read("arrivals at atlantis").port, read("how is gothenburg doing").port) == ("LVRIX", None, "SEGOT")
    assert "left out" in read("arrivals at atlantis").note and "read as LVRIX" in read("arrivals at Riga").note
    assert read("arrivals at Riga", "hamburg").port == "HAMBURG" and read("arrivals", "Atlantis").port == "Atlantis"
    assert own.known("se got") and not own.known("nowhere") and ports.Catalog([]).known("ABCDE")


def segments(spark, rows):
    own = spark.createDataFrame(rows, "segment_id string, mmsi long, call_id string, port_key string, mode string, timestamp_start timestamp_ntz, t double")
    for c in emissions.POLLUTANTS:
        own = own.withColumn(c, F.col("t"))
    return emissions.with_evidence(own.withColumns({"duration_h": F.col("t") * 2, "row_count": F.lit(1), "fallback_usage_ratio": F.lit(0.0), "rel_sigma": F.lit(0.05), "fuel_t": F.col("t"), "timestamp_end": F.col("timestamp_start")}), "p")


def at(text):
    return dt.datetime.fromisoformat(text)


def test_inventory_counts_calls_or_falls_back(spark):
    seg = segments(spark, [("s1", 1, "c1", "SEGOT", "berth", at("2024-01-02 01:00"), 1.0), ("s1", 1, "c1", "SEGOT", "berth", at("2024-01-02 01:00"), 1.0), ("s2", 1, "", "SEGOT", "transit", at("2024-01-02 05:00"), 8.0), ("s3", 2, None, "LVRIX", "transit", at("2024-01-03 05:00"), 4.0)])
    daily = emissions.roll_up(seg.withColumn("date", F.to_date("timestamp_start")), ["date", "port_key"])
    got = {r["port_key"]: r for r in emissions.port_emissions(seg, daily, "month").collect()}
    assert (got["SEGOT"]["co2_t"], got["SEGOT"]["basis"]) == (1.0, "call_linked")  # once, and without the transit
    assert (got["LVRIX"]["co2_t"], got["LVRIX"]["basis"], got["LVRIX"]["confidence_label"]) == (4.0, "daily_proxy", "medium")
    whole = emissions.port_emissions(seg, daily, "day", []).collect()
    assert [(r["bucket"], r["co2_t"], r["basis"]) for r in whole] == [("2024-01-02", 1.0, "call_linked")]
    checks = emissions.scope_diagnostics(seg, "co2_t", baseline=daily).first()
    assert (checks["raw_rows"], checks["rows"], checks["repeated"], checks["calls"], checks["sanity_status"]) == (4, 3, 1, 1, "checked")
    big = segments(spark, [("s1", 1, "c1", "SEGOT", "berth", at("2024-01-02 01:00"), 600.0)])
    assert emissions.scope_diagnostics(big, "co2_t").first()["warnings"] == ["implausible call duration", "implausible call emissions"]
    small = segments(spark, [("s1", 1, "c1", "SEGOT", "berth", at("2024-01-02 01:00"), 0.1)])
    weak = emissions.scope_diagnostics(small, "co2_t", baseline=emissions.roll_up(small.withColumn("date", F.to_date("timestamp_start")), ["date", "port_key"])).first()
    assert weak["sanity_status"] == "unstable baseline"
    none = emissions.scope_diagnostics(small.limit(0), "co2_t").first()
    assert (none["calls"], none["sanity_status"], none["warnings"]) == (0, "unstable baseline", ["no segments"])


def test_answers_have_states(spark):
    seg = segments(spark, [("s1", 1, "c-1", "SEGOT", "berth", at("2024-01-02 01:00"), 1.0), ("s2", 1, "c1", "SEGOT", "berth", at("2024-01-04 01:00"), 2.0), ("s3", 2, None, "LVRIX", "transit", at("2024-01-03 05:00"), 4.0)])
    catalog = spark.createDataFrame([("SEGOT", "SEGOT", "Gothenburg", 3), ("LVRIX", "LVRIX", "Riga", 2)], "port_key string, locode_norm string, port_label string, arrivals_total long")
    engine = Engine(spark, {"segments": seg, "port_catalog": catalog})
    got = engine.ask("Emissions at gothenburg in January 2024")
    assert (got.state, got.port, got.diagnostics["mode"], got.diagnostics["total"]) == ("COMPUTED", "SEGOT", "call_linked", 3.0)
    assert engine.ask("Emissions at Riga").diagnostics["mode"] == "daily_proxy"
    assert engine.ask("Emissions at Riga in March 2020").state == "NOT_COMPUTABLE"
    assert engine.ask("Emissions of call id c1").state == "COMPUTED"  # equal before alike
    twice = engine.ask("Emissions of call id C_1")
    assert twice.state == "NOT_COMPUTABLE" and sorted(twice.diagnostics["candidates"]) == ["c-1", "c1"]
    assert engine.ask("Estimate emissions at berth").state == "COMPUTED"
    assert engine.ask("Emissions at atlantis").notes[-1].startswith("port atlantis left out")


def test_filters():
    f = evidence.Filters(mmsi=" 12.0", locode="se got", port_name=" Riga ", flag="se", destination="Port/of riga", lat_min="54.5", lat_max="x", nav_status="")
    assert f.active() == {"mmsi": "12", "locode": "SEGOT", "port_name": "riga", "flag": "SE", "destination": "PORT OF RIGA", "lat_min": 54.5}
    of = evidence.Filters.of({"port": "Riga", "mmsi": "1", "date_from": "2024-01-01"}, {"port": " "})
    assert (of.locode, of.port_name, of.destination, of.date_from) == (None, "Riga", "Riga", "2024-01-01")
    assert evidence.Filters.of({"port": "Riga"}, {"port": "lv rix"}, dates=False).locode == "lv rix"
    assert evidence.pick("", " x ") == "x" and evidence.pick(None, None) is None


def test_routes_and_answers():
    assert [evidence.route(q) for q in ("what does the directive say", "vessel speed", "hello", "policy for port calls")] == ["docs", "traffic", "both", "both"]
    some = [evidence.Evidence("a", "text a", distance=0.3, metadata={"port": "RIGA", "anomaly": True}), evidence.Evidence("b", "text b", "docs", 0.5, {"source_file": "x.txt"})]
    assert evidence.answer("q", some)["lines"] == ["[traffic] a | port RIGA | text a", '[docs] b | x.txt p.? | "text b"']
    assert evidence.answer("q", some, limit=0.2)["refused"] and evidence.answer("q", [])["refused"] and not evidence.answer("q", some, strict=False, limit=0.1)["refused"]
    assert evidence.answer("q", [], {"count": 3, "ids": [1, 2]})["lines"] == ["[count] 1", "[count] 2"]
    assert evidence.answer("q", some, write=lambda q, e: f"{q}{len(e)}")["answer"] == "q2"


def test_traces():
    f = evidence.Filters(locode="segot")

    def fail(filters):
        raise OSError("the store is away")

    got = [evidence.trace(find, f, computed)[1]["status"] for find, computed in ((None, False), (fail, False), (lambda x: [], False), (lambda x: [evidence.Evidence("a", "t")], False), (fail, True))]
    assert got == ["disabled", "error", "no_hits", "ok", "computed_only"]
    assert evidence.trace(None, f)[1]["filters"] == {"locode": "SEGOT"}
    with pytest.raises(ZeroDivisionError):  # an error in code is no empty answer
        evidence.trace(lambda x: 1 / 0, f)


def test_evidence_summary(spark):
    rows = [(1, "RIGA", "2024-01-02", True, 0.3), (1, "RIGA", "2024-01-05", None, 0.2), (1, "KOTKA", "2024-01-01", False, 0.9), (2, None, None, None, None), (3, "B", "2024-01-01", True, 0.1), (3, "A", "2024-01-01", True, 0.1)]
    got = evidence.evidence_summary(spark.createDataFrame(rows, "query_id long, port string, date string, anomaly boolean, distance double"), ["query_id"])
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1, "RIGA", "2024-01-01", "2024-01-05", 0.2), (2, 1, 0, None, None, None, None), (3, 2, 2, "A", "2024-01-01", "2024-01-01", 0.1)]


def test_index_is_used_again(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "big ship in port", "RIGA"), ("b", "small boat", "KOTKA"), ("c", "", "RIGA")], "item_id string, text string, port string").withColumn("item_id", F.ascii("item_id").cast("long"))
    assert evidence.build_index(spark, chunks, str(tmp_path)) == 3
    assert evidence.build_index(spark, chunks.limit(1), str(tmp_path)) == 3  # there are rows
    assert evidence.metadata(spark, str(tmp_path), F.col("port") == "RIGA").count() == 2
    index = spark.read.parquet(f"{tmp_path}/vectors")
    question = spark.createDataFrame([(1, "ship in port")], "query_id long, text string").select("query_id", evidence.embedding(F.col("text")).alias("embedding"))
    found = evidence.retrieve(question, index, 2, F.col("port") == "RIGA").orderBy("rank").collect()
    assert [(r["item_id"], r["port"]) for r in found] == [(97, "RIGA"), (99, "RIGA")]
    assert evidence.build_index(spark, chunks.limit(1), str(tmp_path), rebuild=True) == 1


def test_units(spark):
    assert (units.tonnes(999), units.tonnes(1500), units.tonnes(-2.5e6)) == ("999.00 tCO2e", "1.50 ktCO2e", "-2.50 MtCO2e")
    assert units.percentiles([0.1, 0.2, 0.9]) == (0.1, 0.2, 0.9)
    assert {units.percentiles(x) for x in (None, [1, 2, 3], "abc", [0.5, 0.4, 0.9], [0.1, 0.2])} == {units.PERCENTILES}
    assert (units.with_unit(1234.5, "kn"), units.with_unit(5, "%"), units.utc(None), units.utc(at("2024-01-02 03:04:05"))) == ("1,234.5 kn", "5.0%", "n/a", "2024-01-02 03:04 UTC")
    assert units.percent_change(3, 2) == 50 and units.percent_change(3, 0.5) is None and units.percent_change(None, 2) is None
    shown = units.display(spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, "x")], "date date, co2_t double, port string"))
    assert shown.columns == ["Date (UTC)", "CO2 (tCO2e)", "port"] and shown.first()[0] == "2024-01-02"


def test_occupancy_is_every_hour(spark):
    """Changes at the ends of stays against every hour of every stay; overlapping stays of one vessel, ends in one hour."""
    import random

    rng, rows = random.Random(5), []
    for _ in range(120):
        begin = at("2024-01-01 00:00") + dt.timedelta(minutes=rng.randint(0, 6000))
        rows.append((rng.choice([1, 2, 3, None]), rng.choice("ab"), begin, begin + dt.timedelta(minutes=rng.randint(0, 900))))
    visits = spark.createDataFrame(rows, "mmsi long, port_key string, arrival_time timestamp_ntz, departure_time timestamp_ntz")
    for unit, step in (("hour", dt.timedelta(hours=1)), ("day", dt.timedelta(days=1))):
        want: dict = {}
        for mmsi, port, begin, end in rows:
            t = begin.replace(minute=0) if unit == "hour" else begin.replace(hour=0, minute=0)
            while t <= end:
                own = want.setdefault((port, t), (set(), []))
                own[0].update({mmsi} - {None})
                own[1].append(1)
                t += step
        got = {(r["port_key"], r["bucket"]): (r["occupancy_vessels"], r["occupancy_events"]) for r in marts.occupancy(visits, ["port_key"], unit).collect()}
        assert got == {k: (len(v), len(n)) for k, (v, n) in want.items()}


def test_as_of_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, 5, "a"), (None, 5, "b"), (1, None, "c"), (2, 5, "d")], "k long, t long, x string")
    right = spark.createDataFrame([(1, 3, "old"), (1, 4, "new"), (None, 1, "none")], "k long, s long, v string")
    got = trajectory.as_of(left, right, "k", "t", "s", ["v"], ["v"])
    assert sorted(((r["x"], r["v"]) for r in got.collect())) == [("a", "new"), ("b", None), ("c", None), ("d", None)] and got.columns == ["k", "t", "x", "v"]
    assert {r["x"] for r in trajectory.as_of(left, right, "k", "t", "s", ["v"], ["v"], keep_null=False).collect()} == {"a", "d"}


def test_serving(spark, tmp_path):
    points = spark.createDataFrame([(m, k, at("2024-01-01 00:00") + dt.timedelta(minutes=k), float(k)) for m, n in ((1, 12), (2, 3)) for k in range(n)], "mmsi long, event_id long, ts timestamp_ntz, speed double")
    last = serving.last_points(points)
    assert {r["mmsi"]: r["n"] for r in last.groupBy("mmsi").agg(F.count("*").alias("n")).collect()} == {1: 10, 2: 3}
    models = serving.Models(spark, str(tmp_path))
    assert models.get("destination") is None
    got = {r["mmsi"]: r["status"] for r in serving.serve_destination(None, last, ["speed", "draught"], "mode").collect()}
    assert got == {1: "skipped", 2: "not_enough_data"}
    from tidemark.operators import learning

    rows = points.filter("mmsi = 1").withColumns({"mode": F.when(F.col("speed") > 5, "fast").otherwise("slow"), "eta": F.col("speed") * 10 + 30})
    learning.fit_destination(rows, "mode", ["speed"], [], trees=3).write().save(str(tmp_path / "destination"))
    models = serving.Models(spark, str(tmp_path))
    served = serving.serve_destination(models.get("destination"), last, ["speed"], "mode").collect()
    assert {(r["mmsi"], r["status"]) for r in served} == {(1, "ok"), (2, "not_enough_data")} and next(r["mode"] for r in served if r["rank"] == 1) == "fast"
    eta = {r["mmsi"]: r for r in serving.serve_eta(learning.fit_eta(rows, "eta", ["speed"], iterations=3), last, ["speed"], 30.0).collect()}
    assert eta[2]["status"] == "not_enough_data" and eta[1]["confidence"] == pytest.approx(1 - 30 / max(eta[1]["eta_minutes"], 60))
    assert serving.available(points, ["speed", "draught"]) == ["speed"]
    scale = spark.createDataFrame([(-0.7,), (-0.6,), (-0.5,), (-0.4,)], "s double").select(serving.rescaled(F.col("s"), F.lit(-0.6), F.lit(-0.4)).alias("x"))
    assert [round(r["x"], 6) for r in scale.collect()] == [1.0, 1.0, 0.5, 0.0]


def test_forecast_for_a_date(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), "a", float(k % 7)) for k in range(30)] + [(dt.date(2024, 1, 1) + dt.timedelta(days=k), "b", 2.0) for k in range(5)]
    rows = spark.createDataFrame(days, "date date, port_key string, value double")
    basis = lambda day: {r["port_key"]: r["basis"] for r in forecast.for_date(rows, ["port_key"], day, 28).collect()}
    assert (basis("2024-01-03"), basis("2024-02-10"), basis("2024-06-01")) == ({"a": "observed", "b": "observed"}, {"a": "model", "b": "analog"}, {"a": "analog", "b": "analog"})
