"""Traps of single operators on hand-made rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import clean, geo, text
from tidemark.operators import emissions, forecast, learning, marts, questions, retrieval, trajectory
from tidemark.plans import learning_queries, router
from tidemark.plans.engine import Engine, match_call
from tidemark.sources import files
from tidemark.streaming import arrivals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("raw, want", [("SE GOT", "SEGOT"), ("segot", "SEGOT"), ("Gdańsk / PL", "GDA SK PL"), ("", "UNKNOWN"), ("nan", "UNKNOWN"), (None, "UNKNOWN"), ("--", "UNKNOWN"), ("Riga", "LVRIX")])
def test_destination(spark, raw, want):
    assert one(spark, clean.destination(F.lit(raw).cast("string"), {"RIGA": "LVRIX"})) == want


@pytest.mark.parametrize("raw, want", [("12.0", "12"), (" 7 ", "7"), ("1.5", "1.5"), (None, None)])
def test_identifier(spark, raw, want):
    assert one(spark, clean.identifier(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("1,5", 1.5), ("x", None), ("inf", None), ("NaN", None), ("2", 2.0)])
def test_number(spark, raw, want):
    assert one(spark, clean.number_comma(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("cargo", "unknown"), ("ferry", "unknown"), ("Bulk Carrier", "cargo"), ("crude tanker", "tanker"), (None, "unknown")])
def test_vessel_class(spark, raw, want):
    assert one(spark, clean.vessel_class(F.lit(raw).cast("string"))) == want


def test_name_token(spark):
    assert one(spark, clean.name_token(F.lit("Port of  Göteborg"))) == "goteborg"


def test_distances(spark):
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195, abs=0.01)
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(10.0))) == 20
    assert one(spark, geo.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1


def test_html_and_chunks(spark):
    assert one(spark, text.html_text(F.lit("<header>a</header><p>x &lt; y</p><!-- z --><script>q()</script>"))) == "x < y"
    assert [r["chunk"] for r in one(spark, text.fixed_chunks(F.lit("abcdefg"), 4, 1))] == ["abcd", "defg", "g"]
    assert one(spark, text.fixed_chunks(F.lit(""), 4, 1)) == []


def test_as_of_is_no_interval_join(spark):
    visits = spark.createDataFrame([(1, "A", "P", ts("2024-01-01 00:00"), ts("2024-01-10 00:00")), (1, "B", "P", ts("2024-01-02 00:00"), ts("2024-01-03 00:00"))], "mmsi long, call_id string, port_key string, arrival_time timestamp_ntz, departure_time timestamp_ntz")
    rows = spark.createDataFrame([(1, 1, ts("2024-01-02 00:00")), (1, 2, ts("2024-01-05 00:00")), (1, 3, ts("2023-12-31 00:00")), (None, 4, ts("2024-01-02 00:00"))], "mmsi long, event_id long, ts timestamp_ntz")
    got = {r["event_id"]: (r["call_id"], r["inside_call"]) for r in trajectory.attach_visits(rows, visits).collect()}
    assert got == {1: ("B", True), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_modes(spark):
    base = ts("2024-01-01 00:00")
    rows = [(k, 1, base + dt.timedelta(hours=h), v, None, inside, base, base + dt.timedelta(hours=24)) for k, (h, v, inside) in enumerate([(0.5, 0.5, True), (5, 0.5, True), (5, 1.5, True), (5, 6.0, True), (23.5, 6.0, True), (5, 0.1, False), (5, None, True)])]
    own = spark.createDataFrame(rows, "event_id long, mmsi long, ts timestamp_ntz, speed double, speed_estimated_kn double, inside_call boolean, arrival_time timestamp_ntz, departure_time timestamp_ntz")
    got = [r["mode"] for r in emissions.assign_modes(own).orderBy("event_id").collect()]
    assert got == ["manoeuvring", "berth", "anchorage", "transit", "manoeuvring", "transit", "berth"]


def test_load_factor_has_a_floor(spark):
    assert emissions.estimate(spark, "cargo", "transit", 1, 0).first()["load_factor"] == 0.2
    assert emissions.estimate(spark, "cargo", "berth", 1, 0).first()["load_factor"] == 0.0


def test_confidence_and_states(spark):
    assert one(spark, emissions.confidence(F.lit(0.2), F.lit(0.05))) == "high"
    assert one(spark, emissions.confidence(F.lit(0.9), F.lit(0.2))) == "medium"
    assert one(spark, emissions.confidence(F.lit(0.9), F.lit(0.9))) == "low"
    assert emissions.result_state(1, 0.0) == "COMPUTED_ZERO"
    assert emissions.result_state(0, None, evidence=2) == "RETRIEVAL_ONLY"
    assert emissions.result_state(0, None) == "NOT_COMPUTABLE"


def test_intensity_by_distinct_calls(spark):
    rows = spark.createDataFrame([("A", 1.0, "d1", 1.0), ("A", 2.0, "d1", 1.0), ("B", 3.0, "d2", 2.0)], "call_id string, v double, date string, duration_h double")
    got = emissions.metrics(rows, "v").first()
    assert (got["total_t"], got["kg_per_call"]) == (6.0, 3000.0)


def test_occupancy_bound(spark):
    rows = spark.createDataFrame([(1, "P", ts("2024-01-01 00:30"), ts("2024-01-01 02:10"))], "mmsi long, port_key string, arrival_time timestamp_ntz, departure_time timestamp_ntz")
    assert marts.occupancy(rows, ["port_key"]).count() == 3
    assert marts.occupancy(rows, ["port_key"], max_rows=2).count() == 0


def test_full_outer_multiplies(spark):
    a = spark.createDataFrame([("P", 1, 10), ("P", 1, 11)], "k string, d int, n int")
    b = spark.createDataFrame([("P", 1, 1), ("P", 1, 2), ("Q", 1, 3)], "k string, d int, n int")
    assert sorted(r["n"] for r in marts.prefer_visits(a, b, ["k", "d"]).collect()) == [1, 1, 2, 2, 3]


def test_spikes_need_history(spark):
    rows = spark.createDataFrame([("P", dt.date(2024, 1, d), v) for d, v in ((1, 1), (2, 9), (3, 1), (4, 2), (5, 50))], "k string, date date, n int")
    assert [r["n"] for r in questions.spikes(rows, ["k"], "n").collect()] == [50]


def test_short_series(spark):
    rows = spark.createDataFrame([("P", dt.date(2024, 1, 1), 4.0)], "k string, date date, value double")
    got = forecast.forecast(rows, ["k"], 2).orderBy("step").collect()
    assert [r["prediction"] for r in got] == [pytest.approx(4.0)] * 2
    assert forecast.residual_std(rows, ["k"]).first()["residual_std"] == pytest.approx(0.6)


def test_even_sample_keeps_ends(spark):
    got = sorted(r["id"] for r in trajectory.even_sample(spark.range(1000), ["id"], 10).collect())
    assert len(got) == 10 and got[0] == 0 and got[-1] == 999


def test_top_k_and_ids(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.top_k(queries, corpus, 3).orderBy("rank").collect()] == [1, 3, 2]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    assert sorted(r["unique_id"] for r in retrieval.numbered_ids(rows, "k", ["n"]).collect()) == ["a", "a__dup1", "b"]


def test_router():
    today = dt.date(2024, 5, 1)  # a Wednesday
    assert router.parse("Show daily arrival counts at LVVNT between 2022-03-01 and 2022-03-31").ports == ["LVVNT"]
    assert router.parse("truck turn-time at the terminal").intent == "G"
    assert router.parse("berth-level queue length").intent == "G"
    assert router.parse("Forecast arrivals next Friday", today).target_date == "2024-05-03"
    assert router.parse("arrivals this Wednesday", today).target_date == "2024-05-01"
    assert router.parse("Compare Monday and Friday arrivals").weekdays == ["Monday", "Friday"]
    assert router.parse("emissions for call id: _111_2022-03-05T10-00-00_SEGOT").call_id == "111_2022-03-05T10-00-00_SEGOT"
    assert router.parse("arrivals in March 2022").date_to == "2022-03-31"
    assert router.parse("arrivals over the last 6 weeks").last_weeks == 6
    assert router.parse("predict for 40 weeks").horizon_weeks == 12


def test_engine_states(spark):
    seg = spark.createDataFrame([("s1", 111, "_111_2022-03-05T10-00-00_SEGOT", "SEGOT", "berth", ts("2022-03-05 10:00"))], "segment_id string, mmsi long, call_id string, port_key string, mode string, timestamp_start timestamp_ntz")
    for c in (*emissions.POLLUTANTS, "duration_h", "row_count", "fallback_usage_ratio", "rel_sigma"):
        seg = seg.withColumn(c, F.lit(0.0))
    engine = Engine(spark, {"segments": seg})
    assert engine.ask("Emissions of call id 111_2022-03-05T10-00-00_SEGOT").state == "COMPUTED_ZERO"
    assert engine.ask("Emissions of call id 999_2022-03-05T10-00-00_SEGOT").state == "NOT_COMPUTABLE"
    assert engine.ask("Predict carbon emissions at SEGOT next Friday").state == "FORECAST_ONLY"
    assert engine.ask("Estimate emissions: tanker manoeuvring 2 hours at 6 knots").state == "COMPUTED"
    assert engine.ask("How many arrivals?").status == "no_data"
    assert match_call(seg, "111-2022-03-05T10:00:00 SEGOT").count() == 1


def test_sources(spark, tmp_path):
    raw = tmp_path / "feed.csv"
    raw.write_text('"MMSI",TimePosition,Latitude,Longitude,Speed,Course,Heading,NavStatus\n12.0,2021-01-01T00:04:03.000Z,54.1,10.2,3,bad,1,x\n,2021-01-01T00:04:03.000Z,54.1,10.2,3,4,1,x\n13,2021-01-01T00:04:03.000Z,99,10.2,3,4,1,x\n')
    feeds = files.read_feeds(spark, [str(raw)])
    assert list(feeds) == ["positions"]
    got = files.positions_from_raw(feeds["positions"]).collect()
    assert [(r["mmsi"], r["course"], r["source_file"]) for r in got] == [("12", None, "feed.csv")]
    assert files.kind_of(["a"]) is None
    assert files.read_mart(spark, str(tmp_path / "none"), got and feeds["positions"].schema).count() == 0
    assert files.write_json_lines(spark.range(3), str(tmp_path / "j")) == 3
    assert files.read_json_lines(spark, str(tmp_path / "j")).count() == 3
    assert files.list_files(spark, str(tmp_path), "*.csv").count() == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, ts("2024-01-01 00:00"), 54.0, 10.0), (1, ts("2024-01-01 00:10"), 55.0, 10.0), (1, ts("2024-01-01 05:00"), 55.0, 10.0)], "mmsi long, ts timestamp, latitude double, longitude double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("jumps", arrivals.jumps(source), "append"), ("hourly", arrivals.hourly_arrivals(source, []), "append"), ("sessions", arrivals.sessions(source), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert spark.table(name).count() == {"jumps": 1, "hourly": 1, "sessions": 1}[name]  # the newest window is still open


def test_build_from_raw(spark, tmp_path):
    from tidemark.plans import build

    visits = tmp_path / "visits.csv"
    visits.write_text("portID,portName,portLocode,portArrival,portDeparture,vesselMMSI,vesselType\n1,Riga,LV RIX,2021-01-01T00:00:00.000Z,2021-01-02T00:00:00.000Z,7.0,Tanker\n1,Riga,LV RIX,2021-01-02T00:00:00.000Z,,8,\n")
    points = tmp_path / "points.csv"
    points.write_text("MMSI,TimePosition,Latitude,Longitude,Speed,Course,Destination,VesselType\n7,2021-01-01T01:00:00.000Z,57,24,0.1,1,LV RIX,Tanker\n7,2021-01-01T02:00:00.000Z,57,24,0.1,2,LV RIX,Tanker\n")
    built = build.build_marts(spark, [str(visits), str(points)], str(tmp_path / "marts"))
    assert built.capabilities["ports"] == 1 and built.capabilities["has_dwell"]
    index = spark.read.parquet(str(tmp_path / "marts/congestion_daily")).orderBy("date").collect()
    assert [(r["port_key"], r["arrivals_vessels"], r["congestion_index"]) for r in index] == [("LVRIX", 1, 2.0), ("LVRIX", 1, 1.0)]
    own = files.positions_from_raw(files.read_feeds(spark, [str(points)])["positions"]).withColumn("event_id", F.monotonically_increasing_id())
    assert len(build.build_inventory(own, files.visits_from_raw(files.read_feeds(spark, [str(visits)])["visits"]), str(tmp_path / "inventory"))) == 64
    calls = spark.read.parquet(str(tmp_path / "inventory/calls")).collect()
    assert [(c["call_id"], c["segments"]) for c in calls] == [("7_2021-01-01T00-00-00_LVRIX", 2)] and calls[0]["wtw_co2e_t"] > 0
    assert {p.name for p in (tmp_path / "marts").iterdir()} >= {"events", "training_rows"}
    assert not build.ensure_inventory(own, own.limit(0), str(tmp_path / "inventory"))  # all is there
    document = tmp_path / "factors.json"
    document.write_text(json.dumps({"version": "v9", "fuel_factors": {"HFO": {"co2_t_per_t_fuel": 10}}, "vessel_defaults": {"tanker": {"mcr_kw": 0, "fuel": "HFO"}}, "uncertainty_defaults": {"speed": 0.5}}))
    stays = files.visits_from_raw(files.read_feeds(spark, [str(visits)])["visits"])
    assert build.ensure_inventory(own, stays, str(tmp_path / "other"), str(document))
    about = json.loads(spark.read.text(str(tmp_path / "other/params_version")).first()[0])
    assert about["version"] == "v9" and len(about["document_sha256"]) == 64
    row = spark.read.parquet(str(tmp_path / "other/segments")).filter("call_id is not null").first()
    assert row["co2_t"] == pytest.approx(10 * row["fuel_t"]) and row["rel_sigma"] > 0.5  # the document's factors and deviations
    with pytest.raises(ValueError):
        other = tmp_path / "other.csv"
        other.write_text("a,b\n1,2\n")
        build.build_marts(spark, [str(other)], str(tmp_path / "none"))


def test_findings(spark):
    from tidemark.operators.findings import findings

    rows = spark.createDataFrame([(dt.date(2022, 1, 1 + k), float(v)) for k, v in enumerate((10, 20, 40, 15, 18, 12))], "date date, v double")
    got = {r["finding"]: (r["date"].day, r["value"]) for r in findings(rows, "date", "v").collect()}
    assert got == {"highest": (3, 40.0), "lowest": (1, 10.0), "largest rise": (3, 40.0), "largest drop": (4, 15.0)}
    near = findings(rows, "date", "v", target="2022-03-01").collect()
    assert [(r["finding"], r["date"].day) for r in near][-1] == ("selected", 6) and len(near) == 5
    flat = findings(rows.limit(1), "date", "v").collect()
    assert [r["finding"] for r in flat] == ["highest"]  # the lowest is the same bucket, and there is no change


def test_search_covers_ids_divisible_by_50(spark, tmp_path):
    vectors = [(0, [1.0, 0.0], 1), (50, [1.0, 0.1], 1), *((i, [0.0, float(i)], 2) for i in range(1, 9))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    get = catalog.queries()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in get["tk6_filtered_top_k"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 0, (0, 2): 50, (50, 1): 50, (50, 2): 0}
    assert [tuple(r) for r in get["ag36_hit_at_k"](spark, str(tmp_path)).collect()] == [(1.0, 2)]
    gates = {r["query_id"]: r for r in get["rt4_strict_gate"](spark, str(tmp_path)).collect()}
    assert set(gates) == {0, 50} and all(r["answer"] and r["n"] == 5 and r["nearest"] == 0.00496 for r in gates.values())


def test_anomaly_quantiles_are_of_all_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 37 == 5, 1000.0 + F.col("id")).otherwise(F.rand(3)).alias("a"), F.rand(4).alias("b"))
    got = learning.anomaly_scores(rows, "k", ["a", "b"]).collect()
    assert 20 <= sum(r["score"] >= 1 for r in got) <= 40
    assert 1000 <= sum(r["score"] == 0 for r in got) <= 1100
    assert {"acceleration", "speed_estimated_kn", "speed_std_3", "speed_std_5", "speed_std_10"} <= set(learning_queries._ANOMALY)


def test_headers_with_commas_and_mixed_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a, b",c\n1,2\n')
    (tmp_path / "b.csv").write_text('c,d\n3,4\n')
    got = files.read_csv(spark, str(tmp_path))
    assert sorted(got.columns) == ["a, b", "c", "d"] and sorted((r["c"], r["d"]) for r in got.collect()) == [("2", None), ("3", "4")]
    assert [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), "*.csv").collect()] == ["a.csv", "b.csv"]


def test_records_of_either_feed(spark):
    from tidemark.functions import serialize

    point = spark.createDataFrame([("7.0", "2021-01-01T00:04:03.000Z", "54.1", "10.2", None, "se")], "MMSI string, timeposition string, LATITUDE string, longitude string, Speed string, Flag string")
    row = serialize.records(point).first()
    meta = json.loads(row["metadata"])
    assert row["id"].startswith("7_2021-01-01T00-04-03") and (meta["mmsi"], meta["speed"], meta["port_name"]) == ("7", -1.0, "unknown")
    visit = spark.createDataFrame([("Riga", "LV RIX", "2021-01-01T00:00:00.000Z", "7")], "portName string, PORTLOCODE string, portArrival string, vesselMMSI string")
    assert json.loads(serialize.records(visit).first()["metadata"])["country_prefix"] == "LV"
    assert serialize.records(spark.createDataFrame([(1,)], "x int")) is None


@pytest.mark.parametrize("raw, want", [("2021-02-03T04:05:06.000Z", "2021-02-03 04:05:06"), ("03.02.2021 04:05", "2021-02-03 04:05:00"), ("3 Feb 2021", "2021-02-03 00:00:00"), ("20210203", "2021-02-03 00:00:00"), ("2021/02/03 04:05", "2021-02-03 04:05:00"), ("soon", None), (None, None)])
def test_forms_of_times(spark, raw, want):
    assert one(spark, F.date_format(clean.timestamp(F.lit(raw).cast("string")), "yyyy-MM-dd HH:mm:ss")) == want


def test_exports_fall_back(spark, tmp_path):
    rows = spark.range(2)
    (tmp_path / "file").write_text("x")
    table, document = files.export(rows, str(tmp_path / "file"), "s", str(tmp_path / "good"))
    assert table.startswith(str(tmp_path / "good")) and spark.read.json(document).count() == 2
    assert files.export(rows, str(tmp_path / "file"), "s") == (None, None)


def test_pages_that_failed_are_left_out(spark):
    pages = spark.createDataFrame([(1, "u", "<p>abc</p>", 200), (2, "v", "<p>no</p>", 404), (3, "w", None, 200)], "page_id long, url string, html string, status int")
    assert [tuple(r) for r in files.page_chunks(pages, "page_id", 2, 0, status="status").collect()] == [(1, "u", 0, "ab"), (1, "u", 1, "c")]


def test_isolation_scores_are_path_lengths():
    """Scores of whole batches against each row's walk down each tree."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), [[9.0, 9.0, 9.0], [np.nan, 0.0, 0.0]]])
    median, center, scale = np.zeros(3), np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    forest = learning.IsolationForest(trees=20, sample=64).fit(x, median, center, scale)
    got = forest.score(x)
    for i in (0, 5, 300, 301):
        row = (np.where(np.isnan(x[i]), median, x[i]) - center) / scale
        total = 0.0
        for feature, cut, depth in forest.nodes:
            at = 1
            while feature[at] >= 0:
                at = 2 * at + int(row[feature[at]] >= cut[at])
            total += depth[at]
        usual = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
        assert got[i] == pytest.approx(-(2 ** (-total / 20 / usual)))
    assert got.argmin() == 300


def test_destinations_and_arrival_times_against_plain_figures(spark):
    """Ranks and probabilities of classes, held-out accuracy, and errors of minutes, recomputed row by row."""
    import random

    rng = random.Random(9)
    rows = spark.createDataFrame([(i, float(i % 3) + rng.random() / 2, "abc"[i % 3], float(i % 3) * 100 + 50) for i in range(240)], "event_id long, x double, label string, minutes double")
    train, test = rows.filter("event_id < 180"), rows.filter("event_id >= 180")
    model = learning.fit_destination(train, "label", ["x"], [], trees=5)
    found = learning.top_classes(model, test, "event_id", "label", 2).collect()
    by_row: dict = {}
    for r in found:
        by_row.setdefault(r["event_id"], []).append((r["rank"], r["probability"], r["label"]))
    assert len(by_row) == 60 and all(len(v) == 2 for v in by_row.values())
    for own in by_row.values():
        (_, first, _), (_, second, _) = sorted(own)
        assert 1 + 1e-9 >= first >= second >= 0 and first + second <= 1 + 1e-9
    from tidemark.operators import serving

    accuracy = serving.top_k_accuracy(learning.top_classes(model, test, "event_id", "label", 2), test, "event_id", "label", 1).first()
    hits = sum(min(by_row[i])[2] == "abc"[i % 3] for i in range(180, 240))
    assert (accuracy["accuracy"], accuracy["rows"]) == (hits / 60, 60) and hits >= 57
    eta = learning.fit_eta(train, "minutes", ["x"], iterations=5)
    errors = [abs(r["prediction"] - r["minutes"]) for r in eta.transform(test).collect()]
    got = learning.eta_errors(eta, test, "minutes").first()
    assert got["mae"] == pytest.approx(sum(errors) / 60) and got["rmse"] == pytest.approx((sum(e * e for e in errors) / 60) ** 0.5) and got["mae"] < 10


def _pages(content):
    if b"broken" in content:
        raise ValueError
    return content.decode().split("\f")


def test_documents_with_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"first  page\fsecond")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"other")
    got = files.page_text_chunks(spark, str(tmp_path), _pages, size=6, overlap=0)
    assert sorted((r["page"], r["chunk_no"], r["chunk"]) for r in got.collect()) == [(1, 0, "first "), (1, 1, "page"), (2, 0, "second")]


def test_settings_and_profiles(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x:\n  y: [1, 2]\n")
    (tmp_path / "a.json").write_text('{"x": 3}')
    assert files.read_config(spark, str(tmp_path / "a.yaml")) == {"x": {"y": [1, 2]}} and files.read_config(spark, str(tmp_path / "a.json")) == {"x": 3}
    rows = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k)) for k in range(9)], "n int, day date")
    got = files.profile_document({"t": (rows, "day"), "u": (rows.select("n"), None)})
    assert (got["t"]["rows"], got["t"]["first"], got["t"]["last"], len(got["t"]["samples"]), got["u"]["columns"]) == (9, "2024-01-01", "2024-01-09", 5, ["n"])


def test_bounds_of_requests():
    emissions.check_estimate(240, 60, 1, 1, 0)
    for wrong in ({"hours": 0}, {"hours": 241}, {"speed_kn": -1}, {"mcr_kw": 0}, {"aux_kw": -1}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            emissions.check_estimate(**wrong)
    assert router.pollutants_of("NOx, CO2 ,") == ["NOx", "CO2"] and router.pollutants_of("") == ["CO2e", "NOx", "SOx", "PM"]
