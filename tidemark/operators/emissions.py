"""Emissions inventory: modes, factors, row emissions, segments, roll-ups with intervals, questions over them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import VESSEL_CLASSES, evidence_id
from . import questions

# The factor registry (kW, knots, g/kWh, t/t, kg/t, relative standard deviations).
VESSELS = {
    "tanker": (12000, 13.0, "HFO", "slow_speed_diesel"),
    "cargo": (9000, 12.5, "MGO", "medium_speed_diesel"),
    "container": (15000, 17.0, "HFO", "slow_speed_diesel"),
    "passenger": (18000, 19.0, "MGO", "medium_speed_diesel"),
    "service": (3500, 10.0, "MDO", "high_speed_diesel"),
    "unknown": (8000, 12.0, "MGO", "medium_speed_diesel"),
}
FUELS = {"MGO": (3.206, 0.62), "HFO": (3.114, 0.74), "LNG": (2.75, 1.05), "MDO": (3.19, 0.66)}
MODES = {"transit": (185, 210, 0.001), "manoeuvring": (195, 215, 0.0015), "berth": (0, 220, 0.001), "anchorage": (0, 220, 0.0012)}
AUX_KW = {
    "transit": {"tanker": 900, "cargo": 700, "container": 850, "passenger": 1200, "service": 450, "unknown": 600},
    "manoeuvring": {"tanker": 1250, "cargo": 950, "container": 1150, "passenger": 1500, "service": 650, "unknown": 850},
    "berth": {"tanker": 650, "cargo": 550, "container": 700, "passenger": 1100, "service": 350, "unknown": 500},
    "anchorage": {"tanker": 520, "cargo": 460, "container": 560, "passenger": 900, "service": 320, "unknown": 420},
}
NOX = {
    "slow_speed_diesel": {"transit": 65.0, "manoeuvring": 62.0, "berth": 38.0, "anchorage": 41.0},
    "medium_speed_diesel": {"transit": 55.0, "manoeuvring": 53.0, "berth": 34.0, "anchorage": 37.0},
    "high_speed_diesel": {"transit": 45.0, "manoeuvring": 43.0, "berth": 28.0, "anchorage": 30.0},
}
PM = {
    "slow_speed_diesel": {"transit": 1.6, "manoeuvring": 1.55, "berth": 1.2, "anchorage": 1.25},
    "medium_speed_diesel": {"transit": 1.3, "manoeuvring": 1.25, "berth": 1.0, "anchorage": 1.05},
    "high_speed_diesel": {"transit": 0.95, "manoeuvring": 0.9, "berth": 0.75, "anchorage": 0.8},
}
SIGMAS = {"speed": 0.08, "sfc": 0.10, "factor": 0.08, "interpolation": 0.10, "gap": 0.08, "fallback": 0.12}
SOX_MULTIPLIER, DEFAULT_FUEL, DEFAULT_ENGINE = 2.0, "MGO", "medium_speed_diesel"
# Where the document lacks a mode or a class: kW, g/kWh of main and auxiliary engine, t/t of sulphur, kg/t of NOx and PM.
MISSING_AUX_KW, MISSING_SFC_MAIN, MISSING_SFC_AUX, MISSING_SULFUR, MISSING_NOX, MISSING_PM = 600.0, 0.0, 220.0, 0.001, 45.0, 1.0
# Limits beyond which a scope's figures are doubted: hours and t CO2e of a call, t CO2e of a baseline.
SANE_HOURS, SANE_CALL_T, SANE_BASELINE_T = 240.0, 500.0, 1.0
# End of the fixed values.

POLLUTANTS = ("co2_t", "ttw_co2e_t", "wtt_co2e_t", "wtw_co2e_t", "nox_kg", "sox_kg", "pm_kg")


def registry() -> dict:
    """The factors as one document, which can be edited and given to factor_tables()."""
    return {"vessels": VESSELS, "fuels": FUELS, "modes": MODES, "aux_kw": AUX_KW, "nox": NOX, "pm": PM, "sigmas": SIGMAS}


def from_document(document: dict) -> dict:
    """registry() from a factor document: vessel_defaults, fuel_factors, mode_defaults, nox_ and pm_kg_per_t_fuel_by_engine_mode,
    uncertainty_defaults. Parts that the document lacks are the built-in ones; `version` is carried along."""
    own = registry()
    modes = document.get("mode_defaults", {})
    main, aux, sulfur = (modes.get(k, {}) for k in ("sfc_main_g_per_kwh", "sfc_aux_g_per_kwh", "sulfur_fraction"))
    parts = {
        "vessels": {c: (v.get("mcr_kw", 8000), v.get("ref_speed_kn", 12.0), v.get("fuel", DEFAULT_FUEL), v.get("engine_family", DEFAULT_ENGINE)) for c, v in document.get("vessel_defaults", {}).items()},
        "fuels": {k: (v.get("co2_t_per_t_fuel", FUELS[DEFAULT_FUEL][0]), v.get("wtt_co2e_t_per_t_fuel", FUELS[DEFAULT_FUEL][1])) for k, v in document.get("fuel_factors", {}).items()},
        "modes": {m: (main.get(m, MISSING_SFC_MAIN), aux.get(m, MISSING_SFC_AUX), sulfur.get(m, MISSING_SULFUR)) for m in {**main, **aux, **sulfur}},
        "aux_kw": modes.get("aux_power_kw", {}), "nox": document.get("nox_kg_per_t_fuel_by_engine_mode", {}), "pm": document.get("pm_kg_per_t_fuel_by_engine_mode", {}),
        "sigmas": {**own["sigmas"], **{k: v for k, v in document.get("uncertainty_defaults", {}).items() if k in own["sigmas"]}},
    }
    out = {k: v or own[k] for k, v in parts.items()}
    for needed, default in (("vessels", "unknown"), ("fuels", DEFAULT_FUEL)):
        out[needed] = {default: own[needed][default], **out[needed]}
    return {**out, "version": str(document.get("version", "unknown"))}


def registry_hash(factors: dict) -> str:
    return hashlib.sha256(json.dumps(factors, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def class_of(vessel_type: str) -> str:
    """vessel_class() of one type, on the driver."""
    key = vessel_type.strip().lower()
    return VESSEL_CLASSES.get(key) or next((c for t, c in VESSEL_CLASSES.items() if t in key), "unknown")


def assign_modes(rows: DataFrame) -> DataFrame:
    """mode from speed and the visit's window; speed_kn: reported, else estimated, else 0."""
    speed = F.greatest(F.coalesce("speed", "speed_estimated_kn", F.lit(0.0)), F.lit(0.0))
    own = rows.withColumn("speed_interpolated", F.col("speed").isNull() & F.col("speed_estimated_kn").isNotNull()).withColumn("speed_kn", speed)
    near = lambda c, before, after: (
        F.col("ts") >= F.col(c) - F.expr(f"interval {before} hours")
    ) & (F.col("ts") <= F.col(c) + F.expr(f"interval {after} hours"))
    v, inside = F.col("speed_kn"), F.coalesce("inside_call", F.lit(False))
    moving = v.between(0.5, 8.0) & F.coalesce(near("arrival_time", 2, 1) | near("departure_time", 1, 2), F.lit(False))
    mode = F.when(~inside, "transit").when(moving, "manoeuvring").when(v <= 0.5, "berth").when(v <= 2.0, "anchorage").otherwise("transit")
    return own.withColumn("mode", mode)


def _lookup(values: dict[str, object], key: Column, default: object) -> Column:
    table = F.create_map(*[F.lit(float(x) if isinstance(x, (int, float)) else x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default) if isinstance(default, (int, float)) else default))


def _by_class_and_mode(rows: DataFrame, f: dict) -> DataFrame:
    """The factors of add_factors() where rows state none: one look-up a row, in a literal map of all classes and modes and of others."""
    other = "other"
    modes = dict.fromkeys([*f["modes"], *f["aux_kw"], *(m for t in (f["nox"], f["pm"]) for own in t.values() for m in own)])
    classes = dict.fromkeys([*f["vessels"], *(c for own in f["aux_kw"].values() for c in own)])
    cells = {}
    for c in (*classes, None):
        mcr, speed, fuel, engine = f["vessels"].get(c, f["vessels"]["unknown"])
        family = engine if engine in f["nox"] else DEFAULT_ENGINE
        co2, wtt = f["fuels"].get(fuel, f["fuels"][DEFAULT_FUEL])
        for m in (*modes, None):
            power = f["aux_kw"].get(m, {})
            main, aux, sulfur = f["modes"].get(m, (MISSING_SFC_MAIN, MISSING_SFC_AUX, MISSING_SULFUR))
            cells[c, m] = {
                "mcr_kw": mcr, "ref_speed_kn": speed, "fuel_type": fuel, "engine_family": engine, "aux_power_kw": power.get(c, power.get("unknown", MISSING_AUX_KW)),
                "sfc_main": main, "sfc_aux": aux, "sulfur": sulfur, "co2_factor": co2, "wtt_factor": wtt,
                "nox_factor": f["nox"].get(family, {}).get(m, MISSING_NOX), "pm_factor": f["pm"].get(family, {}).get(m, MISSING_PM),
            }
    name = lambda x: other if x is None else f"={x}"
    value = lambda cell: F.struct(*[F.lit(v if isinstance(v, str) else float(v)).alias(k) for k, v in cell.items()])
    table = F.create_map(*[x for (c, m), cell in cells.items() for x in (F.lit(f"{name(c)}|{name(m)}"), value(cell))])
    known = lambda c, names: F.when(F.col(c).isin(*names), F.concat(F.lit("="), F.col(c))).otherwise(other)
    own = rows.withColumn("_factors", F.try_element_at(table, F.concat_ws("|", known("vessel_class", classes), known("mode", modes))))
    return own.withColumns({k: F.col("_factors")[k] for k in cells[None, None]}).drop("_factors")


def _by_stated(rows: DataFrame, f: dict, stated: dict[str, str]) -> DataFrame:
    """The factors of add_factors() where rows state some, in the columns that `stated` names."""
    cls, mode = F.col("vessel_class"), F.col("mode")
    column = lambda k: {c: v[k] for c, v in f["vessels"].items()}
    own = rows
    for name, k in (("mcr_kw", 0), ("ref_speed_kn", 1), ("fuel_type", 2), ("engine_family", 3)):
        value = _lookup(column(k), cls, f["vessels"]["unknown"][k])
        own = own.withColumn(name, F.coalesce(stated[name], value) if name in stated else value)
    flat = lambda t: {f"{a}|{b}": x for a, inner in t.items() for b, x in inner.items()}
    known = F.col("engine_family").isin(*f["nox"])
    engine_mode = F.concat_ws("|", F.when(known, F.col("engine_family")).otherwise(DEFAULT_ENGINE), mode)
    of_class = _lookup(flat(f["aux_kw"]), F.concat_ws("|", mode, F.lit("unknown")), MISSING_AUX_KW)
    aux = F.create_map(*[F.lit(x) for k, v in flat(f["aux_kw"]).items() for x in (k, float(v))])
    own = own.withColumns({
        "aux_power_kw": F.coalesce(*([F.col(stated["aux_power_kw"])] if "aux_power_kw" in stated else []), F.try_element_at(aux, F.concat_ws("|", mode, cls)), of_class),
        "sfc_main": _lookup({m: v[0] for m, v in f["modes"].items()}, mode, MISSING_SFC_MAIN),
        "sfc_aux": _lookup({m: v[1] for m, v in f["modes"].items()}, mode, MISSING_SFC_AUX),
        "sulfur": _lookup({m: v[2] for m, v in f["modes"].items()}, mode, MISSING_SULFUR),
        "co2_factor": _lookup({k: v[0] for k, v in f["fuels"].items()}, F.col("fuel_type"), f["fuels"][DEFAULT_FUEL][0]),
        "wtt_factor": _lookup({k: v[1] for k, v in f["fuels"].items()}, F.col("fuel_type"), f["fuels"][DEFAULT_FUEL][1]),
        "nox_factor": _lookup(flat(f["nox"]), engine_mode, MISSING_NOX),
        "pm_factor": _lookup(flat(f["pm"]), engine_mode, MISSING_PM),
    })
    return own.drop(*stated.values())


def add_factors(rows: DataFrame, factors: dict | None = None) -> DataFrame:
    """Factors of each row's vessel_class and mode; literal maps of bounded size, so no join and no shuffle.

    Unknown classes have those of `unknown`, unknown fuels and engines those of the defaults, unknown modes MISSING_*.
    Columns mcr_kw, ref_speed_kn, fuel_type, engine_family and aux_power_kw that rows have already come first, where set.
    """
    stated = {c: f"_own_{c}" for c in ("mcr_kw", "ref_speed_kn", "fuel_type", "engine_family", "aux_power_kw") if c in rows.columns}
    f = factors or registry()
    own = _by_stated(rows.withColumnsRenamed(stated), f, stated) if stated else _by_class_and_mode(rows, f)
    return own.withColumn(
        "fallback_factor_flag",
        (F.col("vessel_class") == "unknown") | (F.col("fuel_type") == DEFAULT_FUEL) | (F.col("engine_family") == DEFAULT_ENGINE),
    )


def row_emissions(rows: DataFrame, sigmas: dict[str, float] | None = None) -> DataFrame:
    """Fuel, pollutants and relative standard deviation of rows with factors, speed_kn and duration_h."""
    s = sigmas or SIGMAS
    load = F.when(
        F.col("mode").isin("transit", "manoeuvring"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.pow(F.col("speed_kn") / F.col("ref_speed_kn"), 3))),
    ).otherwise(0.0)
    fuel = F.greatest(
        F.lit(0.0),
        (
            F.col("mcr_kw") * F.col("load_factor") * F.col("sfc_main") + F.col("aux_power_kw") * F.col("sfc_aux")
        ) * F.col("duration_h") / 1e6,
    )
    own = rows.withColumn("load_factor", load).withColumn("fuel_t", fuel)
    t = F.col("fuel_t")
    own = own.withColumns(
        {
            "co2_t": t * F.col("co2_factor"), "ttw_co2e_t": t * F.col("co2_factor"), "wtt_co2e_t": t * F.col("wtt_factor"),
            "wtw_co2e_t": t * F.col("co2_factor") + t * F.col("wtt_factor"), "nox_kg": t * F.col("nox_factor"),
            "sox_kg": t * F.col("sulfur") * 1000.0 * SOX_MULTIPLIER, "pm_kg": t * F.col("pm_factor"),
        }
    )
    base = (s["speed"] ** 2 + s["sfc"] ** 2 + s["factor"] ** 2) ** 0.5
    flag = lambda c, k: F.coalesce(F.col(c), F.lit(False)).cast("double") * s[k]
    sigma = F.lit(base) + flag("speed_interpolated", "interpolation") + flag("ais_gap_flag", "gap") + flag("fallback_factor_flag", "fallback")
    return own.withColumn("rel_sigma", F.least(F.lit(0.95), F.greatest(F.lit(0.05), sigma)))


def with_intervals(rows: DataFrame, sigma: str = "rel_sigma", metrics: tuple[str, ...] = POLLUTANTS) -> DataFrame:
    """<metric>_lower and _upper: total * (1 -+ 1.96 sigma), not below 0; ci_width_rel of the last metric's kind ttw."""
    out = {}
    for m in metrics:
        out[f"{m}_lower"] = F.greatest(F.lit(0.0), F.col(m) * (1 - 1.96 * F.col(sigma)))
        out[f"{m}_upper"] = F.greatest(F.lit(0.0), F.col(m) * (1 + 1.96 * F.col(sigma)))
    own = rows.withColumns(out)
    key = "wtw_co2e_t" if "wtw_co2e_t" in metrics else metrics[0]
    return own.withColumn("ci_width_rel", F.when(F.col(key) > 0, (F.col(f"{key}_upper") - F.col(f"{key}_lower")) / F.col(key)).otherwise(1.0))


def confidence(width: Column, fallback: Column) -> Column:
    return F.when((width <= 0.20) & (fallback <= 0.05), "high").when((width <= 0.40) | (fallback <= 0.20), "medium").otherwise("low")


def segment_totals(rows: DataFrame, tie: str = "event_id") -> DataFrame:
    """One row a segment: times, first and last known places, speeds, hours, ratios of flags, sums of pollutants.

    Where rows have them, call_id, port_key (AT_SEA where there is none) and vessel_class of the segment as well.
    """
    extra = {
        "call_id": F.max("call_id"), "port_key": F.coalesce(F.max("port_key"), F.lit("AT_SEA")),
        "vessel_class": F.min("vessel_class"),
    } if {"call_id", "port_key", "vessel_class"} <= set(rows.columns) else {}
    order = F.struct("ts", tie)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))
    ratio = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return rows.groupBy("segment_id", "mmsi", "mode").agg(
        F.min("ts").alias("timestamp_start"), F.max("ts").alias("timestamp_end"), F.count("*").alias("row_count"),
        F.sum("duration_h").alias("duration_h"), F.avg("speed_kn").alias("mean_speed_kn"), F.max("speed_kn").alias("max_speed_kn"),
        first("latitude").alias("lat_start"), last("latitude").alias("lat_end"), first("longitude").alias("lon_start"), last("longitude").alias("lon_end"),
        ratio("fallback_factor_flag").alias("fallback_usage_ratio"), ratio("ais_gap_flag").alias("gap_ratio"), ratio("speed_interpolated").alias("interpolated_ratio"),
        F.avg("rel_sigma").alias("rel_sigma"), F.sum("fuel_t").alias("fuel_t"), *[F.sum(m).alias(m) for m in POLLUTANTS],
        *[c.alias(name) for name, c in extra.items()],
    )


def with_evidence(segments: DataFrame, params_hash: str) -> DataFrame:
    own = with_intervals(segments)
    return own.withColumn(
        "confidence_label", confidence(F.col("ci_width_rel"), F.col("fallback_usage_ratio")),
    ).withColumn("evidence_id", evidence_id(F.col("segment_id"), F.lit(params_hash)))


def roll_up(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by keys with analytic intervals: distinct segments, hours, plain means of ratios and deviations."""
    own = segments.groupBy(*keys).agg(
        F.count_distinct("segment_id").alias("segments"), F.sum("duration_h").alias("duration_h"),
        F.sum("row_count").alias("row_count"), F.avg("fallback_usage_ratio").alias("fallback_usage_ratio"),
        F.avg("rel_sigma").alias("rel_sigma_weighted"), *[F.sum(m).alias(m) for m in POLLUTANTS],
    )
    own = own.withColumn("_sigma", F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("rel_sigma_weighted"))))
    return with_intervals(own, "_sigma").drop("_sigma").withColumn(
        "confidence_label", confidence(F.col("ci_width_rel"), F.col("fallback_usage_ratio")),
    )


def monte_carlo(rows: DataFrame, metric: str, sigma: str, key: str, draws: int = 500) -> DataFrame:
    """Interval from draws of a normal per row, seeded by the row's key: Box-Muller over md5, exact quantiles, in SQL."""
    word = lambda salt, i: F.substring(
        F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt), i.cast("string")).cast("binary")), 1, 12,
    )
    unit = lambda salt, i: (F.conv(word(salt, i), 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))
    normal = lambda i: F.sqrt(-2 * F.log(unit("a", i))) * F.cos(2 * 3.141592653589793 * unit("b", i))
    drawn = F.transform(
        F.sequence(F.lit(1), F.lit(draws)),
        lambda i: F.greatest(
            F.lit(0.0), F.col(metric) * (1 + F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col(sigma))) * normal(i)),
        ),
    )
    own = rows.withColumn("_draws", F.array_sort(drawn))
    at = lambda p: F.element_at("_draws", F.lit(max(1, round(p * (draws - 1)) + 1)))
    zero = F.col(metric) <= 0
    return own.withColumns(
        {f"{metric}_lower": F.when(zero, 0.0).otherwise(at(0.025)), f"{metric}_upper": F.when(zero, 0.0).otherwise(at(0.975))}
    ).drop("_draws")


def call_linked(segments: DataFrame) -> DataFrame:
    """Segments of a call, each once: the rows that an inventory counts."""
    return questions.call_linked(segments).dropDuplicates(["segment_id"])


def by_bucket(rows: DataFrame, time: str, bucket: str, keys: list[str]) -> DataFrame:
    """Sums and summed bounds by day or month and keys; the interval's width and the label follow from the sums."""
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[bucket]
    sums = [F.sum(f"{m}{side}").alias(f"{m}{side}") for m in POLLUTANTS for side in ("", "_lower", "_upper")]
    own = rows.filter(F.col(time).isNotNull()).withColumn("bucket", F.date_format(time, fmt)).groupBy("bucket", *keys).agg(
        F.count("*").alias("rows"), F.sum("row_count").alias("row_count"), F.sum("duration_h").alias("duration_h"), F.avg("fallback_usage_ratio").alias("fallback_usage_ratio"), *sums,
    )
    t = F.col("wtw_co2e_t")
    own = own.withColumn("ci_width_rel", F.when(t > 0, (F.col("wtw_co2e_t_upper") - F.col("wtw_co2e_t_lower")) / t).otherwise(1.0))
    return own.withColumn("confidence_label", confidence(F.col("ci_width_rel"), F.col("fallback_usage_ratio")))


def port_emissions(segments: DataFrame, daily: DataFrame, bucket: str, keys: list[str] | None = None) -> DataFrame:
    """Emissions of each port by day or month: from its call-linked segments; a port that has none in the scope has its
    daily rows instead (basis `daily_proxy`), which are never of high confidence."""
    keys = ["port_key"] if keys is None else keys
    linked = call_linked(segments)
    counted = by_bucket(linked, "timestamp_start", bucket, keys).withColumn("basis", F.lit("call_linked"))
    ports = linked.select(*keys).distinct()
    rest = daily.join(ports, keys, "left_anti") if keys else daily.join(linked.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti")
    proxy = by_bucket(rest, "date", bucket, keys).withColumn("basis", F.lit("daily_proxy"))
    capped = F.when(F.col("confidence_label") == "high", "medium").otherwise(F.col("confidence_label"))
    return counted.unionByName(proxy.withColumn("confidence_label", capped))


def scope_diagnostics(segments: DataFrame, metric: str, keys: list[str] | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """One row a scope (all, or each of keys): calls, hours, totals, mean, median and largest of per-call sums, repeated
    segments, warnings, and sanity_status. baseline: rows with keys and the metric, whose median is what changes are
    measured against; without any, a scope's baseline is unstable."""
    keys = keys or []
    call = F.coalesce(F.col("call_id").cast("string"), F.lit("")) != ""
    once = segments.dropDuplicates(["segment_id"])
    whole = segments.groupBy(*keys).agg(F.count("*").alias("raw_rows"), F.count_distinct("segment_id").alias("rows"))
    sums = once.groupBy(*keys).agg(F.sum("duration_h").alias("total_duration_h"), F.sum(metric).alias("total_t"))
    calls = once.filter(call).groupBy(*keys, "call_id").agg(F.sum(metric).alias("t"), F.sum("duration_h").alias("h")).groupBy(*keys)
    calls = calls.agg(
        F.count("*").alias("calls"), F.avg("t").alias("mean_t"), F.median("t").alias("median_t"), F.max("t").alias("largest_t"),
        F.median("h").alias("median_duration_h"), F.max("h").alias("longest_h"),
    )
    parts = [sums, calls]
    if baseline is not None:
        parts.append(baseline.groupBy(*keys).agg(F.median(metric).alias("baseline_t")))
    own = whole if keys else segments.agg(F.count("segment_id").alias("raw_rows"), F.count_distinct("segment_id").alias("rows"))
    for part in parts:  # one row a scope on either side
        own = own.join(part, keys, "left") if keys else own.crossJoin(F.broadcast(part))
    own = own.withColumn("calls", F.coalesce("calls", F.lit(0)))
    weak = (F.col("baseline_t").isNull() | (F.col("baseline_t") < SANE_BASELINE_T)) if baseline is not None else F.lit(False)
    tests = [
        (F.col("rows") == 0, "no segments"), (F.col("longest_h") > SANE_HOURS, "implausible call duration"),
        (F.col("largest_t") > SANE_CALL_T, "implausible call emissions"), (weak, "baseline too small"),
    ]
    own = own.withColumn("repeated", F.col("raw_rows") - F.col("rows"))
    own = own.withColumn("warnings", F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests])))
    status = F.when((F.col("rows") == 0) | weak, "unstable baseline").when(F.size("warnings") > 0, "warning").otherwise("checked")
    return own.withColumn("sanity_status", status)


def metrics(table: DataFrame, metric: str) -> DataFrame:
    """Totals and intensities: kg a call, t a day, kg an hour. Without a call_id each row is a call."""
    total, hours = F.sum(metric), F.sum("duration_h")
    calls = F.count_distinct("call_id") if "call_id" in table.columns else F.count("*")
    return table.agg(
        total.alias("total_t"), calls.alias("calls"), F.try_divide(total * 1000, calls).alias("kg_per_call"),
        F.try_divide(total, F.count_distinct("date")).alias("t_per_day"), F.try_divide(total * 1000, hours).alias("kg_per_hour"),
    )


def bands(values: DataFrame, column: str, shares: tuple[float, float, float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Levels by the column's percentiles."""
    cut = values.agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("_p"))
    v = F.col(column)
    level = F.when(v <= F.col("_p")[0], "Low").when(v <= F.col("_p")[1], "Moderate").when(v <= F.col("_p")[2], "High").otherwise("Very High")
    return values.crossJoin(F.broadcast(cut)).withColumn("level", level).drop("_p")  # one row


def estimate(
    spark: SparkSession, vessel_class: str = "unknown", mode: str = "transit", hours: float = 1.0, speed_kn: float = 10.0,
    fuel: str | None = None, mcr_kw: float | None = None, ref_speed_kn: float | None = None, engine: str | None = None,
    aux_kw: float | None = None,
) -> DataFrame:
    """A scenario's emissions from stated assumptions, with bounds of 1.96 * 0.30. What isn't stated has the class's value;
    negative hours and speeds count as 0, and an unknown fuel has the default fuel's factors."""
    stated = {
        "fuel_type": fuel.upper() if fuel else None, "mcr_kw": mcr_kw, "ref_speed_kn": ref_speed_kn, "engine_family": engine,
        "aux_power_kw": aux_kw,
    }
    given = [F.lit(v if isinstance(v, str) else float(v)).alias(c) for c, v in stated.items() if v]
    row = spark.range(1).select(
        F.lit(vessel_class).alias("vessel_class"), F.lit(mode).alias("mode"), F.lit(max(0.0, float(hours))).alias("duration_h"),
        F.lit(max(0.0, float(speed_kn))).alias("speed_kn"), F.lit(False).alias("speed_interpolated"),
        F.lit(False).alias("ais_gap_flag"), *given,
    )
    own = row_emissions(add_factors(row))
    bounds = {f"{m}_{side}": F.greatest(F.lit(0.0), F.col(m) * (1 + sign * 1.96 * 0.30)) for m in POLLUTANTS for side, sign in (("lower", -1), ("upper", 1))}
    return own.select("vessel_class", "mode", "duration_h", "speed_kn", "fuel_type", "load_factor", "fuel_t", *POLLUTANTS).withColumns(bounds)


def check_estimate(
    hours: float = 1.0, speed_kn: float = 10.0, mcr_kw: float | None = None, ref_speed_kn: float | None = None,
    aux_kw: float | None = None,
) -> None:
    """ValueError for a request out of bounds: hours in (0, 240], knots in [0, 60], powers and reference speeds above 0."""
    for name, value, ok in (
        ("hours", hours, 0 < hours <= SANE_HOURS), ("speed_kn", speed_kn, 0 <= speed_kn <= 60),
        ("mcr_kw", mcr_kw, mcr_kw is None or mcr_kw > 0),
        ("ref_speed_kn", ref_speed_kn, ref_speed_kn is None or ref_speed_kn > 0),
        ("aux_kw", aux_kw, aux_kw is None or aux_kw >= 0),
    ):
        if not ok:
            raise ValueError(f"{name} is out of bounds: {value}")


def result_state(rows: int, total: float | None, evidence: int = 0, forecast_only: bool = False) -> str:
    """COMPUTED, COMPUTED_ZERO, NOT_COMPUTABLE, RETRIEVAL_ONLY or FORECAST_ONLY."""
    if forecast_only:
        return "FORECAST_ONLY"
    if rows and total is not None:
        return "COMPUTED_ZERO" if abs(total) < 1e-12 else "COMPUTED"
    return "RETRIEVAL_ONLY" if evidence else "NOT_COMPUTABLE"
