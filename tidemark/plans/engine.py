"""Answers: a parsed question, the tables at hand, one lazily computed result table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import emissions, forecast, questions, trajectory
from ..storage import written
from .ports import Catalog
from .router import NAMES, NEEDS, Question, metric_column, parse, unsupported_hits


@dataclass
class Answer:
    """status: ok, no_data or unsupported; state: for emissions. table is computed once and read from the shared folder."""

    intent: str
    status: str
    table: DataFrame | None = None
    state: str | None = None
    notes: list[str] = field(default_factory=list)
    port: str | None = None
    diagnostics: dict[str, object] = field(default_factory=dict)


class Engine:
    """tables by name: arrivals_daily, arrivals_hourly, dwell_time, congestion_daily, positions, segments, daily_port, port_catalog.

    Without a port_catalog the ports of arrivals_daily are the catalog, and without that every token stands for itself.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables, self._catalog = spark, tables, None

    @property
    def catalog(self) -> Catalog | None:
        if self._catalog is None and ("port_catalog" in self.tables or "arrivals_daily" in self.tables):
            rows = self.tables.get("port_catalog")
            if rows is None:
                rows = self.tables["arrivals_daily"].groupBy("port_key").agg(F.sum("arrivals_vessels").alias("arrivals_total"))
            self._catalog = Catalog.of(rows)
        return self._catalog

    def ask(self, text: str, today: dt.date | None = None, port: str | None = None) -> Answer:
        """port: a filter that comes before the question's own ports."""
        q = parse(text, today)
        if q.intent == "G":
            return Answer("G", "unsupported", notes=["needs terminal operations data", *unsupported_hits(text)])
        missing = [t for t in NEEDS[q.intent] if t not in self.tables and t != "events"]
        if missing and q.assumptions is None:
            return Answer(q.intent, "no_data", notes=[f"missing: {', '.join(missing)}"])
        notes = []
        if (q.ports or port) and self.catalog is not None and self.catalog.ports:
            scope = self.catalog.scope(q, port)
            several = [r for source, _, r, known in scope.candidates if known and source != "scan"]
            q.ports = list(dict.fromkeys(several)) or ([scope.port] if scope.port else [])
            notes += [scope.note] if scope.note else []
        elif port:
            q.ports = [port, *(p for p in q.ports if p != port)]
        answer = {
            "A": self._describe, "B": self._pattern, "C": self._forecast, "D": self._compare, "E": self._diagnose,
            "F": self._anomaly, "H": self._emissions,
        }[q.intent](q)
        answer.port, answer.notes = q.port, answer.notes + notes
        return answer

    def _scoped(self, name: str, date: str, q: Question) -> DataFrame:
        rows = self.tables[name]
        if q.port:
            rows = questions.port_filter(rows, q.port, ("port_key",), ("port_key",))
        if q.vessel_type and "vessel_type_norm" in rows.columns:
            rows = rows.filter(F.lower("vessel_type_norm").contains(q.vessel_type))
        return questions.dates(rows, date, q.date_from, q.date_to, q.last_weeks)

    def _done(self, q: Question, table: DataFrame) -> Answer:
        table = written(table, "answer")  # an aggregate's worth of rows, so that no answer is computed twice
        return Answer(q.intent, "ok" if not table.isEmpty() else "no_data", table, notes=[NAMES[q.intent]])

    def _describe(self, q: Question) -> Answer:
        low = q.text.lower()
        if q.mmsi and "dwell_time" in self.tables:
            return self._done(q, questions.vessel_stays(self._scoped("dwell_time", "arrival_time", q), q.mmsi))
        if q.metric == "dwell":
            return self._done(q, questions.dwell_summary(self._scoped("dwell_time", "arrival_time", q), "vessel_type_norm"))
        if q.metric == "congestion":
            return self._done(q, questions.congestion_by_day(self._scoped("congestion_daily", "date", q)))
        rows = self._scoped("arrivals_daily", "date", q)
        if q.weekdays:
            rows = questions.weekday_filter(rows, "date", q.weekdays[0])
        if "top" in low and "port" in low:
            return self._done(q, questions.top_ports(rows))
        return self._done(q, questions.peak_day(rows) if q.peak else questions.by_day(rows))

    def _pattern(self, q: Question) -> Answer:
        if len(q.weekdays) > 1:
            return self._done(q, questions.compare_weekdays(self._scoped("arrivals_daily", "date", q), *q.weekdays[:2]))
        if "hour" in q.text.lower():
            return self._done(q, questions.busiest_hour(self._scoped("arrivals_hourly", "datetime_hour", q)))
        return self._done(q, questions.busiest_weekday(self._scoped("arrivals_daily", "date", q)))

    def _forecast(self, q: Question) -> Answer:
        congested = q.metric == "congestion" and "congestion_daily" in self.tables
        name, value = ("congestion_daily", "congestion_index") if congested else ("arrivals_daily", "arrivals_vessels")
        rows = self.tables[name].withColumn("_all", F.lit(1))
        keys = ["port_key"] if len(q.ports) > 1 else ["_all"]
        if q.ports:
            rows = rows.filter(F.upper("port_key").isin(*[p.upper() for p in q.ports]))
        own = forecast.series(rows, keys, "date", value)
        if len(q.ports) > 1:
            return self._done(q, forecast.compare(own, keys, 7 * q.horizon_weeks))
        if q.target_date:
            seen = own.filter(F.col("date") == F.lit(q.target_date).cast("date"))
            if not seen.isEmpty():
                return self._done(q, seen)
            ahead = forecast.forecast(own, keys, 7 * q.horizon_weeks, least=14).filter(F.col("date") == F.lit(q.target_date).cast("date"))
            return self._done(q, ahead if not ahead.isEmpty() else forecast.seasonal_analog(own, keys, q.target_date))
        if congested and q.weekdays and q.weekdays[0] in questions.WEEKDAYS:
            return self._done(q, forecast.congestion_on_weekday(own, keys, questions.WEEKDAYS.index(q.weekdays[0]), q.horizon_weeks))
        return self._done(q, forecast.forecast(own, keys, 7 * q.horizon_weeks, least=14))

    def _compare(self, q: Question) -> Answer:
        ports = [p.upper() for p in q.ports] or [r["port_key"] for r in questions.top_ports(self.tables["arrivals_daily"], 5).collect()]
        return self._done(
            q,
            questions.compare_ports(
                ports, self.tables["arrivals_daily"], self.tables["dwell_time"], self.tables["congestion_daily"],
            ),
        )

    def _diagnose(self, q: Question) -> Answer:
        daily = self.tables["arrivals_daily"]
        day = q.target_date or q.date_to or str(daily.agg(F.max("date")).first()[0])
        return self._done(q, questions.diagnose(daily, self.tables["dwell_time"], (q.port or "").upper(), day))

    def _anomaly(self, q: Question) -> Answer:
        if "positions" in self.tables and any(w in q.text.lower() for w in ("jump", "suspicious", "spoof", "teleport", "impossible")):
            rows = self.tables["positions"]
            return self._done(q, trajectory.suspicious_jumps(rows.filter(F.col("mmsi") == q.mmsi) if q.mmsi else rows))
        rows = questions.by_day(self._scoped("arrivals_daily", "date", q)).withColumn("_all", F.lit(1))
        return self._done(q, questions.spikes(rows, ["_all"], "arrivals").drop("_all"))

    def _emissions(self, q: Question) -> Answer:
        low = q.text.lower()
        if q.assumptions is not None:
            given = dict(q.assumptions)
            kind = str(given.pop("vessel_type"))
            table = written(emissions.estimate(self.spark, emissions.class_of(kind), **given), "answer")
            total = table.first()[metric_column("CO2e", q.boundary)]
            return Answer("H", "ok", table, emissions.result_state(1, total), diagnostics={"assumptions": q.assumptions, "sanity_status": "checked"})
        if not q.call_id and any(w in low for w in ("predict", "forecast", "next")) and not (q.date_from and q.date_from != q.target_date):
            return Answer("H", "no_data", state="FORECAST_ONLY", notes=["emissions are computed for the past only"])
        rows, metric = self.tables["segments"], metric_column(q.pollutants[0], q.boundary)
        if q.date_from and q.date_to and q.date_from > q.date_to:
            return Answer("H", "no_data", state="NOT_COMPUTABLE", notes=["the range ends before it begins"])
        if q.call_id:
            rows = match_call(rows.filter(F.col("mmsi").cast("string") == q.mmsi) if q.mmsi else rows, q.call_id)
            found = [r["call_id"] for r in rows.select("call_id").distinct().limit(10).collect()]
            if len(found) != 1:
                return Answer(
                    "H", "no_data", state="NOT_COMPUTABLE", notes=["several calls" if found else "no such call"],
                    diagnostics={"candidates": found, "sanity_status": "warning" if found else "checked"},
                )
            table, state = emissions.roll_up(emissions.call_linked(rows), ["call_id"]), None
        else:
            daily = self.tables.get("daily_port")
            daily = emissions.roll_up(rows.withColumn("date", F.to_date("timestamp_start")), ["date", "port_key"]) if daily is None else daily
            if q.port:
                rows, daily = (questions.port_filter_loose(x, q.port, ("port_key",)) for x in (rows, daily))
            if q.date_from and q.date_to:
                rows, daily = questions.dates_whole_days(rows, "timestamp_start", q.date_from, q.date_to), daily.filter(
                    F.col("date").between(F.lit(q.date_from).cast("date"), F.lit(q.date_to).cast("date"))
                )
            monthly = "monthly" in low or "per month" in low
            # the rule holds for the scope as a whole: daily rows only where no call is in it
            table = emissions.port_emissions(emissions.with_intervals(rows), daily, "month" if monthly else "day", [] if not q.port else ["port_key"])
        table = written(table, "answer")
        total = table.agg(F.count("*").alias("n"), F.sum(metric).alias("t")).first()
        checks = emissions.scope_diagnostics(rows, metric, baseline=self.tables.get("daily_port")).first()
        diagnostics = {
            **checks.asDict(), "total": total["t"],
            "mode": ",".join(r[0] for r in table.select("basis").distinct().collect()) if "basis" in table.columns else "call",
        }
        state = emissions.result_state(total["n"], total["t"], evidence=checks["raw_rows"])
        return Answer(
            "H", "ok" if state.startswith("COMPUTED") else "no_data", table, state, [str(w) for w in checks["warnings"]],
            diagnostics=diagnostics,
        )


def match_call(rows: DataFrame, call: str) -> DataFrame:
    """Rows of a call id: equal but for leading marks, else equal in letters and digits."""
    from ..functions.clean import canonical_call

    exact = rows.filter(F.regexp_replace("call_id", r"^[\s:_\-]+", "") == call)
    if not exact.isEmpty():
        return exact
    return rows.filter(canonical_call(F.col("call_id")) == canonical_call(F.lit(call)))
