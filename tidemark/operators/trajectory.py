"""Trajectories: lags, speeds, rolling features, interval repair, jumps, segments, as-of joins.

Positions have (mmsi, ts, latitude, longitude, speed) and a tie-breaking id.

A vessel's history is cut into ranges of RANGE_H hours, and windows are over ranges, not vessels, so no task has more of a
history than a range. What crosses a range's ends is carried by copies of rows: a range begins with the rows that precede it in
the history, wherever they stand, and ends with the one that follows it. Copies are found from one row a vessel and range
(or as many as a window looks back), so a window over a vessel has rows by ranges, not by positions. Running counts and as-of
matches are scanned in the same two levels. Rows that have gone through ranged() keep their ranges from one function to
the next, and are dealt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.clean import first_present
from ..functions.geo import angle_between, haversine_km, planar_km
from ..storage import written
from .marts import micros


#: Hours of a range.
RANGE_H = 24
_BEFORE, _OWN, _AFTER = 0, 1, 2
#: The range of rows without a time, which come first.
_UNTIMED = -(1 << 40)


def track(tie: str = "event_id") -> WindowSpec:
    """A range of a vessel's history, between the copies that it begins and ends with."""
    return Window.partitionBy("mmsi", "_range").orderBy("_kind", "ts", tie)


def _range_of(rows: DataFrame, time: str) -> Column:
    """The number of the range; numbers count as seconds."""
    number = isinstance(rows.schema[time].dataType, NumericType)
    at = F.col(time) / F.lit(3600.0 * RANGE_H) if number else micros(time) / F.lit(3.6e9 * RANGE_H)
    return F.coalesce(F.floor(at).cast("long"), F.lit(_UNTIMED))


def ranged(rows: DataFrame) -> DataFrame:
    """rows with _range, which the functions of this module then keep; drop it in the end."""
    return rows if "_range" in rows.columns else rows.withColumn("_range", _range_of(rows, "ts"))


def _copies(narrow: DataFrame, kind: int, n: int, tie: str) -> DataFrame:
    """For each range of narrow (mmsi, _range, ts, tie and others) copies of the n rows before it, or of the one after it."""
    keys, at = ["mmsi", "_range"], F.struct("ts", tie)
    row = F.struct(*[F.col(c) for c in narrow.columns if c not in keys])
    if n == 1:
        edges = narrow.groupBy(*keys).agg((F.max_by if kind == _BEFORE else F.min_by)(row, at).alias("_row"))
        near = (F.lag if kind == _BEFORE else F.lead)("_row").over(Window.partitionBy("mmsi").orderBy("_range"))
        return edges.withColumn("_row", near).filter("_row is not null").select(*keys, "_row.*", F.lit(kind).alias("_kind"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc(tie)))
    last = narrow.withColumn("_back", back).filter(F.col("_back") <= n)
    w = Window.partitionBy("mmsi").orderBy("_range", F.desc("_back"))
    first = last.select(*keys, F.collect_list(row).over(w.rowsBetween(-n, -1)).alias("_rows"), (F.lag("_range").over(w) != F.col("_range")).alias("_first"))
    return first.filter("_first").select(*keys, F.inline("_rows"), F.lit(kind).alias("_kind"))


def _neighboured(rows: DataFrame, columns: list[str], tie: str, before: int = 1) -> DataFrame:
    """rows with _range and _kind, and copies, with these columns, of the rows before each range."""
    own = ranged(rows)
    narrow = own.select("mmsi", "_range", "ts", tie, *[c for c in dict.fromkeys(columns) if c not in ("ts", tie)])
    return own.withColumn("_kind", F.lit(_OWN)).unionByName(_copies(narrow, _BEFORE, before, tie), allowMissingColumns=True)


def _settled(both: DataFrame, rows: DataFrame) -> DataFrame:
    """both without copies, and without ranges unless rows have them."""
    own = both.filter(F.col("_kind") == _OWN).drop("_kind")
    return own if "_range" in rows.columns else own.drop("_range")


def lagged(rows: DataFrame, tie: str = "event_id", course: str | None = None) -> DataFrame:
    """Previous place, hours since (null unless positive), km, knots, acceleration and, with a course, its change and rate."""
    w = track(tie)
    prev = lambda c: F.lag(c).over(w)
    hours = (micros("ts") - micros(prev("ts"))) / F.lit(3.6e9)
    both = _neighboured(rows, ["latitude", "longitude", "speed", *([course] if course else [])], tie)
    own = both.select(
        "*", F.when(hours > 0, hours).alias("delta_h"),
        haversine_km(prev("latitude"), prev("longitude"), F.col("latitude"), F.col("longitude")).alias("step_km"),
        (F.col("speed") - prev("speed")).alias("_ds"),
        *([angle_between(F.col(course), prev(course)).alias("course_change")] if course else []),
    )
    own = _settled(own, rows).withColumn(
        "speed_estimated_kn", F.try_divide(F.col("step_km"), F.col("delta_h") * 1.852),
    ).withColumn("acceleration", F.try_divide(F.col("_ds"), F.col("delta_h"))).drop("_ds")
    return own.withColumn("course_rate", F.try_divide(F.col("course_change"), F.col("delta_h"))) if course else own


def rolling(rows: DataFrame, column: str, widths: tuple[int, ...] = (3, 5, 10), tie: str = "event_id", std: bool = True) -> DataFrame:
    """Mean and standard deviation (0 for one row) of the last rows."""
    out = {}
    for n in widths:
        w = track(tie).rowsBetween(-(n - 1), 0)
        out[f"{column}_mean_{n}"] = F.avg(column).over(w)
        if std:
            out[f"{column}_std_{n}"] = F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0))
    return _settled(_neighboured(rows, [column], tie, max(widths) - 1).withColumns(out), rows)


def repaired_intervals(rows: DataFrame, tie: str = "event_id") -> DataFrame:
    """Hours to the next position; those not in (0, 6] become the vessel's median of those in (0, 2], else 1/6; kept in [1/120, 6].

    The median is of a histogram, one row a vessel and length, and reaches each range as one row more.
    """
    own = ranged(rows)
    narrow = own.select("mmsi", "_range", "ts", tie)
    after = _copies(narrow, _AFTER, 1, tie)
    raw = (micros(F.lead("ts").over(track(tie))) - micros("ts")) / F.lit(3.6e9)
    spans = narrow.withColumn("_kind", F.lit(_OWN)).unionByName(after).withColumn("_raw", raw).filter((F.col("_kind") == _OWN) & (F.col("_raw") > 0) & (F.col("_raw") <= 2))
    lengths = spans.groupBy("mmsi", "_raw").agg(F.count("*").alias("_n"))
    usual = lengths.groupBy(F.col("mmsi").alias("_vessel")).agg(F.percentile("_raw", 0.5, F.col("_n")).alias("_usual"))
    told = narrow.select("mmsi", "_range").distinct().join(usual, F.col("mmsi").eqNullSafe(F.col("_vessel"))).select("mmsi", "_range", "_usual", F.lit(_BEFORE).alias("_kind"))
    both = own.withColumn("_kind", F.lit(_OWN)).unionByName(after, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    both = both.withColumn("duration_h_raw", raw).withColumn("_usual", F.max("_usual").over(Window.partitionBy("mmsi", "_range")))
    kept = F.when((F.col("duration_h_raw") > 0) & (F.col("duration_h_raw") <= 6), F.col("duration_h_raw"))
    timed = both.withColumn("duration_h", F.least(F.lit(6.0), F.greatest(F.lit(1 / 120), F.coalesce(kept, "_usual", F.lit(1 / 6))))).drop("_usual")
    return _settled(timed, rows).withColumn("ais_gap_flag", F.col("duration_h") > 0.5)


def suspicious_jumps(
    rows: DataFrame, tie: str = "event_id", max_minutes: float = 30, km: float = 20, knots: float = 40, least_km: float = 5,
    mmsi: object = None, start: str | None = None, end: str | None = None, port: tuple[str, ...] = (),
) -> DataFrame:
    """Steps of up to max_minutes that are long, or fast and not short; distances on a plane. All such steps are returned.

    Columns are added: previous place, minutes, jump_km, implied_kn, rule (distance_threshold where the step is long, else
    speed_threshold) and port, the first of the columns in `port` that says something. Rows without vessel, time or place
    are no steps; mmsi and whole days from start to end narrow the rows first.
    """
    rows = rows.filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = rows if mmsi is None else rows.filter(F.col("mmsi") == F.lit(mmsi))
    rows = rows if start is None else rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    rows = rows if end is None else rows.filter(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    rows = rows.withColumn("port", first_present(*[F.col(c) for c in port]) if port else F.lit(None).cast("string"))
    w, given = track(tie), rows
    rows = _neighboured(rows, ["latitude", "longitude"], tie).withColumns({"prev_latitude": F.lag("latitude").over(w), "prev_longitude": F.lag("longitude").over(w)})
    minutes = (micros("ts") - micros(F.lag("ts").over(w))) / F.lit(60e6)
    own = rows.select(
        "*", minutes.alias("minutes"),
        planar_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")).alias("jump_km"),
    )
    own = _settled(own, given).withColumn("implied_kn", F.try_divide(F.col("jump_km"), F.col("minutes") / 60.0) / 1.852)
    far, fast = F.col("jump_km") >= km, (F.col("jump_km") >= least_km) & (F.col("implied_kn") >= knots)
    return own.filter(
        (F.col("minutes") > 0) & (F.col("minutes") <= max_minutes) & (far | fast)
    ).withColumn("rule", F.when(far, "distance_threshold").otherwise("speed_threshold"))


def position_jumps(rows: DataFrame, tie: str = "event_id", minutes: float = 30, km: float = 80) -> DataFrame:
    """jump_flag: 80 km or more within 30 minutes."""
    own = lagged(rows, tie)
    return own.withColumn("jump_flag", F.coalesce((F.col("delta_h") * 60 <= minutes) & (F.col("step_km") >= km), F.lit(False)))


def as_of(
    left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], last: list[str],
    keep_null: bool = True,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time: one exchange, one sort, no fan-out.

    Rows are dealt by key and range; a range begins with the last right row of the ranges before it, so a key's history is
    no one task's. last: columns whose largest values win where right rows share key and time. Left rows with a null key or
    time get no match, and take no part in the exchange; keep_null=False leaves them out. The right rows' values come as
    columns `values`, null without a match.
    """
    deduped = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull()).groupBy(by, F.col(right_time).alias("_t")).agg(
        F.max_by(F.struct(*values), F.struct(*last)).alias("_right")
    )
    deduped = deduped.withColumn("_range", _range_of(deduped, "_t"))
    whole = F.col(by).isNotNull() & F.col(left_time).isNotNull()
    given = "_range" in left.columns
    rest = [c for c in left.columns if c not in (by, "_range")]
    own = left.filter(whole).select(
        F.col(by), F.col("_range") if given else _range_of(left, left_time).alias("_range"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_left"),
    )
    ends = deduped.groupBy(by, "_range").agg(F.max_by("_right", "_t").alias("_right"), F.lit(False).alias("_asks"))
    asked = own.groupBy(by, "_range").agg(F.lit(True).alias("_asks"))
    each = ends.unionByName(asked, allowMissingColumns=True).groupBy(by, "_range").agg(F.first("_right", ignorenulls=True).alias("_right"), F.bool_or("_asks").alias("_asks"))
    so_far = F.last("_right", ignorenulls=True).over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = each.withColumn("_right", so_far).filter("_asks and _right is not null").select(by, "_range", "_right")
    both = own.unionByName(deduped.select(by, "_range", "_t", F.lit(0).alias("_side"), "_right"), allowMissingColumns=True)
    both = both.unionByName(carried.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by, "_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_match", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    found = found.select(F.col(by), "_range", "_left.*", *[F.col("_match")[v].alias(v) for v in values]).select(*left.columns, *values)
    if not keep_null:
        return found
    kinds = {f.name: f.dataType for f in right.schema}
    return found.unionByName(left.filter(~whole).select("*", *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))


def attach_visits(positions: DataFrame, visits: DataFrame, keep_null: bool = True) -> DataFrame:
    """Latest visit begun at or before each position; cleared where the position is past its departure."""
    own = as_of(
        positions, visits, "mmsi", "ts", "arrival_time", ["call_id", "port_key", "arrival_time", "departure_time"],
        ["departure_time", "call_id"], keep_null,
    )
    inside = F.col("ts") <= F.col("departure_time")
    cleared = {c: F.when(inside, F.col(c)) for c in ("call_id", "port_key", "arrival_time", "departure_time")}
    return own.withColumn("inside_call", F.coalesce(inside, F.lit(False))).withColumns(cleared)


def segments(rows: DataFrame, tie: str = "event_id", call: str | None = None) -> DataFrame:
    """segment_ord and segment_id: a new one at a change of mode or call, or after an interval of more than half an hour.

    Segments are counted within ranges, and a range begins with the count of those before it. rows are written once, as
    what the last row of a range says follows from all the steps before.
    """
    own = written(ranged(rows), "track")
    w = track(tie)
    prev = lambda c: F.lag(c).over(w)
    changed = prev("mode").isNull() | (F.col("mode") != prev("mode")) | (F.coalesce(prev("duration_h"), F.lit(0.0)) > 0.5)
    if call:
        changed = changed | (F.coalesce(F.col(call), F.lit("")) != F.coalesce(prev(call), F.lit("")))
    both = _neighboured(own, ["mode", "duration_h", *([call] if call else [])], tie)
    flagged = both.withColumn("new_segment", changed.cast("long")).filter(F.col("_kind") == _OWN)
    counts = flagged.groupBy("mmsi", "_range").agg(F.sum("new_segment").alias("new_segment"))
    earlier = F.sum("new_segment").over(Window.partitionBy("mmsi").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("mmsi", "_range", F.coalesce(earlier, F.lit(0)).alias("new_segment"), F.lit(_BEFORE).alias("_kind"))
    numbered = flagged.unionByName(starts, allowMissingColumns=True)
    numbered = numbered.withColumn("segment_ord", F.sum("new_segment").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = _settled(numbered, rows).withColumn("new_segment", F.col("new_segment").cast("int"))
    return numbered.withColumn("segment_id", F.concat(F.col("mmsi").cast("string"), F.lit("_seg_"), F.lpad(F.col("segment_ord").cast("string"), 6, "0")))


def recent_points(rows: DataFrame, mmsi: object, n: int = 10, tie: str = "event_id", start: str | None = None, end: str | None = None) -> DataFrame:
    """A vessel's last n rows, of whole days from start to end."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = rows if start is None else rows.filter(day >= F.lit(start))
    rows = rows if end is None else rows.filter(day <= F.lit(end))
    return rows.filter(F.col("mmsi") == F.lit(mmsi)).orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def even_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """At most n rows at even steps of the order, the first and last among them."""
    total = rows.count()
    if total <= n:
        return rows
    ranked = with_rank(rows, order)
    # row r is taken if some k has floor(k * (total - 1) / (n - 1)) = r
    step = F.lit(float(total - 1)) / (n - 1)
    k = F.ceil(F.col("_rank") / step)
    return ranked.filter((F.floor(k * step) == F.col("_rank")) & (k < n)).drop("_rank")


def with_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """_rank (from 0) in a total order: rows are ranged into partitions, ranked within, and offset by what stands before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    sizes = ranged.groupBy("_part").count().collect()  # one row a partition
    offsets, total = {}, 0
    for part, k in sorted((r["_part"], r["count"]) for r in sizes):
        offsets[part] = total
        total += k
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return ranged.withColumn("_rank", F.element_at(table, F.col("_part")) + F.col("_at")).drop("_id", "_part", "_at")


def time_split(rows: DataFrame, order: list[str], test: float = 0.2) -> DataFrame:
    """is_test: the last share of rows in time."""
    total = rows.count()
    return with_rank(rows, order).withColumn("is_test", F.col("_rank") >= F.lit(int(total * (1 - test)))).drop("_rank")
