"""Rows as sentences with flat metadata, for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import call_id, country, destination, id_safe, position_id


def _number(c: str) -> Column:
    """A missing number is -1 in metadata."""
    return F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)


#: Columns of records' metadata beside vessel, place, port and time: texts, numbers.
TEXTS = ("imo", "name", "callsign", "flag", "vessel_type", "nav_status", "destination", "source_position", "source_file")
NUMBERS = ("speed", "course", "heading", "draught")


def _whole(rows: DataFrame, *more: str) -> DataFrame:
    """rows with those columns that they lack, missing."""
    wanted = {c: "double" for c in NUMBERS} | {c: "string" for c in (*TEXTS, *more)}
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in rows.columns})


def _norm(c: str, change: Column, missing: str = "unknown") -> Column:
    return F.coalesce(F.when(F.col(c).cast("string") != "unknown", change), F.lit(missing)).alias(f"{c}_norm")


def _shared(rows: DataFrame, excerpt: Column) -> list[Column]:
    """Metadata that positions and visits have alike."""
    lower = lambda c: _norm(c, F.lower(F.trim(F.col(c).cast("string"))))
    spoken = F.col("destination_norm") if "destination_norm" in rows.columns else destination(F.col("destination"))
    return [
        *[_text(c) for c in TEXTS], _norm("flag", F.upper(F.trim(F.col("flag"))), "UNKNOWN"), *([_text("vessel_type_norm")] if "vessel_type_norm" in rows.columns else [lower("vessel_type")]),
        lower("nav_status"), F.coalesce(spoken, F.lit("UNKNOWN")).alias("destination_norm"), F.left(excerpt, F.lit(420)).alias("serialized_excerpt"),
    ]


def position_records(rows: DataFrame) -> DataFrame:
    """(id, text, metadata) of positions; rows without vessel, time or place drop out; a missing text is `unknown`, a missing
    number -1, and a position has no port."""
    own = _whole(rows).filter(F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    vessel = F.col("mmsi").cast("string")
    text = F.format_string(
        "Vessel %s at %s was at %.5f, %.5f moving at %.1f knots.", vessel, F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.col("latitude"), F.col("longitude"), F.coalesce(F.col("speed").cast("double"), F.lit(-1.0)),
    )
    none = [F.lit("unknown").alias(c) for c in ("port_name", "port_name_norm", "locode", "locode_norm")]
    metadata = F.struct(
        F.lit("position").alias("event_kind"), vessel.alias("mmsi"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_full"),
        F.col("latitude"), F.col("longitude"), *map(_number, NUMBERS), *_shared(own, text), *none, F.lit("UNK").alias("country_prefix"),
    )
    return own.select(
        id_safe(position_id(vessel, F.col("ts"), F.col("latitude"), F.col("longitude"))).alias("id"), text.alias("text"),
        metadata.alias("metadata"),
    )


def visit_records(rows: DataFrame) -> DataFrame:
    """(id, text, metadata) of visits; rows without vessel or arrival drop out; a visit has no place, speed or course."""
    own = _whole(
        rows, "locode_norm", "port_name", "destination_arrival", "destination_departure",
    ).filter(F.col("mmsi").isNotNull() & F.col("arrival_time").isNotNull())
    vessel = F.col("mmsi").cast("string")
    own = own.withColumn("destination", F.coalesce("destination_departure", "destination_arrival", "destination"))
    left = F.coalesce(F.date_format("departure_time", "yyyy-MM-dd HH:mm"), F.lit("unknown"))
    text = F.format_string(
        "Vessel %s called at %s, arriving %s and departing %s.", vessel, F.col("port_key"),
        F.date_format("arrival_time", "yyyy-MM-dd HH:mm"), left,
    )
    time = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    name = F.coalesce("port_name", "port_key")
    metadata = F.struct(
        F.lit("visit").alias("event_kind"), vessel.alias("mmsi"), F.date_format("arrival_time", "yyyy-MM-dd").alias("date"), time("arrival_time").alias("timestamp_full"), time("arrival_time").alias("arrival_full"), time("departure_time").alias("departure_full"),
        name.alias("port_name"), F.lower(name).alias("port_name_norm"), _text("locode_norm"), country(F.coalesce("locode_norm", F.lit(""))).alias("country_prefix"), _text("destination_arrival"), _text("destination_departure"),
        *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude", *NUMBERS)], *_shared(own, text),
    )
    return own.select(id_safe(call_id(vessel, F.col("arrival_time"), F.col("port_key"))).alias("id"), text.alias("text"), metadata.alias("metadata"))


def records(raw: DataFrame) -> DataFrame | None:
    """(id, text, metadata as JSON) of a raw feed, by what its columns say it is: decided once a feed, not once a row, and in
    any case of letters; None where it is neither."""
    from ..sources import files

    names = {c.lower() for c in raw.columns}
    spelled = {c.lower(): c for c in (*files.POSITION_COLUMNS, *files.VISIT_COLUMNS)}
    own = raw.withColumnsRenamed({c: spelled[c.lower()] for c in raw.columns if c.lower() in spelled})
    if names & {"timeposition", "latitude", "longitude"}:
        found = position_records(files.positions_from_raw(files.with_columns(own, files.POSITION_COLUMNS)))
    elif names & {"portarrival", "portdeparture", "portlocode"}:
        found = visit_records(files.visits_from_raw(files.with_columns(own, files.VISIT_COLUMNS)))
    else:
        return None
    return found.withColumn("metadata", F.to_json("metadata"))


def evidence_line(records: DataFrame) -> DataFrame:
    """id and one short line of evidence."""
    m = F.col("metadata")
    return records.select(
        "id",
        F.concat_ws(
            " | ", m["event_kind"], m["date"], F.concat(F.lit("mmsi "), m["mmsi"]), F.left("text", F.lit(80)),
        ).alias("line"),
    )
