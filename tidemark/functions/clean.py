"""Cleaning of identifiers, codes, texts, numbers and times as Column functions; no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_MISSING = ("NAN", "NONE", "NAT")
#: Fixed value: a location code as people type it, two letters of the country and three of the place.
CODE_SHAPE = r"[A-Za-z]{2}\s?[A-Za-z]{3}"
#: Classes of vessel types, looked up first as a whole, then as the first that the type contains.
VESSEL_CLASSES = {
    "tanker": "tanker", "oil tanker": "tanker", "chemical tanker": "tanker", "gas tanker": "tanker",
    "cargo ship": "cargo", "general cargo": "cargo", "bulk carrier": "cargo",
    "container ship": "container", "container": "container", "ro-ro cargo": "cargo",
    "passenger": "passenger", "passenger ship": "passenger",
    "tug": "service", "pilot": "service", "service": "service", "fishing": "service",
    "other": "unknown", "unknown": "unknown",
}


#: Forms of times beside those that a cast reads.
FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d, yyyy HH:mm", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd'T'HHmmss", "yyyyMMdd",
)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def destination(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper case, punctuation to spaces, aliases, then `AA BBB` or `AABBB` to a code; UNKNOWN where nothing is left."""
    raw = F.upper(F.trim(value.cast("string")))
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, "[^A-Z0-9 ]+", " "), r"\s+", " "))
    tight = F.replace(text, F.lit(" "), F.lit(""))
    coded = F.when(text.rlike(r"^[A-Z]{2}\s?[A-Z]{3}$"), tight).otherwise(text)
    if aliases:
        coded = F.coalesce(F.try_element_at(_map(aliases), text), F.try_element_at(_map(aliases), tight), coded)
    return F.when(raw.isNull() | raw.isin("", "NAN", "NONE") | (text == ""), "UNKNOWN").otherwise(coded)


def destination_plain(value: Column) -> Column:
    """Upper case with single spaces; no aliases."""
    return F.upper(F.regexp_replace(F.trim(value), r"\s+", " "))


def identifier(value: Column) -> Column:
    """Trimmed, `.0` behind digits dropped; null stays null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d+\.0+$"), F.substring_index(text, ".", 1)).otherwise(text)


def locode(value: Column) -> Column:
    """Upper case without spaces; empty for a missing value."""
    text = F.replace(F.upper(F.trim(value.cast("string"))), F.lit(" "), F.lit(""))
    return F.when(text.isNull() | text.isin(*_MISSING), "").otherwise(text)


def text_or(value: Column, fallback: str) -> Column:
    """Trimmed text, or the fallback where it is missing."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == "") | F.upper(text).isin(*_MISSING), fallback).otherwise(text)


def vessel_type(value: Column) -> Column:
    return F.lower(text_or(value, "unknown"))


def vessel_class(kind: Column) -> Column:
    """Exact class of a vessel type, else that of the first known type within it, else unknown."""
    key = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    inside = reduce(lambda chain, pair: chain.when(key.contains(pair[0]), pair[1]), VESSEL_CLASSES.items(), F.when(F.lit(False), ""))
    return F.coalesce(F.try_element_at(_map(VESSEL_CLASSES), key), inside, F.lit("unknown"))


def number(value: Column) -> Column:
    """Double, or null where it isn't a finite number."""
    found = value.try_cast("double")
    return F.when(~F.isnan(found) & (F.abs(found) != float("inf")), found)


def number_comma(value: Column) -> Column:
    """Double, a decimal comma allowed."""
    return F.coalesce(number(value), number(F.replace(value, F.lit(","), F.lit("."))))


def timestamp(value: Column) -> Column:
    """UTC timestamp of a time's text, or null: ISO-8601, then the other forms in FORMS, day before month."""
    text = F.trim(value)
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(form)) for form in FORMS])


def date_text(value: Column) -> Column:
    """YYYY-MM-DD of a time's text; its first ten characters where they look like a date."""
    head = F.left(value, F.lit(10))
    return F.coalesce(F.date_format(timestamp(value), "yyyy-MM-dd"), F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head))


def country(code: Column) -> Column:
    """The first two letters of a location code, UNK for a shorter one."""
    return F.when(F.char_length(code) >= 2, F.upper(F.left(code, F.lit(2)))).otherwise("UNK")


def first_present(*values: Column) -> Column:
    """The first value that isn't missing or empty."""
    return F.coalesce(*[F.when(~F.upper(F.trim(v.cast("string"))).isin("", *_MISSING), v) for v in values])


def code_of_destination(value: Column) -> Column:
    """A destination that is five letters, else empty."""
    return F.regexp_extract(value, "^([A-Z]{5})$", 1)


def port_key(code: Column, name: Column) -> Column:
    """The code, or the name in upper snake case."""
    snake = F.regexp_replace(F.upper(F.trim(name)), r"\s+", "_")
    return F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(snake)


def port_label(code: Column, name: Column) -> Column:
    """`name (CODE)`, or the name alone."""
    return F.when(F.coalesce(code, F.lit("")) != "", F.format_string("%s (%s)", name, code)).otherwise(name)


def position_id(mmsi: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """vessel_time_lat_lon with five decimals."""
    return F.concat_ws("_", mmsi, F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss"), F.format_string("%.5f", lat), F.format_string("%.5f", lon))


def call_id(mmsi: Column, arrival: Column, code: Column) -> Column:
    return F.concat_ws("_", mmsi, F.date_format(arrival, "yyyy-MM-dd'T'HH-mm-ss"), code)


def id_safe(value: Column) -> Column:
    """Blanks, slashes, colons and plus signs replaced."""
    return F.translate(value, " :/+", "_-__")


def canonical_call(value: Column) -> Column:
    """Lower-case letters and digits only, for the looser match of call ids."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def eta_minutes(ts: Column, eta: Column) -> Column:
    """Minutes from a position to its ETA, null unless positive."""
    m = (F.unix_micros(eta.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(60e6)
    return F.when(m > 0, m)


def name_token(value: Column) -> Column:
    """Accents folded, blanks squeezed, lower case, a leading `port of` dropped."""
    plain = F.translate(
        F.lower(F.trim(value)), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžćčłńśźżąęāēīūļķģņőű",
        "aaaaaaceeeeiiiinoooooouuuuyyszccl" + "nszzaeaeiulkgnou",
    )
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^port of ", "")


def evidence_id(segment: Column, params_hash: Column) -> Column:
    """The first 24 hex digits of SHA-1 over segment|parameters."""
    return F.left(F.sha1(F.concat_ws("|", segment, params_hash).cast("binary")), F.lit(24))


def percent_delta(value: Column, base: Column, least: float = 1e-9) -> Column:
    return F.when(F.abs(base) >= least, (value - base) / base * 100.0)
