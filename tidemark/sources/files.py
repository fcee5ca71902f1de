"""Readers and writers: raw CSV with schema votes, Parquet marts, JSON lines, factor documents, binary files."""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Column names of the two raw feeds.
POSITION_COLUMNS = (
    "MMSI", "IMO", "Name", "Callsign", "Flag", "VesselType", "Latitude", "Longitude", "Speed", "Course", "Heading", "Draught",
    "NavStatus", "Destination", "TimePosition", "TimeETA",
)
VISIT_COLUMNS = (
    "portID", "portName", "portLocode", "portArrival", "portDeparture", "vesselMMSI", "vesselIMO", "vesselName", "vesselType",
    "vesselDestinationArrival", "vesselDestinationDeparture",
)
# End of the fixed values.

LEAST_POSITION, LEAST_VISIT = 8, 6


def kind_of(columns: list[str]) -> str | None:
    """positions, visits or None, by how many known names a header has."""
    have = set(columns)
    if len(have & set(POSITION_COLUMNS)) >= LEAST_POSITION:
        return "positions"
    return "visits" if len(have & set(VISIT_COLUMNS)) >= LEAST_VISIT else None


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All columns as text, named by the header; nothing is inferred."""
    headers = _headers(spark, path)
    if not headers:
        return spark.createDataFrame([], StructType([]))
    rows = None
    for header, files in headers.items():
        schema = StructType([StructField(n, StringType()) for n in next(csv.reader([header], skipinitialspace=True))])
        own = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", False).csv(files)
        own = own.withColumnsRenamed({c: c.strip() for c in own.columns})
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows if limit is None else rows.limit(limit)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path by their first line, which a parser then reads: a folder's files may differ in their columns."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    parts = lines.filter("file_block_start = 0").withColumn("id", F.monotonically_increasing_id())
    # a file's first line is the first of its first part: one job for all files, and a row a file comes back
    first = parts.groupBy("file_path").agg(F.min_by("value", "id").alias("header")).collect()
    out: dict[str, list[str]] = {}
    for name, header in sorted(tuple(r) for r in first):
        if header.strip():
            out.setdefault(header.lstrip("\ufeff"), []).append(name)
    return out


def with_columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing columns are added as null text."""
    return rows.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in rows.columns])


def read_feeds(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Raw feeds by kind; files of neither kind are left out."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        rows = read_csv(spark, path)
        kind = kind_of(rows.columns)
        if kind is None:
            continue
        rows = with_columns(
            rows, POSITION_COLUMNS if kind == "positions" else VISIT_COLUMNS,
        ).withColumn("source_file", F.lit(path.rsplit("/", 1)[-1]))
        out[kind] = out[kind].unionByName(rows, allowMissingColumns=True) if kind in out else rows
    return out


def read_mart(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet mart, or no rows where the folder isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_mart(rows: DataFrame, path: str, *partitions: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> int:
    """JSON lines and their number, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_json_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_document(spark: SparkSession, path: str) -> tuple[dict, str]:
    """A JSON document and the SHA-256 of its text, through Spark's file systems."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return json.loads(raw), hashlib.sha256(raw).hexdigest()


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document of settings; YAML needs its library on the driver."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if path.lower().endswith(".json"):
        return json.loads(raw)
    try:
        import yaml
    except ImportError as missing:
        raise ValueError("YAML can't be read here; give the settings as JSON") from missing
    return yaml.safe_load(raw) or {}


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of files, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", "modificationTime").orderBy("path")


def page_chunks(pages: DataFrame, key: str, size: int = 1200, overlap: int = 200, html: str = "html", status: str | None = None) -> DataFrame:
    """(key, url, chunk_no, chunk) of pages' visible text. With a status column only pages of status 200 count: a page that
    couldn't be fetched is left out, as one without text is."""
    from ..functions.text import fixed_chunks, html_text

    own = pages if status is None else pages.filter(F.col(status) == 200)
    return own.filter(F.col(html).isNotNull()).select(key, "url", F.inline(fixed_chunks(html_text(F.col(html)), size, overlap)))


def plain_text_chunks(spark: SparkSession, folder: str, pattern: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Overlapping chunks of text files, numbered."""
    from ..functions.text import fixed_chunks

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.col("content").cast("string").alias("text"),
    )
    return found.select("path", F.inline(fixed_chunks(F.regexp_replace("text", r"\s+", " "), size, overlap)))


def page_text_chunks(
    spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]], pattern: str = "*.pdf", size: int = 1200,
    overlap: int = 200,
) -> DataFrame:
    """(path, page from 1, chunk_no, chunk) of documents with pages. pages: a file's bytes -> the texts of its pages, such as a
    PDF library gives them; a file that it can't read is left out. Each file is read by one task."""
    from ..functions.text import fixed_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = pages(content.as_py())
                except Exception:  # whatever a parser makes of a broken file
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int32()),
                        pa.array(found, pa.string()),
                    ],
                    names=["path", "page", "text"],
                )

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInArrow(
        run, "path string, page int, text string",
    )
    return found.select("path", "page", F.inline(fixed_chunks(F.trim(F.regexp_replace("text", r"\s+", " ")), size, overlap)))


def profile_document(tables: dict[str, tuple[DataFrame, str | None]], samples: int = 5) -> dict:
    """For each table (rows, time column or None): its columns, first rows as text, number of rows and coverage."""
    out = {}
    for name, (rows, time) in tables.items():
        span = [F.min(time).cast("string").alias("first"), F.max(time).cast("string").alias("last")] if time else []
        seen = rows.agg(F.count("*").alias("rows"), *span).first().asDict()
        few = rows.limit(samples).select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]).collect()
        out[name] = {"columns": rows.columns, "samples": [r.asDict() for r in few], **seen}
    return out


def profile(rows: DataFrame, time: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    """One row: number of rows, coverage, distinct values."""
    return rows.agg(
        F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct],
    )


def export(rows: DataFrame, folder: str, stamp: str, fallback: str | None = None) -> tuple[str | None, str | None]:
    """A small result as one CSV and one JSON file; their folders. Where the folder can't be written, those of the fallback;
    where neither can, (None, None)."""
    for base in (folder, fallback):
        if base is None:
            continue
        table, document = f"{base}/{stamp}-csv", f"{base}/{stamp}-json"
        try:
            rows.coalesce(1).write.mode("overwrite").option("header", True).csv(table)
            rows.coalesce(1).write.mode("overwrite").json(document)
        except (Py4JJavaError, PySparkException):
            continue
        return table, document
    return None, None


def positions_from_raw(raw: DataFrame) -> DataFrame:
    """Typed and checked positions from the raw feed."""
    from ..functions import clean

    col = F.col
    own = raw.select(
        clean.identifier(col("MMSI")).alias("mmsi"), clean.identifier(col("IMO")).alias("imo"), clean.timestamp(col("TimePosition")).alias("ts"), clean.timestamp(col("TimeETA")).alias("eta"),
        clean.number(col("Latitude")).alias("latitude"), clean.number(col("Longitude")).alias("longitude"), clean.number(col("Speed")).alias("speed"), clean.number(col("Course")).alias("course"),
        clean.number(col("Heading")).alias("heading"), clean.number(col("Draught")).alias("draught"), clean.vessel_type(col("VesselType")).alias("vessel_type_norm"),
        clean.text_or(col("Name"), "unknown").alias("name"), clean.text_or(col("NavStatus"), "unknown").alias("nav_status"), clean.destination(col("Destination")).alias("destination_norm"), *_source(raw),
    )
    return own.filter(valid_position())


def visits_from_raw(raw: DataFrame) -> DataFrame:
    """Typed visits from the raw feed."""
    from ..functions import clean

    code, name = clean.locode(F.col("portLocode")), clean.text_or(F.col("portName"), "unknown")
    own = raw.select(
        clean.identifier(F.col("vesselMMSI")).alias("mmsi"), code.alias("locode_norm"), F.lower(name).alias("port_name_norm"), clean.port_key(code, name).alias("port_key"), clean.port_label(code, name).alias("port_label"),
        clean.timestamp(F.col("portArrival")).alias("arrival_time"), clean.timestamp(F.col("portDeparture")).alias("departure_time"), clean.vessel_type(F.col("vesselType")).alias("vessel_type_norm"), *_source(raw),
    )
    own = own.filter(F.col("mmsi").isNotNull() & (F.col("mmsi") != "") & F.col("arrival_time").isNotNull())
    return own.withColumn("call_id", clean.call_id(F.col("mmsi"), F.col("arrival_time"), F.col("port_key")))


def _source(raw: DataFrame) -> list[Column]:
    return [F.col("source_file")] if "source_file" in raw.columns else []


def valid_position() -> Column:
    """A vessel, a time and a place on the globe."""
    return F.col("mmsi").isNotNull() & ~F.lower("mmsi").isin("", "unknown", "nan", "none") & F.col("ts").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
