"""Helpers shared by the training-data operators: reading tables, folds, shared folders, Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, discard, mark, release, shared_dir, written

__all__ = ["SPACE_CLASS", "delete", "discard", "fold", "fold_col", "free", "lower_words", "mark", "read", "release", "shared_dir", "text_slices", "written"]

#: Code points that separate words in the contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"
#: Rows and text bytes that one slice of an Arrow batch may hold, so a Python worker's memory stays bounded.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of one's own, as near to those wanted as df's columns allow (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_col(doc_id: Column, modulus: int) -> Column:
    """The same as a column expression."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of at most SLICE_ROWS rows and about SLICE_BYTES, with their texts (null: empty)."""
    for batch in batches:
        start, n = 0, batch.num_rows
        while start < n:
            take = min(SLICE_ROWS, n - start)
            part = batch.slice(start, take)
            while take > 1 and part.column(column).get_total_buffer_size() and _bytes(part.column(column)) > SLICE_BYTES:
                take = max(1, take // 2)
                part = batch.slice(start, take)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start += take


def _bytes(values: pa.Array) -> int:
    import pyarrow.compute as pc

    return pc.sum(pc.binary_length(values)).as_py() or 0


def lower_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text after lower-casing A-Z, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()
