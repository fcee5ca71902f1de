"""Rows clustered along a space-filling curve of place and time, so that boxes and dates read few files.

The curve (Hilbert's) runs through latitude, longitude and time, each scaled to what the table holds. Files are
ranges of the curve of about equal size, and a table of their bounds says which files a box can meet; within those, Parquet's
own statistics and the whole condition decide. Results are those of the plain filter.

Defined results: rows without a place or time are kept, and found by no box or date that needs it; a table without rows gives
an index without files. Rows that share a point of the curve are split over files by a hash, so a crowded place is no one
task's. The driver holds three spans, and the paths of the files that a search reads.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16


def curve(columns: list[Column], spans: list[tuple[float, float]]) -> Column:
    """The place of a point on a Hilbert curve; null where one of its numbers is.

    From the highest bit down, each coordinate turns or mirrors the lower bits of the first one; the bits are then Gray-coded
    and interleaved (Skilling 2004). Runs of the curve are compact, so files have tight bounds.
    """
    n = len(columns)
    cells = []
    for column, (low, high) in zip(columns, spans, strict=True):
        share = (column - F.lit(low)) / F.lit(high - low if high > low else 1.0)
        cells.append(F.least(F.greatest(F.floor(share * 2**BITS), F.lit(0)), F.lit(2**BITS - 1)).cast("long"))
    cells = [F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), cell) for cell in cells]
    steps = F.array(*[F.struct(F.lit(2**bit).cast("long").alias("bit"), F.lit(i).alias("i")) for bit in range(BITS - 1, 0, -1) for i in range(n)])

    def turned(x: Column, step: Column) -> Column:
        own, below = F.get(x, step["i"]), step["bit"] - 1
        hit = own.bitwiseAND(step["bit"]) != 0
        swap = x[0].bitwiseXOR(own).bitwiseAND(below)
        first = x[0].bitwiseXOR(F.when(hit, below).otherwise(swap))
        return F.array(first, *[F.when((step["i"] == k) & ~hit, x[k].bitwiseXOR(swap)).otherwise(x[k]) for k in range(1, n)])

    def coded(x: Column) -> Column:
        gray = F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [x[j] for j in range(i + 1)]) for i in range(n)])
        return F.transform(F.array(gray), lambda g: F.transform(F.array(flips(g[n - 1])), lambda f: woven(g, f))[0])[0]

    def flips(last: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(2**b) != 0, F.lit(2**b - 1)).otherwise(F.lit(0)).cast("long") for b in range(1, BITS)])

    def woven(g: Column, f: Column) -> Column:
        bits = [F.shiftleft(F.shiftright(g[i].bitwiseXOR(f), b).bitwiseAND(1), n * b + n - 1 - i) for i in range(n) for b in range(BITS)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.aggregate(steps, F.array(*cells), turned, coded)


@dataclass(frozen=True)
class Box:
    """Bounds, ends included; None: none. west > east: across the date line. Times as text or values that Spark compares."""

    south: float | None = None
    north: float | None = None
    west: float | None = None
    east: float | None = None
    start: object = None
    end: object = None


class PlaceIndex:
    """An index in a folder: rows/ and bounds/."""

    def __init__(self, spark: SparkSession, folder: str, columns: tuple[str, str, str] = ("latitude", "longitude", "ts")):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), columns

    @classmethod
    def build(cls, rows: DataFrame, folder: str, columns: tuple[str, str, str] = ("latitude", "longitude", "ts"), file_rows: int = 2_000_000) -> PlaceIndex:
        """Write rows as files of about file_rows rows along the curve, and the files' bounds."""
        own = cls(rows.sparkSession, folder, columns)
        numbers = own._numbers()
        seen = rows.agg(F.count("*"), *[f(c) for c in numbers for f in (F.min, F.max)]).first()
        spans = [(lo or 0.0, hi or 0.0) for lo, hi in zip(seen[1::2], seen[2::2], strict=True)]
        files = max(1, -(-seen[0] // file_rows))
        at, tie = curve(numbers, spans), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        dealt = rows.repartitionByRange(files, at, tie).sortWithinPartitions(at)
        dealt.write.mode("overwrite").parquet(f"{own.folder}/rows")
        written = own._rows()
        ends = [f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))]
        bounds = written.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
        bounds.groupBy("_file", "_size").agg(F.count("*").alias("rows"), *ends).write.mode("overwrite").parquet(f"{own.folder}/bounds")
        return own

    def _numbers(self) -> list[Column]:
        lat, lon, ts = self.columns
        return [F.col(lat).cast("double"), F.col(lon).cast("double"), F.unix_micros(F.col(ts).cast("timestamp")).cast("double")]

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def bounds(self) -> DataFrame:
        """One row a file: _file, rows, and low and high of each column."""
        return self.spark.read.parquet(f"{self.folder}/bounds")

    def files(self, box: Box) -> DataFrame:
        """The bounds of the files that may hold rows of a box."""
        return self.bounds().filter(self._meets(box, lambda i: F.col(f"low_{i}"), lambda i: F.col(f"high_{i}")))

    def condition(self, box: Box) -> Column:
        own = lambda i: F.col(self.columns[i])
        return self._meets(box, own, own)

    def _meets(self, box: Box, low, high) -> Column:
        parts = [F.lit(True)]
        across = box.west is not None and box.east is not None and box.west > box.east
        if across:
            parts.append((high(1) >= F.lit(box.west)) | (low(1) <= F.lit(box.east)))
        for i, least, most in ((0, box.south, box.north), (1, None if across else box.west, None if across else box.east), (2, box.start, box.end)):
            parts += [] if least is None else [high(i) >= F.lit(least)]
            parts += [] if most is None else [low(i) <= F.lit(most)]
        return reduce(lambda a, b: a & b, parts)

    def search(self, box: Box, where: dict[str, object] | None = None) -> DataFrame:
        """Rows in a box that have the given values; only files that can hold some are read."""
        paths = [r["_file"] for r in self.files(box).select("_file").toLocalIterator()]
        rows = self._rows()
        if not paths:
            return rows.filter(F.lit(False))
        # the metadata column has paths as in addresses
        rows = self.spark.read.schema(rows.schema).parquet(*[unquote(p) for p in paths])
        for name, value in (where or {}).items():
            rows = rows.filter(F.col(name) == F.lit(value))
        return rows.filter(self.condition(box))
