"""Mixing sources to target weights by systematic sampling.

Targets: sources in order of code points (null last) weigh 3, 1, 2, repeating, and share SHARE of all sizes by weight; no
target exceeds MOST times its source's size, and what is over goes to the others by weight until none is above.

Sampling: within a source each document is expected target / source size times. Documents stand in order of size
class, then of a hash, then of the id; expected copies are prefix-summed in that order, one offset is added, and a
document is emitted once for each integer crossed. So a document comes floor or ceil of its expected copies times,
whatever the offset, and its expected copies are exactly the rate. The offset is one draw from [0, 1) for each source,
seeded by the source's name, so that reruns agree. As sizes rise along the order but for STEPS classes to a factor of
e, rounding errors of neighbours cancel: a source's words differ from its target by a few of its largest documents at
most, however many documents it has.

Prefix sums at scale: the place of a document in its source is the number of documents in earlier (class, bucket)
groups, which is summed over groups in two levels, plus its place within its own group. Buckets are hashes of the id (of the row's
number where that is null), and their number follows the number of rows, so no group of equal sizes is large, whatever its
source, unless one id is that of many rows. Sources are numbered
within ranges of names, and the water level is found by sums over sources, so no task holds all sources.

Defined results: a null text has size 0; null sources form one source, which comes last; a source of size 0 has
target 0 and its documents come 0 times; each row is taken by itself, so an id may occur in several sources, or be
null; rows that repeat wholly may take each other's places, but as many are emitted; other columns stay and are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free, written

WEIGHTS, SHARE, MOST, STEPS, GROUP_ROWS, SPAN = (3, 1, 2), 1.5, 2.0, 16, 4096, 1024
#: Sources up to this number are broadcast to the rows; more are joined by a shuffle, which Spark can split.
BROADCAST_SOURCES = 20_000


def _numbered(each: DataFrame) -> DataFrame:
    """each with _n, from 0, in order of source (null last): places within ranges of names, and one count a range."""
    last, part = F.col("source").isNull(), F.col("_part")
    ranged = written(each.orderBy(last, "source").withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_part").count().collect()):
        starts += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    if not starts:
        return ranged.withColumn("_n", F.lit(0)).drop("_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(last, "source")) - 1
    return ranged.withColumn("_n", place + F.element_at(F.create_map(*starts), part)).drop("_part")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target) from rows with source and size; one row a source."""
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = written(
        _numbered(each).select(
            "source", "source_size", "n", F.element_at(weights, (F.col("_n") % len(WEIGHTS) + 1).cast("int")).alias("weight"),
        ),
        "mix-weights",
    )
    most = F.lit(MOST) * F.col("source_size")
    sums = weighed.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    level, full = SHARE * (sums["all"] or 0) / (sums["weight"] or 1.0), 0
    while level is not None:  # the level rises as sources get full, so each is found full once
        over = most < F.lit(level) * F.col("weight")
        found = weighed.agg(
            F.count_if(over).alias("full"), F.sum(F.when(over, most)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if found["full"] == full:
            break
        full = found["full"]
        level = (SHARE * sums["all"] - found["held"]) / found["weight"] if found["weight"] else None
    target = most if level is None else F.least(most, F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "n", F.round(target, 6).alias("target"))


def _hash(text: Column) -> Column:
    """28 bits of md5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    keyed = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(keyed) if n_sources <= BROADCAST_SOURCES else keyed, rows["source"].eqNullSafe(keyed["_source"])).drop("_source")


def _starts(counts: DataFrame) -> DataFrame:
    """(source, _class, _bucket, _start): rows before each group in its source; counts: _rows of each group.

    Two levels: SPAN buckets of a class are one span. Spans are summed over a source, groups within their span, so a
    source that holds most rows has one row per span in a window, not one per group.
    """
    wide = counts.withColumn("_span", F.floor(F.col("_bucket") / SPAN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = wide.groupBy("source", "_class", "_span").agg(F.sum("_rows").alias("_rows"))
    over_source = before(Window.partitionBy("source").orderBy("_class", "_span"))
    over_span = before(Window.partitionBy("source", "_class", "_span").orderBy("_bucket"))
    spans = spans.select(
        F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_span").alias("_p"),
        F.coalesce(F.sum("_rows").over(over_source), F.lit(0)).alias("_before"),
    )
    wide = wide.withColumn("_within", F.coalesce(F.sum("_rows").over(over_span), F.lit(0)))
    joined = wide.join(spans, wide["source"].eqNullSafe(spans["_s"]) & (wide["_class"] == spans["_c"]) & (wide["_span"] == spans["_p"]))
    return joined.select("source", "_class", "_bucket", (F.col("_before") + F.col("_within")).alias("_start"))


def copies(sized: DataFrame, id_col: str = "doc_id", ties: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """Rows of sized (id_col, source, size and others) with source_size, target and copies, which replace columns of these names.

    ties: columns that order rows of one id and size; row: a column that numbers rows, which stands in for null ids, so that
    these are in many buckets. sized should be a written table: it is read three times.
    """
    sized = sized.drop("source_size", "target", "copies")
    sources = written(targets(sized), "mix-sources")
    found = sources.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    buckets = max(1, -(-(found["n"] or 0) // GROUP_ROWS))
    rows = sized.withColumn(
        "_class", F.floor(F.log(F.col("size") + 1) * STEPS),
    ).withColumn("_hash", _hash(F.coalesce(F.col(id_col).cast("string"), *([F.concat(F.lit("row "), row)] if row else [])))).withColumn("_bucket", F.col("_hash") % buckets)
    group = ["source", "_class", "_bucket"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("_rows"))
    starts = _starts(counts)
    inside = Window.partitionBy(*group).orderBy("_hash", id_col, "size", *ties)
    placed = rows.withColumn("_place", F.row_number().over(inside))
    right = starts.select(*[F.col(c).alias(f"{c}_g") for c in group], "_start")
    joined = placed.join(
        right,
        placed["source"].eqNullSafe(right["source_g"]) & (placed["_class"] == right["_class_g"]) & (
            placed["_bucket"] == right["_bucket_g"]
        ),
    )
    joined = _with_sources(joined, sources.drop("n"), found["k"] or 0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << 28))
    at = joined.select(*sized.columns, "source_size", "target", (F.col("_start") + F.col("_place")).alias("_rank"), rate.alias("_rate"))
    crossed = F.floor(F.col("_rank") * F.col("_rate") + offset) - F.floor((F.col("_rank") - 1) * F.col("_rate") + offset)
    return at.withColumn("copies", crossed.cast("long")).drop("_rank", "_rate")


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """Columns, source and size of documents; size: number of [^\\x20\\x09-\\x0D]+ in the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_CLASS)), F.lit(0)).cast("long")
    return docs.select(*columns, "source", size.alias("size"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    own = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    mixed_rows = copies(written(sized(own, "doc_id", "row"), "mix-sizes"), ties=("row",), row="row")
    return mixed_rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Documents, each row as often as the mix takes it. Only numbers of rows, ids, sources and sizes are shuffled by the
    sampling; rows are numbered in a written table, so each has its own copies, whatever ids and sources it shares, and
    whatever other columns are named."""
    number, once = free(docs, "mix_row", "mix_copy")
    own = written(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    rows = own.select("doc_id", "source", "text", F.col(number).alias("row"), F.xxhash64("text").alias("tie"))
    chosen = copies(written(sized(rows, "doc_id", "row", "tie"), "mix-sizes"), ties=("tie", "row"), row="row").filter("copies > 0")
    times = own.join(chosen.select(F.col("row").alias(number), F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(once)), number)
    return times.withColumn(once, F.explode(once)).select(*docs.columns)
