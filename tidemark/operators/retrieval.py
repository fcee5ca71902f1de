"""Filtered vector search, chunking strategies, evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .trajectory import with_rank

#: Queries that travel with one scan, and distances that a task holds at a time.
BLOCK, HELD = 4096, 1 << 21
EQUALITIES = ("mmsi", "imo", "locode", "destination", "port_name", "vessel_type", "nav_status", "flag")


def metadata_filter(filters: dict[str, object]) -> Column:
    """Conjunction of equalities, a date range on text dates, and a bounding box; a row without a place fails a box."""
    test: Column = F.lit(True)
    for k in EQUALITIES:
        if filters.get(k) is not None:
            test = test & (F.col(k) == F.lit(filters[k]))
    for k, column, sign in (
        ("date_from", "date", 1), ("date_to", "date", -1), ("lat_min", "latitude", 1), ("lat_max", "latitude", -1),
        ("lon_min", "longitude", 1), ("lon_max", "longitude", -1),
    ):
        if filters.get(k) is not None:
            bound = F.lit(filters[k])
            test = test & (F.col(column) >= bound if sign > 0 else F.col(column) <= bound)
    return test


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, item, distance): exact cosine top k of a query set against all rows, ties by item.

    Queries go in blocks of at most BLOCK; a block travels with the scan of the corpus, is compared by matrix products,
    and leaves k rows a query and task.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    if blocks == 1:
        return keep_ranked(_near(queries, corpus, k, query_id, item_id, vector), k, query_id, item_id)
    keyed = queries.withColumn("_block", F.pmod(F.xxhash64(query_id), F.lit(blocks)))
    # one block after another, so the driver holds one block's vectors at a time
    found = [
        written(
            keep_ranked(_near(keyed.filter(F.col("_block") == b), corpus, k, query_id, item_id, vector), k, query_id, item_id),
            "nearest",
        ) for b in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found)


def keep_ranked(rows: DataFrame, k: int, query_id: str, item_id: str) -> DataFrame:
    """(query_id, rank, item, distance) of the k nearest rows a query."""
    order = Window.partitionBy(query_id).orderBy(F.round("distance", 6), item_id)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_id, "rank", item_id, "distance")


def _near(block: DataFrame, corpus: DataFrame, k: int, query_id: str, item_id: str, vector: str) -> DataFrame:
    """The k nearest of each task's part of the corpus to each query of one block."""
    own = block.select(F.col(query_id).cast("long"), vector).collect()
    names, wanted = [r[0] for r in own], _unit(np.array([r[1] for r in own], np.float64)) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = which = None  # the nearest so far, a line a query, by rounded distance and id
        for batch in batches:
            rows = batch.filter(batch.column(1).is_valid())
            if wanted is None or not rows.num_rows:
                continue
            step = max(1, HELD // len(names))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                far = 1 - wanted @ _unit(np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)).T
                if near is None:
                    near, which = np.full((len(names), 0), 0.0), np.full((len(names), 0), 0, np.int64)
                if near.shape[1] < k:
                    some = np.arange(len(names))
                else:  # queries that any of these rows is near enough to
                    some = np.flatnonzero(far.min(axis=1) <= near[:, -1] + 1e-6)
                    far = far[some]
                both = np.hstack([near[some], far])
                each = np.hstack([which[some], np.broadcast_to(ids, far.shape)])
                order = np.lexsort((each, np.round(both, 6)), axis=1)[:, :k]
                best, whose = np.take_along_axis(both, order, axis=1), np.take_along_axis(each, order, axis=1)
                if len(some) == len(names):
                    near, which = best, whose
                else:
                    near[some], which[some] = best, whose
        if near is not None:  # once a task
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, near.shape[1]), pa.int64()), pa.array(which.ravel(), pa.int64()), pa.array(near.ravel(), pa.float64())],
                names=[query_id, item_id, "distance"],
            )

    return corpus.select(F.col(item_id).cast("long"), vector).mapInArrow(run, f"{query_id} long, {item_id} long, distance double")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows without length stay zero, at distance 1 from all."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def ranked(rows: DataFrame, query_id: str, order: list[str]) -> DataFrame:
    """rank from 1 of each query's results."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids, each once however often an id is there; Spark picks the join by size."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def merge_ranked(a: DataFrame, b: DataFrame, k: int, tie: str) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).orderBy("distance", tie).limit(k)


def strict_gate(evidence: DataFrame, limit: float = 0.42, keys: list[str] | None = None) -> DataFrame:
    """One row, or one for each of the keys: whether the nearest evidence is near enough to answer."""
    return evidence.groupBy(*(keys or [])).agg(F.count("distance").alias("n"), F.min("distance").alias("nearest")).select(
        "*", ((F.col("n") > 0) & (F.col("nearest") <= limit)).alias("answer"),
    )


def hit_at_k(found: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Share of queries with any hit; found has one row a result, and a query without results has one row of nulls."""
    each = found.groupBy(*keys, "query_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"))
    return each.groupBy(*keys).agg(
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("queries"),
    ) if keys else each.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("queries"))


def event_chunks(visits: DataFrame) -> DataFrame:
    """One chunk a visit."""
    text = F.format_string(
        "Vessel %s called at %s on %s and stayed %.1f hours.", F.col("mmsi").cast("string"), F.col("port_key"),
        F.date_format("arrival_time", "yyyy-MM-dd"), F.col("dwell_minutes") / 60,
    )
    return visits.select(
        F.concat_ws("_", F.lit("event"), "call_id").alias("id"), text.alias("text"), F.col("port_key").alias("port"),
        F.date_format("arrival_time", "yyyy-MM-dd").alias("date"), F.col("vessel_type_norm").alias("vessel_type"),
    )


def flagged_event_chunks(visits: DataFrame) -> DataFrame:
    """event_chunks() with metadata, of visits with short_dwell and long_dwell: what kind of event, whether it is unusual and how."""
    kind = F.when(F.coalesce("long_dwell", F.lit(False)), "long dwell").when(F.coalesce("short_dwell", F.lit(False)), "short dwell").otherwise("none")
    text = F.format_string(
        "Vessel %s called at %s on %s and stayed %.1f hours. Unusual: %s.", F.col("mmsi").cast("string"), F.col("port_key"),
        F.date_format("arrival_time", "yyyy-MM-dd"), F.col("dwell_minutes") / 60, kind,
    )
    return _events(visits, "visit", "call_id", text, F.col("port_key"), F.date_format("arrival_time", "yyyy-MM-dd"), kind)


def position_event_chunks(rows: DataFrame) -> DataFrame:
    """The same of positions with jump_flag and destination_norm."""
    kind = F.when(F.coalesce("jump_flag", F.lit(False)), "position jump").otherwise("none")
    text = F.format_string(
        "Vessel %s was at %.5f, %.5f on %s moving at %.1f knots. Unusual: %s.", F.col("mmsi").cast("string"), F.col("latitude"),
        F.col("longitude"), F.date_format("ts", "yyyy-MM-dd"), F.coalesce(F.col("speed").cast("double"), F.lit(-1.0)), kind,
    )
    return _events(rows, "position", "event_id", text, F.col("destination_norm"), F.date_format("ts", "yyyy-MM-dd"), kind)


def _events(rows: DataFrame, event: str, key: str, text: Column, port: Column, date: Column, kind: Column) -> DataFrame:
    code = F.col("locode_norm") if "locode_norm" in rows.columns else F.lit("")
    vessel = F.col("vessel_type_norm") if "vessel_type_norm" in rows.columns else F.lit(None).cast("string")
    own = rows.select(
        F.concat_ws("_", F.lit(event), F.col(key).cast("string")).alias("id"), text.alias("text"), port.alias("port"),
        code.alias("locode"), date.alias("date"), F.coalesce(vessel, F.lit("unknown")).alias("vessel_type"),
        kind.alias("anomaly_kind"), F.col("mmsi").cast("string").alias("mmsi"),
    )
    return own.select("*", (F.col("anomaly_kind") != "none").alias("anomaly"), F.lit(event).alias("event_type"), F.lit("events").alias("strategy"))


def port_day_chunks(days: DataFrame, proxy_days: DataFrame) -> DataFrame:
    """One chunk a port and day of visits, and of positions for days without visits (an anti-join)."""
    seen = days.select(
        F.concat_ws("_", F.lit("portday"), "port_key", F.col("date").cast("string")).alias("id"),
        F.format_string(
            "%s on %s: %d arrivals of %d vessels.", F.col("port_key"), F.col("date").cast("string"), F.col("arrivals"),
            F.col("vessels"),
        ).alias("text"),
        "port_key", "date",
    )
    rest = proxy_days.join(days, ["port_key", "date"], "left_anti")
    more = rest.select(
        F.concat_ws("_", F.lit("aisday"), "port_key", F.col("date").cast("string")).alias("id"),
        F.format_string(
            "%s on %s: %d positions.", F.col("port_key"), F.col("date").cast("string"), F.col("positions"),
        ).alias("text"),
        "port_key", "date",
    )
    return seen.unionByName(more)


def window_chunks(visits: DataFrame, width: int = 5) -> DataFrame:
    """Chunks of `width` consecutive visits of a port, with the two most common vessel types (ties by name)."""
    ranked = with_rank(visits, ["port_key", "arrival_time", "call_id", "departure_time"])  # no window holds a port's history
    first = ranked.groupBy(F.col("port_key").alias("_port")).agg(F.min("_rank").alias("_first"))
    own = ranked.join(first, F.col("port_key").eqNullSafe(F.col("_port"))).withColumn(
        "chunk", F.floor((F.col("_rank") - F.col("_first")) / width),
    ).drop("_rank", "_first", "_port")
    kinds = own.groupBy("port_key", "chunk", "vessel_type_norm").agg(F.count("*").alias("k"))
    top = kinds.withColumn("r", F.row_number().over(Window.partitionBy("port_key", "chunk").orderBy(F.desc("k"), "vessel_type_norm"))).filter("r <= 2").groupBy("port_key", "chunk").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("r", "vessel_type_norm"))), lambda x: x["vessel_type_norm"]), ",",
        ).alias("top_types")
    )
    each = own.groupBy("port_key", "chunk").agg(
        F.count("*").alias("window_size"), F.min("arrival_time").alias("first_arrival"),
        F.max("arrival_time").alias("last_arrival"), F.avg("dwell_minutes").alias("mean_dwell"),
    )
    return each.join(top, ["port_key", "chunk"])


def numbered_ids(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """base, base__dup1, base__dup2, ... for ids that occur again."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return rows.withColumn("unique_id", F.when(n == 0, F.col(base)).otherwise(F.concat(base, F.lit("__dup"), n.cast("string"))))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
