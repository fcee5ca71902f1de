"""Queries for indexes of vectors and words, and for sketches that merge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, lexical, marts, sketches, vector_index
from ..operators.place_index import Box, PlaceIndex
from ..registry import register
from ..storage import shared_dir, written
from .views import CALLS, POS, positions, read, visits

K = 5


def _index(spark: SparkSession, d: str) -> tuple[vector_index.CellIndex, DataFrame]:
    """All vectors by cell, and the queries: those whose id divides by 50."""
    rows = read(spark, d, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.CellIndex.build(rows, shared_dir(spark, "cells")), queries


@register("tk8_cell_index")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search; recall against exact search is in the tests."""
    index, queries = _index(spark, d)
    return index.search(queries, K).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"), "scanned")


_EXACT = """WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 {where}), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, round(distance, 4) AS distance, (SELECT count(*) FROM embeddings e WHERE true {where})::BIGINT AS scanned FROM ranked WHERE rank <= 5"""


@register("tk8_cell_index_exact", _EXACT.format(where=""))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same index with all cells probed."""
    index, queries = _index(spark, d)
    return index.search(queries, K, share=1).select("query_id", "rank", "vec_id", F.round("distance", 4).alias("distance"), "scanned")


@register("tk6_cell_index_filtered", _EXACT.format(where="AND e.label = 3"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """A filter that few rows meet: cells are probed until all of them are expected, so the result is exact."""
    index, queries = _index(spark, d)
    found = index.search(queries, K, F.col("label") == 3, expected=1 << 40)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 4).alias("distance"), "scanned")


@register(
    "rt2_incremental_index",
    """SELECT doc_id, md5(coalesce(text, '')) AS text_md5, doc_id % 10 = 0 OR doc_id % 97 = 5 AS embedded_again, 2 AS version FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """An older state of the documents is indexed, then the present one: a tenth has changed, some are new, some have gone.

    Each chunk of the second version, with whether its vector is of that build.
    """
    now = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    then = now.filter("doc_id % 97 != 5").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" older"))).otherwise(F.col("text")))
    gone = now.filter("doc_id % 31 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    index = vector_index.VersionedIndex(spark, shared_dir(spark, "versions"), lambda t: evidence.embedding(t, 16), "doc_id")
    index.build(then.unionByName(gone))
    built = index.build(now)
    own = index.read(built.version)
    return own.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("_part").startswith(f"vectors-{built.version:06d}").alias("embedded_again"),
        F.lit(built.version).alias("version"),
    )


_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


@register("tk7_lexical_top_k", f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
tf AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM s)
SELECT item_id, rank::INT AS rank, doc_id, round(score, 3) AS score FROM r WHERE rank <= 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of each benchmark item by an inverted index, against the scores of all pairs."""
    index = lexical.LexicalIndex.build(read(spark, d, "documents"), shared_dir(spark, "lexical"))
    found = index.search(read(spark, d, "benchmark"), 3, "item_id")
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", F.round("score", 3).alias("score"))


@register("ag5_dwell_sketches", f"""WITH {CALLS} SELECT coalesce(port_key, 'ALL') AS port_key, count(*)::BIGINT AS visits, true AS median_within, true AS p90_within, true AS vessels_within
FROM calls GROUP BY GROUPING SETS ((port_key), ()) HAVING count(*) > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by port and month, merged to ports and to all; each estimate is held against the visits themselves."""
    stays = marts.dwell(visits(spark, d))
    months = written(sketches.visit_sketches(stays, ["port_key"]), "sketches")
    ports = sketches.merged(months, ["port_key"])
    whole = sketches.merged(months, []).select(F.lit("ALL").alias("port_key"), "visits", "minutes", "dwell", "vessels")
    found = written(sketches.told(ports.unionByName(whole), {"p50": 0.5, "p90": 0.9}), "told")
    each = stays.select("mmsi", "dwell_minutes", F.explode(F.array("port_key", F.lit("ALL"))).alias("port_key"))
    own = each.join(found, "port_key")
    # a value's ranks are between the shares below it and up to it
    near = lambda c, r: (F.avg((F.col("dwell_minutes") < F.col(c)).cast("double")) - sketches.RANK_ERROR <= r) & (
        F.avg((F.col("dwell_minutes") <= F.col(c)).cast("double")) + sketches.RANK_ERROR >= r
    )
    close = F.abs(F.first("distinct_vessels") - F.count_distinct("mmsi")) <= sketches.COUNT_ERROR * F.count_distinct("mmsi") + 1
    return own.groupBy("port_key").agg(
        F.first("visits").alias("visits"), near("p50", 0.5).alias("median_within"), near("p90", 0.9).alias("p90_within"), close.alias("vessels_within"),
    )


@register(
    "fi8_box_and_dates",
    f"WITH {POS} SELECT mmsi, event_id, mode FROM pos WHERE latitude BETWEEN 54.2 AND 55.2 AND longitude BETWEEN 10.5 AND 11.5 AND ts BETWEEN (SELECT min(ts) FROM pos) AND (SELECT min(ts) + INTERVAL 10 DAY FROM pos)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A box of one degree in the ten first days, of files along the curve of place and time."""
    own = positions(spark, d)
    start = own.agg(F.min("ts")).first()[0]
    index = PlaceIndex.build(own, shared_dir(spark, "places"), file_rows=2_000)
    return index.search(Box(54.2, 55.2, 10.5, 11.5, start, start + dt.timedelta(days=10))).select("mmsi", "event_id", "mode")
