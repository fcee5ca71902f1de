"""Queries for evidence: embeddings, filters on chunks, documents by nearness, hits and measures, port names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, marts, questions, retrieval, serving
from ..registry import register
from . import ports
from .views import CALLS, POS, positions, read, visits

_EVERY = 50
_SLOTS = f"""slots AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {evidence.DIMENSIONS} AS slot FROM benchmark, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t(w)),
counted AS (SELECT item_id, slot, count(*)::DOUBLE AS n FROM slots GROUP BY ALL), vectors AS (SELECT item_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM counted)"""


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", evidence.embedding(F.col("text")).alias("embedding"))


@register("rt1_embeddings", f"WITH {_SLOTS} SELECT item_id, slot::INT AS slot, round(weight, 6) AS weight FROM vectors")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = _index(spark, d).select("item_id", F.posexplode("embedding").alias("slot", "weight"))
    return own.filter("weight > 0").select("item_id", "slot", _r("weight"))


@register(
    "rt15_unit_vectors",
    "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS square, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings").select("vec_id", evidence.unit(F.col("embedding")).alias("u"))
    return own.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"),
        F.round(F.col("u")[0], 6).alias("first"),
    )


@register("tk7_documents_top_k", f"""WITH {_SLOTS}, dots AS (SELECT q.item_id AS query_id, v.item_id, sum(q.weight * v.weight) AS dot FROM vectors q JOIN vectors v USING (slot) WHERE q.item_id % {_EVERY} = 0 GROUP BY ALL),
pairs AS (SELECT q.item_id AS query_id, b.item_id, 1 - coalesce(dot, 0) AS distance FROM benchmark q CROSS JOIN benchmark b LEFT JOIN dots ON dots.query_id = q.item_id AND dots.item_id = b.item_id WHERE q.item_id % {_EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), item_id)::INT AS rank, item_id, round(distance, 5) + 0.0 AS distance FROM pairs QUALIFY rank <= 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    queries = index.filter(F.col("item_id") % _EVERY == 0).select(F.col("item_id").alias("query_id"), "embedding")
    found = evidence.retrieve(queries, index.join(read(spark, d, "benchmark"), "item_id"), 3)
    return found.select("query_id", "rank", "item_id", (F.round("distance", 5) + 0.0).alias("distance"))


_CHUNKS = f"""{CALLS}, days AS (SELECT port_key AS port, arrival_date AS date, count(*) AS n FROM calls GROUP BY ALL), chunks AS (SELECT 'portday_' || port || '_' || date AS id, port, 'NA' || substr(port, 8) AS locode, date, n > 1 AS anomaly, CASE WHEN n % 2 = 0 THEN 'Tanker' ELSE 'cargo' END AS vessel_type FROM days)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    days = marts.port_day(marts.dwell(visits(spark, d)), [])
    own = days.select(
        F.concat_ws("_", F.lit("portday"), "port_key", F.col("date").cast("string")).alias("id"), F.col("port_key").alias("port"),
        F.concat(F.lit("NA"), F.substring("port_key", 8, 9)).alias("locode"), "date", "arrivals",
    )
    return own.select(
        "id", "port", "locode", "date", (F.col("arrivals") > 1).alias("anomaly"),
        F.when(F.col("arrivals") % 2 == 0, "Tanker").otherwise("cargo").alias("vessel_type"),
    )


@register(
    "fi11_chunk_filter",
    f"WITH {_CHUNKS} SELECT id FROM chunks WHERE (contains(port, 'NATION_1') OR locode = 'NATION_1') AND lower(vessel_type) = 'cargo' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND NOT anomaly",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    f = evidence.ChunkFilters(" nation_1 ", "Cargo", False, "1996-01-01", "1999-12-31")
    return _chunks(spark, d).filter(f.matches()).select("id")


@register("fi21_pushed_filter", f"WITH {_CHUNKS} SELECT id FROM chunks WHERE port = 'NATION_1' AND vessel_type = 'cargo'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter(evidence.ChunkFilters("nation_1", "CARGO").pushed()).select("id")


@register(
    "fi19_metadata_condition",
    f"WITH {CALLS} SELECT call_id FROM calls WHERE port_key = 'NATION_6' AND arrival_date::VARCHAR >= '1996-06-01' AND vessel_type_norm = '1-URGENT'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d).withColumns(
        {
            "locode": F.col("port_key"), "vessel_type": F.lower("vessel_type_norm"),
            "date": F.date_format("arrival_time", "yyyy-MM-dd"),
        }
    )
    f = evidence.Filters(locode=" nation_6 ", vessel_type=" 1-Urgent", date_from="1996-06-01")
    return rows.filter(f.condition()).select("call_id")


# Cases: each port expects its own chunks of odd days; chunks of even days are found for them, too.
_FOUND = f"""{_CHUNKS}, found AS (SELECT *, port AS query_id, lower(replace(port, '_', ' _')) AS expected_port, CASE WHEN day(date) % 2 = 1 THEN date ELSE date + 1 END AS expected_date, CASE WHEN length(port) = 8 THEN NULL ELSE true END AS expected_anomaly, length(id)::DOUBLE AS latency_ms FROM chunks),
hits AS (SELECT *, date = expected_date AND (expected_anomaly IS NULL OR anomaly = expected_anomaly) AS hit FROM found)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    odd = F.day("date") % 2 == 1
    return _chunks(spark, d).withColumns({
        "query_id": F.col("port"), "expected_port": F.lower(F.replace("port", F.lit("_"), F.lit(" _"))), "expected_date": F.when(odd, F.col("date")).otherwise(F.date_add("date", 1)),
        "expected_anomaly": F.when(F.length("port") != 8, F.lit(True)), "latency_ms": F.length("id").cast("double"), "ungrounded": F.col("anomaly"),
    })


def _hit() -> F.Column:
    return evidence.query_hit(F.col("expected_port"), F.col("expected_date"), F.col("expected_anomaly"))


@register("rt10_query_hits", f"WITH {_FOUND} SELECT id, hit FROM hits")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("id", _hit().alias("hit"))


@register(
    "ag36_evaluation",
    f"WITH {_FOUND}, q AS (SELECT vessel_type, query_id, bool_or(hit) AS hit, max(latency_ms) AS ms, bool_or(anomaly) AS bad FROM hits GROUP BY ALL) SELECT vessel_type, round(avg(hit::INT), 6) AS hit_rate, round(avg(ms), 6) AS mean_latency_ms, round(avg(bad::INT), 6) AS ungrounded_rate, count(*)::BIGINT AS queries FROM q GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = evidence.evaluation(_found(spark, d), ["vessel_type"], _hit())
    return own.select("vessel_type", _r("hit_rate"), _r("mean_latency_ms"), _r("ungrounded_rate"), "queries")


@register(
    "wi16_relevance_ranks",
    f"WITH {_FOUND} SELECT id, row_number() OVER (PARTITION BY query_id ORDER BY latency_ms, id)::INT AS rank, hit FROM hits",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked(_found(spark, d).withColumn("hit", _hit()), "query_id", ["latency_ms", "id"]).select("id", "rank", "hit")


@register(
    "jo10_candidates",
    f"WITH {CALLS} SELECT call_id, port_key FROM calls WHERE call_id IN (SELECT o_orderkey || '-1' FROM orders WHERE o_orderkey % {_EVERY} = 0)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "orders").filter(F.col("o_orderkey") % _EVERY == 0).select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("call_id")
    )
    return retrieval.by_ids(visits(spark, d), ids, "call_id").select("call_id", "port_key")


@register("ml6_top_k_accuracy", "SELECT round(avg((event_id % 4 < 3)::INT), 6) AS accuracy, count(*)::BIGINT AS rows FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every row's own class stands at rank event_id % 4 + 1 of its four predictions."""
    rows = positions(spark, d).select("event_id", "mode")
    ranks = rows.select("event_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"), F.col("mode").alias("own"))
    predicted = ranks.select("event_id", "rank", F.when(F.col("rank") == F.col("event_id") % 4 + 1, F.col("own")).otherwise("?").alias("mode"))
    return serving.top_k_accuracy(predicted, rows, "event_id", "mode", 3).select(_r("accuracy"), "rows")


# Names as people type them: small letters, `port of`, a letter twice, an alias, a code's shape, a name that isn't there.
_TOTALS = f"{CALLS}, totals AS (SELECT n_name, (SELECT count(*) FROM calls WHERE port_key = n_name) AS n FROM nation)"


@register("qa4_resolved_ports", f"""WITH {_TOTALS}, typed AS (
  SELECT lower(n_name) AS token, n_name AS resolved, true AS known FROM nation
  UNION ALL SELECT 'Port of  ' || n_name, (SELECT arg_max(t.n_name, (n, -ascii(substr(t.n_name, 8)), -length(t.n_name))) FROM totals t WHERE contains(lower(t.n_name), lower(nation.n_name))), true FROM nation WHERE length(n_name) = 9
  UNION ALL SELECT replace(n_name, 'NAT', 'NATT'), n_name, true FROM nation
  UNION ALL SELECT 'Göteborg', 'SEGOT', false UNION ALL SELECT 'Klaipėda', 'LTKLJ', false UNION ALL SELECT 'Kotka', 'KOTKA', false UNION ALL SELECT 'lv rix', 'LVRIX', false UNION ALL SELECT 'Atlantis', 'Atlantis', false)
SELECT * FROM typed""")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "nation").select("n_name")
    arrivals = visits(spark, d).groupBy("port_key").agg(F.count("*").alias("arrivals_total"))
    catalog = ports.Catalog.of(
        names.join(
            arrivals, F.col("n_name") == F.col("port_key"), "left",
        ).select(F.col("n_name").alias("port_key"), "arrivals_total")
    )
    n = F.col("n_name")
    tokens = names.select(F.lower(n).alias("token")).union(
        names.filter(F.length(n) == 9).select(F.concat(F.lit("Port of  "), n))
    ).union(names.select(F.replace(n, F.lit("NAT"), F.lit("NATT"))))
    tokens = tokens.union(spark.createDataFrame([(t,) for t in ("Göteborg", "Klaipėda", "Kotka", "lv rix", "Atlantis")], "token string"))
    return ports.resolved(tokens, catalog)


@register(
    "fi16_call_linked",
    f"WITH {CALLS} SELECT port_key, count(*)::BIGINT AS visits FROM calls WHERE l_even GROUP BY ALL".replace("l_even", "call_id NOT LIKE '%-1'"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = visits(spark, d).withColumn("call_id", F.when(~F.col("call_id").like("%-1"), F.col("call_id")).otherwise(F.lit("")))
    return questions.call_linked(rows).groupBy("port_key").agg(F.count("*").alias("visits"))


@register("pr21_event_metadata", f"""WITH {CALLS}, f AS (SELECT *, dwell_minutes < quantile_cont(dwell_minutes, 0.1) OVER (PARTITION BY port_key) AS s, dwell_minutes > quantile_cont(dwell_minutes, 0.9) OVER (PARTITION BY port_key) AS l FROM calls)
SELECT 'visit_' || call_id AS id, port_key AS port, arrival_date::VARCHAR AS date, vessel_type_norm AS vessel_type, CASE WHEN l THEN 'long dwell' WHEN s THEN 'short dwell' ELSE 'none' END AS anomaly_kind, s OR l AS anomaly, mmsi::VARCHAR AS mmsi, 'visit' AS event_type FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = retrieval.flagged_event_chunks(marts.dwell_flags(marts.dwell(visits(spark, d))))
    return own.select("id", "port", "date", "vessel_type", "anomaly_kind", "anomaly", "mmsi", "event_type")


@register(
    "pr21_position_events",
    f"""WITH {POS} SELECT 'position_' || event_id AS id, 'Vessel ' || mmsi || ' was at ' || printf('%.5f', latitude) || ', ' || printf('%.5f', longitude) || ' on ' || strftime(ts, '%Y-%m-%d') || ' moving at ' || printf('%.1f', round(speed, 0)) || ' knots. Unusual: ' || CASE WHEN event_id % 7 = 0 THEN 'position jump' ELSE 'none' END || '.' AS text, mode AS port, event_id % 7 = 0 AS anomaly FROM pos""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).withColumns({"speed": F.round("speed", 0), "jump_flag": F.col("event_id") % 7 == 0, "destination_norm": F.col("mode")})
    return retrieval.position_event_chunks(rows).select("id", "text", "port", "anomaly")
