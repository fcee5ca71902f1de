"""Queries for text, cleaning, retrieval, chunking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, text
from ..operators import marts, retrieval
from ..registry import register
from ..sources import files
from .views import CALLS, POS, read, visits

#: The stated query set: every row whose id is divisible by this.
_EVERY = 50


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c).cast("double"), digits).alias(c)


@register("pr1_destination", """WITH x AS (SELECT p_partkey, upper(trim(p_name)) AS raw FROM part), y AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(raw, '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM x)
SELECT p_partkey, CASE WHEN t = '' THEN 'UNKNOWN' WHEN t = 'RED BOLT' THEN 'RDBLT' WHEN regexp_full_match(t, '[A-Z]{2}\\s?[A-Z]{3}') THEN replace(t, ' ', '') ELSE t END AS destination FROM y""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", clean.destination(F.col("p_name"), {"RED BOLT": "RDBLT"}).alias("destination"))


@register("pr3_identifier", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS identifier FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")),
    ).when(F.col("o_orderkey") % 3 == 2, F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", clean.identifier(raw).alias("identifier"))


@register(
    "pr4_locode_and_key",
    """SELECT c_custkey, 'NA' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS locode, CASE WHEN c_custkey % 2 = 0 THEN 'NA' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE upper(c_mktsegment) END AS port_key FROM customer""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("na "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    code = clean.locode(raw)
    return read(spark, d, "customer").select(
        "c_custkey", code.alias("locode"),
        clean.port_key(F.when(F.col("c_custkey") % 2 == 0, code), F.col("c_mktsegment")).alias("port_key"),
    )


@register("pr7_number", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "n/a").when(
        F.col("event_id") % 4 == 1, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")),
    ).otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", clean.number_comma(raw).alias("value"))


@register(
    "pr14_time_parts",
    """SELECT event_id, round(hour(ts) + minute(ts) / 60e0, 6) AS hour_of_day, (isodow(ts) - 1)::INT AS weekday FROM events""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", F.round(clean.hour_of_day(F.col("ts")), 6).alias("hour_of_day"), F.weekday("ts").alias("weekday"),
    )


@register(
    "pr13_stable_id",
    f"""WITH {POS} SELECT event_id, mmsi || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || printf('%.5f', latitude) || '_' || printf('%.5f', longitude) AS stable_id FROM pos""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from .views import positions

    return positions(spark, d).select(
        "event_id",
        clean.position_id(F.col("mmsi").cast("string"), F.col("ts"), F.col("latitude"), F.col("longitude")).alias("stable_id"),
    )


@register(
    "pr20_vessel_class",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'tanker' WHEN 1 THEN 'cargo' WHEN 2 THEN 'container' WHEN 3 THEN 'passenger' WHEN 4 THEN 'unknown' ELSE 'tanker' END AS vessel_class FROM part""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(
        F.array(*map(F.lit, ("Oil Tanker", "bulk carrier", " container ship", "passenger/ro-ro", "ferry", "crude oil tanker 2"))),
        (F.col("p_partkey") % 6 + 1).cast("int"),
    )
    return read(spark, d, "part").select("p_partkey", clean.vessel_class(kinds).alias("vessel_class"))


def _html_sql(column: str) -> str:
    """html_text() as SQL."""
    out = column
    for tag in text.HIDDEN:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@register("pr24_html_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@register(
    "sc13_page_chunks",
    f"""WITH t AS (SELECT page_id, url, {_html_sql('html')} AS text FROM pages) SELECT page_id, url, (s // 1000)::INT AS chunk_no, md5(substr(text, (s + 1)::INT, 1200)) AS chunk_md5 FROM t, unnest(range(0, length(text), 1000)) AS r(s)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = files.page_chunks(read(spark, d, "pages"), "page_id")
    return own.select("page_id", "url", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@register(
    "ar1_fixed_chunks",
    """SELECT doc_id, (s // 1000)::INT AS chunk_no, md5(substr(text, (s + 1)::INT, 1200)) AS chunk_md5 FROM documents, unnest(range(0, length(text), 1000)) AS t(s)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", F.inline(text.fixed_chunks(F.col("text"), 1200, 200)))
    return own.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@register("sf_json_path", """SELECT event_id, (props ->> '$.k')::INT AS k FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("sf_evidence_id", """SELECT doc_id, substr(sha1(doc_id || '|v1'), 1, 24) AS evidence_id FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", clean.evidence_id(F.col("doc_id").cast("string"), F.lit("v1")).alias("evidence_id"))


_TOP = """scored AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance, q.label AS ql, e.label AS el FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 {more}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), vec_id)::INT AS rank FROM scored QUALIFY rank <= 5)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").filter(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@register("tk5_vector_top_k", f"""WITH {_TOP.format(more='')} SELECT query_id, rank, vec_id, round(distance, 5) + 0.0 AS distance FROM top""")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = retrieval.top_k(_queries(spark, d), read(spark, d, "embeddings"), 5)
    return own.select("query_id", "rank", "vec_id", (F.round("distance", 5) + 0.0).alias("distance"))


def _others(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The k nearest rows to each query but its own: of k + 1 nearest, those that aren't the query."""
    found = retrieval.top_k(_queries(spark, d), read(spark, d, "embeddings"), k + 1).filter(F.col("vec_id") != F.col("query_id"))
    return retrieval.keep_ranked(found, k, "query_id", "vec_id")


@register("tk6_filtered_top_k", f"""WITH {_TOP.format(more='AND e.label IN (1, 3)')} SELECT query_id, rank, vec_id FROM top""")
def _(spark: SparkSession, d: str) -> DataFrame:
    corpus = read(spark, d, "embeddings").filter(F.col("label").isin(1, 3))
    return retrieval.top_k(_queries(spark, d), corpus, 5).select("query_id", "rank", "vec_id")


@register(
    "ag36_hit_at_k",
    f"""WITH {
        _TOP.format(more='AND e.vec_id <> q.vec_id')
    }, h AS (SELECT query_id, bool_or(ql = el) AS hit FROM top GROUP BY ALL) SELECT round(avg(hit::INT), 6) AS hit_rate, count(*)::BIGINT AS queries FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    labelled = _others(spark, d).join(labels, "vec_id").join(
        labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id",
    )
    return retrieval.hit_at_k(labelled, [], F.col("label") == F.col("query_label")).select(_r("hit_rate"), "queries")


@register(
    "rt4_strict_gate",
    f"""WITH {
        _TOP.format(more='AND e.vec_id <> q.vec_id')
    } SELECT q.vec_id AS query_id, count(distance)::BIGINT AS n, round(min(distance), 5) AS nearest, count(distance) > 0 AND min(distance) <= 0.42 AS answer FROM embeddings q LEFT JOIN top ON query_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _queries(spark, d).select("query_id").join(_others(spark, d), "query_id", "left")
    return retrieval.strict_gate(found, keys=["query_id"]).select("query_id", "n", _r("nearest", 5), "answer")


@register(
    "rt7_event_chunks",
    f"""WITH {CALLS} SELECT 'event_' || call_id AS id, 'Vessel ' || mmsi || ' called at ' || port_key || ' on ' || strftime(arrival_time, '%Y-%m-%d') || ' and stayed ' || printf('%.1f', dwell_minutes / 60) || ' hours.' AS text, port_key AS port FROM calls""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.event_chunks(marts.dwell(visits(spark, d))).select("id", "text", "port")


@register("rt8_port_day_chunks", f"""WITH {CALLS}, p AS (SELECT port_key, arrival_date AS date, count(*) AS arrivals, count(DISTINCT mmsi) AS vessels FROM calls GROUP BY ALL), o AS (
  SELECT n_name AS port_key, o_orderdate::DATE AS date, count(*) AS positions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'portday_' || port_key || '_' || date AS id, port_key || ' on ' || date || ': ' || arrivals || ' arrivals of ' || vessels || ' vessels.' AS text FROM p
UNION ALL SELECT 'aisday_' || port_key || '_' || date, port_key || ' on ' || date || ': ' || positions || ' positions.' FROM o ANTI JOIN p USING (port_key, date)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    days = marts.port_day(marts.dwell(visits(spark, d)), [])
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    )
    proxy = orders.groupBy(F.col("n_name").alias("port_key"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("positions"))
    return retrieval.port_day_chunks(days, proxy).select("id", "text")


@register("rt9_window_chunks", f"""WITH {CALLS}, n AS (SELECT *, (row_number() OVER (PARTITION BY port_key ORDER BY arrival_time, call_id, departure_time) - 1) // 5 AS chunk FROM calls),
k AS (SELECT port_key, chunk, vessel_type_norm, count(*) AS c FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY port_key, chunk ORDER BY c DESC, vessel_type_norm) AS r FROM k QUALIFY r <= 2),
t AS (SELECT port_key, chunk, string_agg(vessel_type_norm, ',' ORDER BY r) AS top_types FROM r GROUP BY ALL), e AS (SELECT port_key, chunk, count(*)::BIGINT AS window_size, round(avg(dwell_minutes), 6) AS mean_dwell FROM n GROUP BY ALL)
SELECT port_key, chunk::BIGINT AS chunk, window_size, mean_dwell, top_types FROM e JOIN t USING (port_key, chunk)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.window_chunks(marts.dwell(visits(spark, d))).select("port_key", "chunk", "window_size", _r("mean_dwell"), "top_types")


@register(
    "wi15_numbered_ids",
    """WITH n AS (SELECT event_id, event_type || '-' || user_id AS base, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS k FROM events) SELECT event_id, CASE WHEN k = 0 THEN base ELSE base || '__dup' || k END AS unique_id FROM n""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").withColumn("base", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    return retrieval.numbered_ids(own, "base", ["ts", "event_id"]).select("event_id", "unique_id")


@register(
    "so1_union_by_name",
    """SELECT 'position' AS kind, event_id AS id, value AS speed, NULL::DOUBLE AS price FROM events UNION ALL SELECT 'visit', o_orderkey, NULL, o_totalprice FROM orders""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "events").select(F.lit("position").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("speed"))
    b = read(spark, d, "orders").select(F.lit("visit").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@register("so3_keep_first", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keep_first(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@register("so4_distinct", """SELECT DISTINCT user_id, event_type FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@register(
    "jo6_anti_join_days",
    """SELECT DISTINCT o_orderdate::DATE::VARCHAR AS date FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.join(
        read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct(), "date", "left_anti",
    ).select(F.col("date").cast("string").alias("date"))


@register(
    "jo7_semi_join",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    urgent = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@register("sk7_upsert", """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'new' ELSE 'old' END AS state FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.lit("old").alias("state"))
    return retrieval.upsert(old, c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("state")), "id")


@register(
    "pv1_series_pivot",
    """SELECT date_trunc('day', ts)::DATE::VARCHAR AS date, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("date")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return own.select("date", _r("click"), _r("view"))


@register(
    "fi8_metadata_filter",
    f"""WITH {POS} SELECT event_id FROM pos WHERE mmsi = 8 AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20' AND latitude >= 54.5 AND longitude <= 12""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from .views import positions

    own = positions(spark, d).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return own.filter(
        retrieval.metadata_filter(
            {"mmsi": 8, "date_from": "2024-01-05", "date_to": "2024-01-20", "lat_min": 54.5, "lon_max": 12.0}
        )
    ).select("event_id")
