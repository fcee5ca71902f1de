"""Evidence for questions: filters, routes, embeddings, an index of chunks, retrieval, answers from evidence, evaluation."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import CODE_SHAPE
from .retrieval import metadata_filter, top_k

# Words that send a question to documents, and to traffic rows.
DOC_WORDS = (
    "regulation", "compliance", "article", "requirement", "nis2", "isps", "solas", "directive", "law", "policy", "framework",
    "security level",
)
TRAFFIC_WORDS = (
    "traffic", "anomaly", "vessel", "time", "mmsi", "imo", "ais", "position", "latitude", "longitude", "speed", "course",
    "heading", "destination", "eta", "nav status", "vessel type", "locode", "port", "arrival", "departure", "port call",
)
# End of the fixed values.

DIMENSIONS, STRICT = 64, 0.42
#: Words whose hashes a Python worker remembers, and bytes of text that it splits at a time.
REMEMBERED, SLICE_BYTES = 1 << 19, 8 << 20
REFUSAL = "There is no evidence in the data for an answer; widen the filters or add data."


def route(question: str) -> str:
    """docs, traffic, or both (also where no word tells)."""
    low = question.lower()
    docs, traffic = (any(w in low for w in own) for own in (DOC_WORDS, TRAFFIC_WORDS))
    return "both" if docs == traffic else "docs" if docs else "traffic"


def pick(override: object, found: object) -> str | None:
    """The override if it says something, else what was found."""
    return next((str(x).strip() for x in (override, found) if x is not None and str(x).strip()), None)


def _float(value: object) -> float | None:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return number if abs(number) < float("inf") else None


@dataclass(frozen=True)
class Filters:
    """Filters on the metadata of traffic rows; None doesn't filter."""

    mmsi: str | None = None
    imo: str | None = None
    locode: str | None = None
    port_name: str | None = None
    vessel_type: str | None = None
    flag: str | None = None
    destination: str | None = None
    nav_status: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    lat_min: float | None = None
    lat_max: float | None = None
    lon_min: float | None = None
    lon_max: float | None = None

    def normalized(self) -> Filters:
        """Ids without `.0`, codes and flags in capitals, names in small letters, limits as numbers; empty texts don't filter."""
        upper, lower = (lambda t: t.upper()), (lambda t: t.lower())
        forms: dict[str, Callable[[str], str]] = {
            "mmsi": _identifier, "imo": _identifier, "locode": lambda t: t.upper().replace(" ", ""), "port_name": lower, "vessel_type": lower,
            "flag": upper, "destination": _destination, "nav_status": lower,
        }
        out: dict[str, object] = {k: forms[k](v.strip()) for k in forms if (v := getattr(self, k)) and v.strip()}
        out |= {k: getattr(self, k) or None for k in ("date_from", "date_to")}
        return replace(Filters(), **out, **{k: _float(getattr(self, k)) for k in ("lat_min", "lat_max", "lon_min", "lon_max")})

    def active(self) -> dict[str, object]:
        """The normalised filters that are set."""
        own = self.normalized()
        return {f.name: getattr(own, f.name) for f in fields(own) if getattr(own, f.name) is not None}

    def condition(self) -> Column:
        """As a condition on columns of these names, which a scan can push down."""
        return metadata_filter(self.active())

    @classmethod
    def of(cls, found: dict[str, object], overrides: dict[str, object] | None = None, dates: bool = True) -> Filters:
        """From a question's scalars and overrides. A token of five letters is a code; any other port has to be both the
        destination and the port's name, so only a visit whose destination is its own port can match a name."""
        given = overrides or {}
        port = pick(given.get("port"), found.get("port"))
        code = port if port and re.fullmatch(CODE_SHAPE, port) else None
        name = port if port and not code else None
        span = {k: pick(given.get(k), found.get(k)) for k in ("date_from", "date_to")} if dates else {}
        own = {k: found.get(k) for k in ("mmsi", "imo")}
        return cls(**own, locode=code, port_name=name, destination=name, vessel_type=pick(given.get("vessel_type"), found.get("vessel_type")), **span)


def _identifier(text: str) -> str:
    return re.sub(r"^(\d+)\.0+$", r"\1", text)


def _destination(text: str) -> str:
    clean = " ".join(re.sub("[^A-Z0-9 ]+", " ", text.upper()).split())
    return clean.replace(" ", "") if re.fullmatch(CODE_SHAPE, clean) else clean or "UNKNOWN"


@dataclass(frozen=True)
class ChunkFilters:
    """Filters on chunks with port, locode, vessel_type, anomaly and date. `all` as vessel type doesn't filter."""

    port: str | None = None
    vessel_type: str | None = None
    anomaly: bool | None = None
    date_from: str | None = None
    date_to: str | None = None

    def normalized(self) -> ChunkFilters:
        text = lambda v: v.strip() if v and v.strip() else None
        port, kind = text(self.port), text(self.vessel_type)
        return ChunkFilters(port and port.upper().replace(" ", ""), kind and kind.lower(), self.anomaly, text(self.date_from), text(self.date_to))

    def pushed(self) -> Column:
        """The equalities that a store can take; stricter on ports than matches()."""
        f, test = self.normalized(), F.lit(True)
        for column, value in (("port", f.port), ("vessel_type", f.vessel_type), ("anomaly", f.anomaly)):
            test = test if value is None else test & (F.col(column) == F.lit(value))
        return test

    def matches(self) -> Column:
        """The port equals the chunk's port or code, or stands within its port; dates by their first ten characters."""
        f, test = self.normalized(), F.lit(True)
        upper = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
        if f.port:
            tight = lambda c: F.replace(upper(c), F.lit(" "), F.lit(""))
            test = test & ((tight("port") == f.port) | (tight("locode") == f.port) | upper("port").contains(f.port))
        if f.vessel_type and f.vessel_type != "all":
            test = test & (F.lower(F.coalesce("vessel_type", F.lit(""))) == f.vessel_type)
        if f.anomaly is not None:
            test = test & (F.coalesce("anomaly", F.lit(False)) == F.lit(f.anomaly))
        day = F.left(F.col("date").cast("string"), F.lit(10))
        for bound, ok in ((f.date_from, day >= F.lit(f.date_from)), (f.date_to, day <= F.lit(f.date_to))):
            test = test & F.coalesce(ok, F.lit(False)) if bound else test
        return test


#: Bytes that words are made of stay, all others become blanks.
_BLANKED = np.array([b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256)], np.uint8)
_hashes: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    """The first 32 bits of the word's MD5; words of up to 32 bytes are remembered, REMEMBERED at most."""
    number = _hashes.get(word)
    if number is None:
        number = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")
        if len(_hashes) < REMEMBERED and len(word) <= 32:
            _hashes[word] = number
    return number


def _counted(texts: pa.Array, ends: np.ndarray, dimensions: int) -> np.ndarray:
    """Counts of words by slot, a row a text; ends: the texts' offsets."""
    data = _BLANKED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    blanked = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(blanked)  # runs of blanks; at a text's ends they leave empty words
    words = lists.flatten().dictionary_encode()
    own = words.dictionary.cast(pa.binary()).to_pylist()
    slots = np.array([_hash(w) % dimensions if w else -1 for w in own], np.int64)[words.indices.to_numpy()]
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    there = slots >= 0
    return np.bincount(rows[there] * dimensions + slots[there], minlength=len(lists) * dimensions).reshape(-1, dimensions).astype(np.float64)


def hashed(texts: pa.Array, dimensions: int) -> pa.Array:
    """Unit vectors of the words of texts in small letters, without nulls; zeros for a text without words. SLICE_BYTES are in work at a time."""
    texts = texts.cast(pa.string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    out, at = np.zeros((n, dimensions)), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        counts = _counted(texts, ends[at : upto + 1], dimensions)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        np.divide(counts, length, out=out[at:upto], where=length > 0)
        at = upto
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimensions, dtype=np.int32)), pa.array(out.ravel()))


def embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of hashed words, by batches in tasks: the plug for a model's vectors where there is no model."""

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return hashed(texts, dimensions)

    return vectors(F.lower(F.coalesce(text, F.lit(""))))


def unit(vector: Column) -> Column:
    """A vector of length 1; one without length stays as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def build_index(spark: SparkSession, chunks: DataFrame, folder: str, rebuild: bool = False, embed: Callable[[Column], Column] = embedding) -> int:
    """Chunks (id, text, others) with vectors as Parquet under folder/vectors, the others under folder/metadata; rows in it.

    An index with rows is used again unless rebuild is set. The metadata is the vectors' table without text and vector.
    """
    path = f"{folder}/vectors"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if not there or rebuild or spark.read.parquet(path).isEmpty():
        chunks.withColumn("embedding", embed(F.col("text"))).write.mode("overwrite").parquet(path)
        spark.read.parquet(path).drop("text", "embedding").write.mode("overwrite").parquet(f"{folder}/metadata")
    return spark.read.parquet(path).count()


def metadata(spark: SparkSession, folder: str, condition: Column | None = None) -> DataFrame:
    """The index's metadata; Spark reads only the columns and row groups that a query needs."""
    rows = spark.read.parquet(f"{folder}/metadata")
    return rows if condition is None else rows.filter(condition)


def retrieve(queries: DataFrame, index: DataFrame, k: int, condition: Column | None = None, id_col: str = "item_id") -> DataFrame:
    """(query_id, rank, id, distance and the chunk's other columns): filtered first, then ranked, then joined by id.

    queries: query_id and embedding. Every row that meets the condition is ranked, so no pool of candidates is needed.
    """
    own = index if condition is None else index.filter(condition)
    found = top_k(queries, own, k, item_id=id_col)
    return found.join(own.drop("embedding"), id_col)  # k rows a query


@dataclass(frozen=True)
class Evidence:
    """One chunk that was found."""

    id: str
    text: str
    kind: str = "traffic"
    distance: float | None = None
    metadata: dict[str, object] = field(default_factory=dict)


def trace(find: Callable[[Filters], list[Evidence]] | None, filters: Filters, computed: bool = False) -> tuple[list[Evidence], dict[str, object]]:
    """Evidence and a record of how it came: status ok, no_hits, disabled, error or computed_only, milliseconds, filters.

    computed: the answer is computed and needs no evidence.
    """
    if computed or find is None:
        return [], {"status": "computed_only" if computed else "disabled", "latency_ms": 0.0, "filters": filters.active()}
    began = time.perf_counter()
    try:
        found = find(filters)
        status, reason = ("ok" if found else "no_hits"), None
    except (PySparkException, Py4JError, OSError) as failed:  # a store that fails leaves a question without evidence; errors in code are raised
        found, status, reason = [], "error", str(failed)
    return found, {
        "status": status, "reason": reason, "latency_ms": (time.perf_counter() - began) * 1000, "filters": filters.active(),
        "hits": len(found),
    }


def line(e: Evidence) -> str:
    """One line for a chunk: where it is from, and its beginning."""
    m = e.metadata
    if e.kind == "traffic":
        return " | ".join([f"[traffic] {e.id}", *(f"{k} {m[k]}" for k in ("mmsi", "port", "date") if m.get(k) is not None), e.text[:80]])
    source = " ".join(str(x) for x in (m.get("source_file", "unknown"), m.get("source_url") or f"p.{m.get('page', '?')}"))
    return f'[docs] {e.id} | {source} | "{" ".join(e.text[:180].split())}"'


def refuses(evidence: list[Evidence], strict: bool = True, limit: float = STRICT) -> bool:
    """Whether the evidence is too thin: none, or, if strict, none with a distance within the limit."""
    near = [e.distance for e in evidence if e.distance is not None]
    return not evidence or (strict and (not near or min(near) > limit))


def answer(
    question: str, evidence: list[Evidence], aggregate: dict[str, object] | None = None, strict: bool = True,
    limit: float = STRICT, write: Callable[[str, list[Evidence]], str] | None = None,
) -> dict[str, object]:
    """answer, lines, caveats, refused: from an aggregate (kind, count, ids) if there is one, else from evidence that is near
    enough. write: a model's plug; without it the nearest chunks are quoted."""
    if aggregate is not None:
        what = "sudden jumps of position" if aggregate.get("kind") == "jumps" else "matching positions"
        return {
            "answer": f"There are {aggregate.get('count', 0)} {what}.",
            "lines": [f"[count] {i}" for i in list(aggregate.get("ids", []))[:10]], "caveats": ["Counted over all rows."],
            "refused": False,
        }
    if refuses(evidence, strict, limit):
        return {"answer": REFUSAL, "lines": [], "caveats": ["Nothing near enough was found."], "refused": True}
    nearest = sorted(evidence, key=lambda e: (e.distance is None, e.distance or 0.0, e.id))
    said = write(question, nearest) if write else " ".join(e.text for e in nearest[:3])
    return {"answer": said, "lines": [line(e) for e in evidence], "caveats": ["Only what was found is used."], "refused": False}


def evidence_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """What the chunks that were found say together, for each of keys: how many, how many flagged, the port that most are of (ties by name),
    the first and last date, and the nearest distance. found: port, date, anomaly and distance, a row a chunk."""
    ports = found.groupBy(*keys, "port").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("anomaly", F.lit(False))).alias("flagged"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.min("distance").alias("nearest"),
    )
    usual = F.min_by("port", F.when(F.col("port").isNotNull(), F.struct(-F.col("n"), F.col("port"))))
    return ports.groupBy(*keys).agg(
        F.sum("n").alias("chunks"), F.sum("flagged").alias("flagged"), usual.alias("port"), F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"), F.min("nearest").alias("nearest"),
    )


def query_hit(port: Column, date: Column, anomaly: Column) -> Column:
    """Whether a chunk (port, locode, date, anomaly) is what a case expects; null in a case asks for nothing."""
    tight = lambda c: F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    there = (tight(F.col("port")) == tight(port)) | (tight(F.col("locode")) == tight(port)) | F.contains(tight(F.col("port")), tight(port))
    day = F.left(F.col("date").cast("string"), F.lit(10)) == F.left(date.cast("string"), F.lit(10))
    flag = F.coalesce("anomaly", F.lit(False)) == anomaly
    none = lambda c, t: c.isNull() | F.coalesce(t, F.lit(False))
    return (none(port, there) | (tight(port) == "")) & none(date, day) & none(anomaly, flag)


def evaluation(found: DataFrame, keys: list[str], hit: Column, latency: str = "latency_ms", ungrounded: str = "ungrounded") -> DataFrame:
    """hit_rate, mean latency and rate of ungrounded answers over the queries of each of keys.

    found: a row a result, with the query's latency and flag; a query without results has one row of nulls.
    """
    each = found.groupBy(*keys, "query_id").agg(
        F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"), F.max(latency).alias("ms"),
        F.bool_or(F.coalesce(ungrounded, F.lit(False))).alias("bad"),
    )
    share = lambda c: F.avg(F.col(c).cast("double"))
    return each.groupBy(*keys).agg(
        share("hit").alias("hit_rate"), F.avg("ms").alias("mean_latency_ms"), share("bad").alias("ungrounded_rate"),
        F.count("*").alias("queries"),
    )
