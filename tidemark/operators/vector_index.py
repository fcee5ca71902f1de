"""Vector indexes: an inverted file of cells with filter-aware probing, and versions that embed only what changed.

CellIndex. Centroids are trained by spherical k-means on a bounded sample; every row goes to its nearest centroid's cell, and
cells are partitions of a Parquet table, so a search reads the cells that it probes and no others. How many a query
probes follows from the filter: rows that meet it are counted by cell (a scan of the filter's columns alone), and cells are
taken in order of nearness until the expected rows are there. The share of cells that is probed at least is measured when the
index is built, so that RECALL of the neighbours within the sample would be found: little where vectors form clusters, much where they
don't. What is probed is ranked exactly; probing all cells is exact search.

VersionedIndex. A manifest says of each chunk the hash of its content and the table with its vector. A build embeds chunks
that are new or whose hash differs, and writes the next manifest; vanished chunks are in it no more. A version is an
empty file whose name is the manifest's, so a version is there whole or not at all, and a reader that pins one isn't touched by
later builds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import delete, written
from .retrieval import BLOCK, _unit, keep_ranked

#: Rows of the training sample for each cell, rounds of k-means, rows of a cell that are aimed at, most cells.
SAMPLE, ROUNDS, CELL_ROWS, MOST_CELLS = 64, 8, 4096, 4096
#: Recall that the share of probed cells is measured for, with so many queries and neighbours of each.
RECALL, MEASURED, NEIGHBOURS = 0.95, 256, 10
#: Rows for each of k that have to be expected in a query's cells.
EXPECTED = 16


def trained(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length of the sample's rows, from the first rows that differ; an empty cell takes the row farthest from its own."""
    rows = _unit(sample.astype(np.float64))
    centroids = np.unique(rows, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(cells, len(centroids))).astype(int)]
    for _ in range(rounds):
        near = rows @ centroids.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[lost] = rows[np.argsort(best, kind="stable")[: len(lost)]]
        centroids = _unit(sums)
    return centroids


def measured_share(sample: np.ndarray, centroids: np.ndarray, wanted: float = RECALL) -> float:
    """The share of cells, in order of nearness, that holds the wanted share of the nearest rows of the sample to some of its rows.

    Neighbours in a sample are farther than those among all rows, so this errs on the side of more cells.
    """
    rows = _unit(sample.astype(np.float64))
    some = np.unique(np.linspace(0, len(rows) - 1, min(MEASURED, len(rows))).astype(int))
    near = np.argsort(-(rows[some] @ rows.T), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
    ranks = np.argsort(np.argsort(-(rows[some] @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(ranks, (rows @ centroids.T).argmax(axis=1)[near], axis=1)
    return (float(np.quantile(at, wanted, method="higher")) + 1) / len(centroids) if at.size else 1.0


@dataclass(frozen=True)
class CellIndex:
    """A built index: its folder, the columns of ids and vectors, its centroids (at most MOST_CELLS), the share of them to probe."""

    spark: SparkSession
    folder: str
    item_id: str
    vector: str
    centroids: np.ndarray
    share: float
    schema: StructType

    @classmethod
    def build(cls, rows: DataFrame, folder: str, item_id: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> CellIndex:
        """Write rows by cell. The sample is the rows least by a hash of their id, SAMPLE for each cell. Rows without a vector are left out."""
        spark = rows.sparkSession
        rows = rows.filter(F.col(vector).isNotNull())
        n = rows.count()
        cells = cells or int(min(MOST_CELLS, max(1, n // CELL_ROWS, n**0.5 / 2)))
        sample = rows.orderBy(F.xxhash64(item_id), item_id).limit(SAMPLE * cells).select(vector).collect()
        vectors = np.array([r[0] for r in sample])
        centroids = trained(vectors, cells) if sample else np.zeros((0, 0))
        share = measured_share(vectors, centroids) if sample else 1.0
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _unit(np.stack(batch.column(vector).to_numpy(zero_copy_only=False)).astype(np.float64)) @ centroids.T
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(axis=1), pa.int32())], names=[*names, "cell"])

        # ranges of ids within cells, so that a cell with most rows is several files
        dealt = rows.mapInArrow(run, schema).repartitionByRange("cell", item_id)
        dealt.write.partitionBy("cell").parquet(f"{folder}/cells")
        about = {"item_id": item_id, "vector": vector, "centroids": centroids.tolist(), "share": share, "schema": json.loads(dealt.schema.json())}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")
        return cls(spark, folder, item_id, vector, centroids, share, dealt.schema)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CellIndex:
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(spark, folder, about["item_id"], about["vector"], np.array(about["centroids"]), about["share"], StructType.fromJson(about["schema"]))

    def rows(self, condition: Column | None = None) -> DataFrame:
        own = self.spark.read.schema(self.schema).parquet(f"{self.folder}/cells")
        return own if condition is None else own.filter(condition)

    def search(
        self, queries: DataFrame, k: int, condition: Column | None = None, share: float | None = None, expected: int = EXPECTED, query_id: str = "query_id",
    ) -> DataFrame:
        """(query_id, rank, item, distance, scanned): the k nearest of the probed cells; scanned: rows that the query was compared with.

        share: of the cells, how many are probed at least (else as measured); 1 is exact search. Queries travel in blocks of BLOCK.
        """
        counts = {r["cell"]: r["n"] for r in self.rows(condition).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        blocks = max(1, -(-queries.count() // BLOCK))
        keyed = queries.withColumn("_block", F.pmod(F.xxhash64(query_id), F.lit(blocks)))
        found = []
        for b in range(blocks):
            own = keyed.filter(F.col("_block") == b).select(F.col(query_id).cast("long"), self.vector).collect()
            found.append(self._block([r[0] for r in own], np.array([r[1] for r in own], np.float64), counts, k, condition, self.share if share is None else share, expected, query_id))
            if blocks > 1:
                found[-1] = written(found[-1], "probed")
        return reduce(DataFrame.unionByName, found)

    def probes(self, wanted: np.ndarray, counts: dict[int, int], k: int, share: float, expected: int) -> list[list[int]]:
        """Each query's cells: at least the share of all, and so many that expected * k rows that meet the filter are in them."""
        if not len(wanted) or not len(self.centroids):
            return [[] for _ in wanted]
        order = np.argsort(-(wanted @ self.centroids.T), axis=1, kind="stable")
        there = np.cumsum(np.array([counts.get(c, 0) for c in range(len(self.centroids))])[order], axis=1)
        enough = (there < expected * k).sum(axis=1) + 1
        least = int(np.ceil(share * len(self.centroids)))
        return [[c for c in line[: max(least, e)].tolist() if counts.get(c)] for line, e in zip(order, enough, strict=True)]

    def _block(self, names: list[int], vectors: np.ndarray, counts: dict[int, int], k: int, condition: Column | None, share: float, expected: int, query_id: str) -> DataFrame:
        wanted = _unit(vectors) if len(vectors) else vectors
        probes = self.probes(wanted, counts, k, share, expected)
        asking: dict[int, list[int]] = {}
        for q, cells in enumerate(probes):
            for c in cells:
                asking.setdefault(c, []).append(q)
        scanned = {n: sum(counts[c] for c in cells) for n, cells in zip(names, probes, strict=True)}
        item_id = self.item_id

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                rows = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                for c in np.unique(cells):
                    mine = np.flatnonzero(cells == c)
                    far = 1 - wanted[asking[int(c)]] @ rows[mine].T
                    for q, line in zip(asking[int(c)], far, strict=True):
                        held = best.get(q)
                        near, which = (line, ids[mine]) if held is None else (np.concatenate([held[0], line]), np.concatenate([held[1], ids[mine]]))
                        top = np.lexsort((which, np.round(near, 6)))[:k]
                        best[q] = near[top], which[top]
            # once a task, k rows a query
            for q, (near, which) in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[q]] * len(near), pa.int64()), pa.array(which, pa.int64()), pa.array(near, pa.float64()), pa.array([scanned[names[q]]] * len(near), pa.int64())],
                    names=[query_id, item_id, "distance", "scanned"],
                )

        rows = self.rows(condition).filter(F.col("cell").isin(sorted(asking))).select(F.col(item_id).cast("long"), self.vector, F.col("cell").cast("int"))
        near = rows.mapInArrow(run, f"{query_id} long, {item_id} long, distance double, scanned long")
        ranked = keep_ranked(near, k, query_id, item_id)
        told = self.spark.createDataFrame(list(scanned.items()), f"{query_id} long, scanned long")  # a row a query of the block
        return ranked.join(F.broadcast(told), query_id)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", item_id: str = "vec_id") -> float:
    """The share of the exact results that were found."""
    hits = exact.select(query_id, item_id).join(found.select(query_id, item_id, F.lit(1).alias("hit")), [query_id, item_id], "left")
    return float(hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])


@dataclass(frozen=True)
class Built:
    """What a build did: the version that it made, chunks embedded, kept from the version before, and gone."""

    version: int
    embedded: int
    kept: int
    removed: int


class VersionedIndex:
    """Versions of an index under one folder: vectors-*, manifest-* and, naming the latter, versions/<number>.<manifest>.

    Chunks have an id and a text, and other columns; all of them are hashed, so a change of metadata is a change. Of rows with
    one id the one with the least hash is taken; rows without an id are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], id_col: str = "id"):
        self.spark, self.folder, self.embed, self.id = spark, folder.rstrip("/"), embed, id_col
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: path(f"{self.folder}/{name}")
        self._fs = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, str]:
        """Manifests by version."""
        if not self._fs.exists(self._at("versions")):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return {int(n.split(".", 1)[0]): n.split(".", 1)[1] for n in sorted(names) if not n.startswith((".", "_"))}

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema("id string, hash string, part string").parquet(f"{self.folder}/{self.versions()[version]}")

    def build(self, chunks: DataFrame) -> Built:
        """The next version. A build that dies leaves tables that no version names."""
        known = self.versions()
        last = max(known, default=0)
        key = F.col(self.id).cast("string")
        content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in chunks.columns])), 256)
        own = chunks.filter(F.col(self.id).isNotNull()).withColumn("_id", key)
        hashes = own.groupBy(F.col("_id").alias("id")).agg(F.min(content).alias("hash"), F.count("*").alias("rows"))
        old = self._manifest(last) if known else self.spark.createDataFrame([], "id string, hash string, part string")
        old = old.select("id", F.col("hash").alias("old_hash"), "part")
        tag = uuid.uuid4().hex[:12]
        part = f"vectors-{last + 1:06d}-{tag}"
        both = written(hashes.join(old, "id", "full_outer"), "compared")  # hashes and names alone
        fresh = both.filter("hash is not null and not (hash <=> old_hash)").select(F.col("id").alias("_id"), F.col("hash").alias("_wanted"), F.col("rows").alias("_rows"))
        # a row that is alone with its id isn't hashed again; whole rows are dealt by id, once
        picked = own.join(fresh, "_id").filter((F.col("_rows") == 1) | (content == F.col("_wanted"))).dropDuplicates(["_id"]).select(*chunks.columns)
        picked.withColumn("embedding", self.embed(F.col("text"))).write.parquet(f"{self.folder}/{part}")
        manifest = both.filter("hash is not null").select("id", "hash", F.when(F.expr("hash <=> old_hash"), F.col("part")).otherwise(F.lit(part)).alias("part"))
        manifest.write.parquet(f"{self.folder}/manifest-{tag}")
        n = self._sums(both)
        self._fs.create(self._at(f"versions/{last + 1:06d}.manifest-{tag}"), True).close()
        return Built(last + 1, *n)

    @staticmethod
    def _sums(both: DataFrame) -> tuple[int, int, int]:
        here, same = F.col("hash").isNotNull(), F.col("hash").eqNullSafe(F.col("old_hash"))
        return tuple(both.agg(F.count_if(here & ~same), F.count_if(here & same), F.count_if(~here)).first())

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a version (the newest), with embedding and _part, the table that a vector is from."""
        known = self.versions()
        manifest = self._manifest(max(known) if version is None else version)
        parts = [r["part"] for r in manifest.select("part").distinct().collect()]  # as many as builds since the last compaction
        if not parts:
            raise ValueError("the version has no chunks")
        rows = [self.spark.read.parquet(f"{self.folder}/{p}").withColumn("_part", F.lit(p)) for p in parts]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        named = manifest.select(F.col("id").alias("_id"), F.col("part").alias("_of"))
        return rows.join(named, (F.col(self.id).cast("string") == F.col("_id")) & (F.col("_part") == F.col("_of")), "left_semi")

    def compact(self) -> Built:
        """A version of the same chunks in one table; nothing is embedded anew."""
        last = max(self.versions())
        tag = uuid.uuid4().hex[:12]
        part = f"vectors-{last + 1:06d}-{tag}"
        self.read(last).drop("_part").write.parquet(f"{self.folder}/{part}")
        self._manifest(last).withColumn("part", F.lit(part)).write.parquet(f"{self.folder}/manifest-{tag}")
        self._fs.create(self._at(f"versions/{last + 1:06d}.manifest-{tag}"), True).close()
        return Built(last + 1, 0, self._manifest(last + 1).count(), 0)

    def prune(self, keep: int = 2) -> int:
        """Drop all but the newest versions, and vectors that no version left names; how many versions went."""
        known = self.versions()
        gone, left = sorted(known)[:-keep], sorted(known)[-keep:]
        used = {r["part"] for v in left for r in self._manifest(v).select("part").distinct().collect()}
        for v in gone:
            delete(self.spark, f"{self.folder}/versions/{v:06d}.{known[v]}")
            delete(self.spark, f"{self.folder}/{known[v]}")
        for s in self._fs.listStatus(self._at("")) if gone else []:
            name = s.getPath().getName()
            if name.startswith("vectors-") and name not in used and int(name.split("-")[1]) <= max(left):
                delete(self.spark, f"{self.folder}/{name}")
        return len(gone)
