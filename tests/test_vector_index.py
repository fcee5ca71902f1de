"""Vector indexes: recall against exact search, probing under filters, versions against full rebuilds."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidemark.operators import evidence, retrieval, vector_index

SCHEMA = "vec_id long, embedding array<float>, label int, kind string"


@pytest.fixture(scope="module")
def rows(spark):
    """Clusters of unequal size, one of them with half of all rows; copies, and rows without a vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    out = []
    for i in range(3000):
        c = 0 if i % 2 else int(rng.integers(20))
        out.append((i, (centres[c] + 0.4 * rng.normal(size=16)).tolist(), c, "rare" if i % 500 == 7 else "usual"))
    out += [(3000, out[0][1], 0, "usual"), (3001, None, 1, "usual"), (3002, [0.0] * 16, 2, "usual")]
    return spark.createDataFrame(out, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return vector_index.CellIndex.build(rows, str(tmp_path_factory.mktemp("index") / "i"), cells=24)


def queries_of(rows):
    return rows.filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")


def test_recall_and_what_is_scanned(rows, index):
    exact = retrieval.top_k(queries_of(rows), rows, 10)
    found = index.search(queries_of(rows), 10)
    assert vector_index.recall(found, exact) >= 0.9
    most = found.agg(F.max("scanned")).first()[0]
    assert most < 0.8 * 3002 and index.share < 0.5
    assert found.groupBy("query_id").count().filter("count != 10").isEmpty()


@pytest.mark.parametrize("folder", [DATA, DATA.replace("sf0.001", "sf0.1")])
def test_recall_over_the_given_vectors(spark, tmp_path, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    index = vector_index.CellIndex.build(rows, str(tmp_path / "i"))
    assert vector_index.recall(index.search(queries_of(rows), 5), retrieval.top_k(queries_of(rows), rows, 5)) >= 0.9


def test_all_cells_are_exact_search(rows, index):
    exact = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(queries_of(rows), rows, 7).collect()}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search(queries_of(rows), 7, share=1).collect()} == exact
    opened = vector_index.CellIndex.open(index.spark, index.folder)
    assert np.allclose(opened.centroids, index.centroids) and opened.share == index.share
    assert opened.rows().filter("embedding is null").isEmpty() and opened.rows().count() == 3002


def test_filters_widen_the_probing(rows, index):
    """Six rows meet the filter; each query finds all of them, however far their cells are."""
    found = index.search(queries_of(rows), 6, F.col("kind") == "rare")
    assert found.groupBy("query_id").count().filter("count != 6").isEmpty()
    assert {r["vec_id"] for r in found.select("vec_id").distinct().collect()} == {i for i in range(3000) if i % 500 == 7}
    assert index.search(queries_of(rows), 5, F.col("kind") == "none").isEmpty()


def test_blocks_of_queries(rows, index, monkeypatch):
    found = lambda: {(r["query_id"], r["rank"], r["vec_id"], r["scanned"], round(r["distance"], 9)) for r in index.search(queries_of(rows), 3).collect()}
    want = found()
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    assert found() == want


def test_an_index_of_nothing(spark, rows, tmp_path):
    index = vector_index.CellIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert index.search(queries_of(rows), 3).isEmpty()


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", t, "p") for i, t in texts.items()], "id string, text string, port string").repartition(3)


def test_versions(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["quay", "berth", "crane", "tug"]) for _ in range(9)) + f" {i}" for i in range(200)}
    index = vector_index.VersionedIndex(spark, str(tmp_path / "i"), evidence.embedding)
    assert index.build(chunks(spark, texts)) == vector_index.Built(1, 200, 0, 0)
    assert index.build(chunks(spark, texts)) == vector_index.Built(2, 0, 200, 0)
    later = {i: t + " changed" if i % 10 == 0 else t for i, t in texts.items() if i % 40 != 1} | {500: "new"}
    assert index.build(chunks(spark, later)) == vector_index.Built(3, 21, 175, 5)
    fresh = vector_index.VersionedIndex(spark, str(tmp_path / "whole"), evidence.embedding)
    fresh.build(chunks(spark, later))
    table = lambda df: sorted(map(repr, df.select("id", "text", "port", "embedding").collect()))
    assert table(index.read()) == table(fresh.read())
    assert table(index.read(1)) == table(index.read(2)) and index.read(1).count() == 200  # a pinned version stays
    pinned = index.read(3)
    assert index.compact() == vector_index.Built(4, 0, 196, 0) and index.read().select("_part").distinct().count() == 1
    assert table(pinned) == table(index.read()) == table(fresh.read())
    assert index.prune(1) == 3 and sorted(index.versions()) == [4] and table(index.read()) == table(fresh.read())
    assert len(list((tmp_path / "i").glob("vectors-*"))) == 1


def test_a_build_that_dies_makes_no_version(spark, tmp_path):
    index = vector_index.VersionedIndex(spark, str(tmp_path), evidence.embedding)
    index.build(chunks(spark, {1: "a", 2: "b"}))

    class Dies(Exception):
        pass

    def embed(text):
        raise Dies

    broken = vector_index.VersionedIndex(spark, str(tmp_path), embed)
    with pytest.raises(Dies):
        broken.build(chunks(spark, {1: "a", 2: "c"}))
    assert sorted(index.versions()) == [1] and index.read().count() == 2
    assert index.build(chunks(spark, {1: "a", 2: "c"})) == vector_index.Built(2, 1, 1, 0)


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 1), (None, "z", 1), ("b", None, None)], "id string, text string, port int")
    index = vector_index.VersionedIndex(spark, str(tmp_path), evidence.embedding)
    assert index.build(rows) == vector_index.Built(1, 2, 0, 0) and index.read().count() == 2
    assert index.build(rows).embedded == 0


def test_a_build_shuffles_whole_rows_once(spark, tmp_path):
    """Where nothing is broadcast, texts are dealt by id, and not again for rows of one id."""
    rng = random.Random(2)
    rows = [(i, f"{rng.getrandbits(8000):x}") for i in range(1000)]
    index = vector_index.VersionedIndex(spark, str(tmp_path), lambda t: evidence.embedding(t, 8))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("one build", "one build")
    try:
        index.build(spark.createDataFrame(rows, "id long, text string"))
    finally:
        spark.sparkContext.setJobGroup("others", "others")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("one build") for s in tracker.getJobInfo(j).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < shuffled < 1.5 * sum(len(t) for _, t in rows)
    assert index.read().count() == 1000


def test_vectors_of_words(spark, monkeypatch):
    """Against a count of each word's slot, for odd texts, in slices of any size and with few remembered words."""
    texts = [None, "", " -- ", "Quay 7, quay", "İx K 한9", "a" * 40 + " b", "b " * 500, "\U00010400z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    got = {r["i"]: r["v"] for r in rows.select("i", evidence.embedding(F.col("text"), 8).alias("v")).collect()}
    want = []
    for text in texts:
        counts = np.zeros(8)
        for word in re.findall("[a-z0-9]+", (text or "").lower()):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 8] += 1
        want.append((counts / (np.sqrt((counts**2).sum()) or 1)).tolist())
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(evidence, "REMEMBERED", 1)
    for size in (1, 30, 1 << 20):
        monkeypatch.setattr(evidence, "SLICE_BYTES", size)
        assert evidence.hashed(pa.array(["skipped", *[(t or "").lower() for t in texts]])[1:], 8).to_pylist() == want
    assert evidence.hashed(pa.array([], pa.string()), 8).to_pylist() == []
