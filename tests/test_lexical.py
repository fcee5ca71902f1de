"""Lexical retrieval against the score of every pair."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical


def brute(docs, queries, k):
    texts = defaultdict(list)
    for i, t in docs:
        if i is not None:
            texts[i] += re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    mean = sum(map(len, texts.values())) / len(texts)
    df = Counter(w for ws in texts.values() for w in set(ws))
    out = {}
    for q, t in queries:
        scores = {}
        for i, ws in texts.items():
            tf = Counter(ws)
            own = [w for w in set(re.findall("[a-z0-9]+", (t or "").lower())) if tf[w]]
            if own:
                scores[i] = sum(
                    math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in own
                )
        for rank, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 5), i))[:k], 1):
            out[q, rank] = (i, round(scores[i], 4))
    return out


@pytest.fixture(scope="module")
def docs():
    """Words by a steep law, one in every text; copies, an empty and a null text, rows that share an id, a null id."""
    rng = random.Random(9)
    out = [(i, "The " + " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 60)))) for i in range(400)]
    return out + [(400, out[0][1]), (401, ""), (402, None), (403, "w1 w2"), (403, "w1 w3"), (None, "w1 w1")]


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_top_k_is_exact(spark, tmp_path, docs, k):
    rng = random.Random(k)
    queries = [(q, " ".join([*(f"W{rng.randint(1, 60)}" for _ in range(rng.randint(1, 9))), "the"])) for q in range(40)] + [(90, "unknown"), (91, None), (92, "the")]
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), str(tmp_path / "i"))
    got = index.search(spark.createDataFrame(queries, "query_id long, text string"), k)
    found = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 4)) for r in got.collect()}
    want = brute(docs, queries, k)
    assert found.keys() == want.keys() and {x: v[0] for x, v in found.items()} == {x: v[0] for x, v in want.items()}
    assert all(abs(found[x][1] - want[x][1]) <= 2e-4 for x in want)


def test_common_words_are_left_aside(spark, tmp_path, docs, monkeypatch):
    """With a rare word in the query, the word that all texts have brings no candidates."""
    index = lexical.LexicalIndex.build(spark.createDataFrame([*docs, (1000, "rare rare the"), (1001, "rare the"), (1002, "the rare x")], "doc_id long, text string"), str(tmp_path / "i"))
    seen = []
    monkeypatch.setattr(lexical, "written", lambda df, name, f=lexical.written: seen.append((name, f(df, name))) or seen[-1][1])
    got = index.search(spark.createDataFrame([(1, "the rare")], "query_id long, text string"), 3)
    assert {r["doc_id"] for r in got.collect()} == {1000, 1001, 1002}
    assert dict(seen)["candidates"].count() == 3


def test_few_documents_of_common_words_are_candidates(spark, tmp_path, monkeypatch):
    """Every document has most of the query's words, but few can reach the score of those that have all."""
    rng = random.Random(3)
    known = [f"c{i}" for i in range(40)]
    docs = [(i, " ".join(rng.sample(known, 20))) for i in range(400)] + [(900 + i, " ".join(known[:20])) for i in range(2)]
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    seen = []
    monkeypatch.setattr(lexical, "written", lambda df, name, f=lexical.written: seen.append((name, f(df, name))) or seen[-1][1])
    queries = [(1, " ".join(known[:20]))]
    got = index.search(spark.createDataFrame(queries, "query_id long, text string"), 2)
    assert {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 4)) for r in got.collect()} == brute(docs, queries, 2)
    assert dict(seen)["candidates"].count() <= 100


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = lexical.LexicalIndex.build(none, str(tmp_path / "i"))
    assert index.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).isEmpty()
    some = lexical.LexicalIndex.build(none.union(spark.createDataFrame([(1, "a")], "doc_id long, text string")).withColumn("term", F.lit(1)), str(tmp_path / "j"))
    assert some.search(none.withColumnRenamed("doc_id", "query_id"), 3).isEmpty()
