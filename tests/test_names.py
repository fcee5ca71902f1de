"""Name matching by bigrams against comparing all names with all."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from tidemark.operators import names as matching


def generated(n, seed):
    rng = random.Random(seed)
    parts = ["port", "of", "saint", "klai", "ped", "riga", "gdan", "sk", "goth", "en", "burg", "á", "ö", "x", "-", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def spoiled(name, rng):
    own = list(name)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(own) + 1)
        if rng.random() < 0.5 and own:
            own.pop(at - 1)
        else:
            own.insert(at, rng.choice("abÖ "))
    return "".join(own).upper() if rng.random() < 0.2 else "".join(own)


def best(asked, known, least):
    found = [(SequenceMatcher(None, (asked or "").lower(), k.lower()).ratio(), k) for k in known if k is not None]
    ratio, name = max(found, default=(0.0, None))
    return name if ratio >= least else None


@pytest.mark.parametrize("least", [0.8, 0.7, 0.95, 1.0])
def test_equals_comparing_all_with_all(spark, least):
    rng = random.Random(8)
    known = [*generated(400, 1), None, "", "a", "aaaa", "aaaaa", "AAAAA", "ab" * 150, "ba" * 150 + "c"]
    asked = [*(spoiled(rng.choice(known) or "", rng) for _ in range(400)), *generated(200, 2), None, "", "b", "aaa", "aa", "ab" * 149, "ab" * 140 + "z"]
    got = matching.closest(spark.createDataFrame([(a, "x") for a in asked], "q string, match string"), spark.createDataFrame([(k, 1) for k in known], "port string, q int"), "q", "port", least)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["q", "match"] and len(rows) == len(set(asked))
    assert dict(rows) == {a: best(a, known, least) for a in set(asked)}


def test_few_pairs_are_compared(spark):
    known = sorted({k.lower() for k in generated(600, 1) if k})
    frame = spark.createDataFrame([(k,) for k in known], "name string").withColumn("grams", matching.bigrams(matching.F.col("name")))
    pairs = {tuple(r) for r in matching.candidates(frame, frame, 0.8).collect()}
    alike = {(a, b) for a in known for b in known if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert alike <= pairs and len(pairs) < len(known) ** 2 / 10


def test_no_catalog_and_bounds(spark):
    one, none = spark.createDataFrame([("a",)], "q string"), spark.createDataFrame([], "port string")
    assert [tuple(r) for r in matching.closest(one, none, "q", "port").collect()] == [("a", None)]
    assert matching.closest(one.filter("q = 'b'"), none, "q", "port").count() == 0
    with pytest.raises(ValueError, match="least"):
        matching.closest(one, none, "q", "port", 0.6)
