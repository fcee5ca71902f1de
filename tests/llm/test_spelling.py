"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_queries import DOCS, documents
from tidemark.llm import queries, spelling
from tidemark.llm.common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    """By trying every edit of the longer word."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def words_of(docs):
    found = Counter()
    for row in docs:
        for run in RUN.findall(row[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op11(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = [tuple(r) for r in documents()]
    docs += [(1000 + i, " ".join(rng.choice(base) + rng.choice(["", "", "s", "A"]) for _ in range(400)), "en", "s0", 1, 0.5, 1, 2, 3, 4) for i in range(40)]
    docs += [(None, "nothing Nothing NOTHING nothings nothinG nothing " * 3, None, None, 1, 0.5, 1, 2, 3, 4)] * 2
    path = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    counts = words_of(docs)
    want = brute(counts)
    assert len(want) > 300 and sum(v[0] is not None for v in want.values()) > 5
    assert as_dict(queries.op11_spelling(spark, path)) == want


@pytest.mark.parametrize("size", [1, 3, 256])
def test_lists_of_any_size_give_all_pairs(spark, size):
    """Words of few letters share nearly all grams; lists are split until only the edited place is open."""
    rng = random.Random(size)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(220)} | {"a" * n for n in (6, 7, 8, 40, 41)} | {"ab" * 300, "ab" * 299 + "a", "ab" * 150 + "ba" * 150}
    table = written(spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long"), "words")
    got = [tuple(sorted((r["word"], r["near"]))) for r in spelling.near_pairs(table, size).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_long_chains_of_forms(spark):
    """Each word is five times as frequent as the one before; ties go to the least word."""
    words = ["a" * k + "b" * (12 - k) for k in range(13)]
    counts = {w: 5 * 5**k for k, w in enumerate(words)} | {"b" * 11 + "c": 25}
    table = written(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    got = as_dict(spelling.variants(table, spelling.near_pairs(table)))
    assert got == brute(counts)
    assert got[words[0]][1] == words[-1]


def test_lists_are_named_alike():
    """The first k grams that two words one edit apart share name one list of both."""
    rng = random.Random(3)
    counts = np.array([rng.randint(0, 9) for _ in range(spelling.COUNTERS)])
    for _ in range(2000):
        x = "".join(rng.choice("abc") for _ in range(rng.randint(6, 11)))
        at = rng.randrange(len(x))
        y = x[:at] + rng.choice(["", "z"]) + x[at + 1 :]
        if len(y) < 6 or x == y:
            continue
        for k in (1, 2, 3):
            names = []
            for w in (x, y):
                chosen = [()]
                for _ in range(k):
                    chosen = [c for own in chosen for c in spelling.longer_lists(w, spelling.ranked(w, counts), len(x), own)]
                assert all(spelling.unpacked(spelling.packed(c)) == c for c in chosen)
                names.append({spelling.list_name(w, spelling.ranked(w, counts), len(x), c) for c in chosen})
            assert names[0] & names[1]


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError, match="code points"):
        spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), min_chars=4)


def test_counts_pass_the_bound_of_a_task(spark, monkeypatch):
    """A task that passes its counts on early counts the same."""
    monkeypatch.setattr(spelling, "HELD", 1)
    docs = [(i, "abcdef bcdefg " * 3) for i in range(50)] + [(None, None), (0, "")]
    got = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["word"]: r["n"] for r in got.collect()} == {"abcdef": 150, "bcdefg": 150}
