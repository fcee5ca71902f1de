"""Packing: ids against the library, sequences against their definition, best fit against a plain search."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_queries import documents
from tidemark.llm import packing, queries
from tidemark.llm.common import written

PATH = public_tokenizers.path(queries.PACKED)
ODD = ["", "  ", "á b", "x y z", "<|endoftext|> hi<|startoftext|>", "ΟΔΟΣ ΣΑΣ İstanbul", "\x1c a\x1fb ́c", "👍🏽'll don't　x 1234", "日本語", "a\x85b", "'s 's't", " ̈ x", "ﬁ ẞ ſ K", "क्षि", "w" * 5000]


def ids_of(texts):
    return [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, size):
    """Sequences are gapless from 0 and hold at most size."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_op13(spark, tmp_path):
    docs = [(r[0], r[1]) for r in documents()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id")] * 2 + [(2000, "a " * 2047), (2001, "a " * 2048), (2002, "a " * 4095)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_packing(spark, str(tmp_path)).collect()
    want = []
    for (doc_id, _), ids in zip(docs, ids_of([d[1] for d in docs]), strict=True):
        for k in range(0, len(ids), 2048):
            own = np.array(ids[k : k + 2048], "<u4")
            want.append((doc_id, k // 2048, k, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert check(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1


@pytest.mark.parametrize("window,words", [(1, 1), (7, 5), (1 << 20, 1 << 19)])
def test_words_give_the_library_s_ids(monkeypatch, window, words):
    monkeypatch.setattr(packing, "WINDOW", window)
    monkeypatch.setattr(packing, "WORDS", words)
    encode = packing.Words(PATH)
    texts = ODD + [r[1] for r in documents() if r[1] and len(r[1]) < 3000][:40]
    for _ in range(2):
        assert [[*np.frombuffer(b"".join(encode(t)), "<u4").tolist(), 0] for t in texts] == ids_of(texts)
    whole = packing.Words(public_tokenizers.path("byte_bpe_50k.json"), split=False)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(np.frombuffer(b"".join(whole(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def slow_best_fit(lengths, size):
    fills = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(fills) if f + length <= size]
        if fits:
            best = max(fits, key=lambda i: fills[i])
            fills[best] += length
        else:
            fills.append(length)
    return sorted(fills)


def test_best_fit():
    rng = random.Random(2)
    for size in (1, 10, 64, 2048):
        lengths = [rng.randint(1, rng.choice([size, max(1, size // 5)])) for _ in range(300)]
        bins, places, fills = packing.best_fit(np.array(lengths), size)
        assert sorted(fills.tolist()) == slow_best_fit(lengths, size)
        for b in set(bins.tolist()):
            own = sorted((int(places[i]), lengths[i]) for i in np.flatnonzero(bins == b))
            assert [p for p, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
    assert [len(x) for x in packing.best_fit(np.array([], np.int64), 8)] == [0, 0, 0]


@pytest.mark.parametrize("items,parts", [(2, 7), (5, 3), (40, 9), (1 << 16, 12)])
def test_underfull_bins_are_merged_up_the_tree(spark, items, parts):
    """Whatever the groups, sequences are whole; with groups that hold all, they are few."""
    rng = random.Random(items)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 100]) for _ in range(700)]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, extra string").repartition(parts)
    got = packing.pack(written(rows, "pieces"), 100, 0, items).collect()
    assert sorted((r["doc_id"], r["length"], r["extra"]) for r in got) == [(i, n, "x") for i, n in enumerate(lengths)]
    made = check(got, 100)
    if items > 700:
        assert made <= -(-sum(lengths) // 100) + 2
    assert made <= len(slow_best_fit(lengths, 100)) * (2 if items < 10 else 1.1)


def test_items_that_cannot_be_merged_end_the_rounds(spark):
    rows = written(spark.createDataFrame([(i, 60) for i in range(500)], "doc_id long, length long").repartition(8), "pieces")
    got = packing.pack(rows, 100, 4, 10).collect()
    assert check(got, 100) == 500


def test_sequences(spark):
    docs = [(i, f"word{i} and more " * (i % 7)) for i in range(60)] + [(60, None)]
    pieces = written(packing.token_pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), PATH, end_id=9, size=64, ids=True), "pieces")
    out = packing.sequences(packing.pack(pieces, 64)).collect()
    want = {d: [*e[:-1], 9] for (d, _), e in zip(docs, ids_of([t for _, t in docs]), strict=True)}
    seen = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["n_tokens"] <= 64
        for d, a, b in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], len(ids)], strict=True):
            seen[d].append(ids[a:b])
    assert set(seen) == set(want)
    assert all(sorted(seen[d]) == sorted(want[d][k : k + 64] for k in range(0, len(want[d]), 64)) for d in want)
