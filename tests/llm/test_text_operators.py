"""License scans, byte-pair encoding, media files: brute force and exact round trips without Spark."""

from __future__ import annotations

import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, license_scan, media, shingles


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf, piece", [(7, 9), (2048, 256)])
def test_bpe_equals_the_library(codec, leaf, piece):
    codec = bpe.Codec(codec.ranks, public_tokenizers.PATTERN, leaf=leaf, merge_leaf=piece)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "b", "'", "r", "e", " ", "  ", "\n", "\t", "1", "é", "中", "!", "'s", "'re", " the", "ing", "　", "👍", "'l", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdetingrs") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["", " " * 5000, "a" * 20_000, "ab " * 5000, "'" * 999, "中" * 3000]
    for t in texts:
        ids = codec.encode(t)
        assert ids == whole.encode_ordinary(t)
        assert codec.decode(ids).decode() == t


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 40_000])
@pytest.mark.parametrize("kind", ["text", "any"])
def test_media_round_trip(n, kind):
    raw = bytes(97 + i % 26 for i in range(n)) if kind == "text" else os.urandom(n)
    payload = media.pad(raw)
    assert len(payload) % 192 == 0 and len(payload) >= 192
    stored = media.encode_jpeg(payload)
    assert media.features(stored)[0] == payload
    got = media.decode([stored])[0]
    assert (media.TO_VALUE[np.frombuffer(payload, np.uint8)] == got.coefficients.ravel()[: len(payload)]).all()


def test_media_reads_other_tables():
    """A grey 8 x 8 file with the usual kind of table: one DC code, end of block."""
    dht = media._dht(0x00, {0: 2, 3: 2}) + media._dht(0x10, {0: 2, 1: 2})
    frame = media._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    codes = media.canonical({0: 2, 3: 2})
    bits = f"{codes[3][0]:02b}" + "101" + f"{media.canonical({0: 2, 1: 2})[0][0]:02b}"
    scan = int(bits.ljust(8, "1"), 2).to_bytes(1, "big")
    data = media._HEAD + frame + dht + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    got = media.decode([data])[0]
    assert got.coefficients[0, 0] == 5
    assert media.thumbnail(got).tolist() == [[133]]


def test_media_rejects_others():
    with pytest.raises(ValueError):
        media.parse(b"GIF89a")


def _index():
    templates = license_scan.BASE + license_scan.EXTRA
    df = {w: 1 for t in templates for w in t.notice.encode().split()}
    return license_scan.Index(templates, df)


def test_base_places_against_brute_force():
    rng, index = random.Random(5), _index()
    vocabulary = [b"cc", b"by", b"general", b"public", b"license", b"all", b"rights", b"reserved", b"x"]
    phrases = {"cc-by": [b"cc", b"by"], "gpl": [b"general", b"public", b"license"], "reserved": [b"all", b"rights", b"reserved"]}
    for _ in range(500):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        want = sorted((i, i + len(p), k) for k, p in phrases.items() for i in range(len(ws)) if ws[i : i + len(p)] == p)
        assert index.scan(ws)[0] == want


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("x Released under the MIT License y", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
    ("Licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc"}),
    ("all rights are reserved", set()), ("", set()), ("license apache version", set()),
])
def test_labels(text, labels):
    assert {x[2] for x in _index().scan(license_scan.words(text))[1]} == labels


def test_words():
    assert license_scan.words("Ab_c\x00é9!Ö") == ["ab".encode(), b"c", "é9".encode(), "Ö".encode()]


def test_shingles_against_word_tuples():
    rng = random.Random(9)
    for _ in range(300):
        words = [rng.choice("ab c de f".split()) for _ in range(rng.randint(0, 30))]
        text = "".join(w.upper() + rng.choice([" ", "\n", "  ", "\t"]) for w in words)
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingles.shingle_set(text)) == len(want)
    a, b = shingles.shingle_set("a b c d e f"), shingles.shingle_set("x a b c d e")
    assert len(np.intersect1d(a, b)) == 1
    assert len(shingles.shingle_set("a b")) == 1 and not np.intersect1d(shingles.shingle_set("a b"), shingles.shingle_set("ab")).size
