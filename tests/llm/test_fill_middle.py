"""Fill-in-the-middle against strings cut by code points, words and lines."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_queries import documents
from tidemark.llm import fill_middle as fm
from tidemark.llm import queries

LETTERS = ["a", "é", "中", "👍🏽", " ", "\n", "<", "P", ">", "S", "M", "<P", "word ", "\t\x0b", "\x00"]


def texts(rng, n, most):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def expected(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_op12(spark, folder_of):
    rng = random.Random(8)
    docs = [(r[0], r[1]) for r in documents()]
    docs += [(1000 + i, t) for i, t in enumerate(texts(rng, 300, 60) + texts(rng, 30, 3000))]
    docs += [(None, "no id"), (None, None), (-5, "<P>"), (7_000, "x<S>y"), (7_001, "< P>" * 900), (7_002, "ab" * 300_000 + "é")]
    got = queries.op12_fill_middle(spark, folder_of(docs)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in docs:
        n, form, a, b, out = expected(doc_id, text)
        want.append((doc_id, n, form, a, b, sha(out), sha(text or "")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.fixture
def folder_of(spark, tmp_path):
    def make(docs):
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


UNITS = {"char": r"(?s).", "word": r"[^ \t-\r]+[ \t-\r]+(?=[^ \t-\r])|^[ \t-\r]+(?=[^ \t-\r])", "line": r"[^\n]*\n"}


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_units_and_places(monkeypatch, unit, block):
    """Counts and places of every unit, whatever the blocks; sentinels, too."""
    monkeypatch.setattr(fm, "BLOCK", block)
    own = texts(random.Random(block), 80, 40) + [None, "", " ", "<<P><P<S>"]
    auto = fm.Automaton(unit)
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", *own])[1:]], names=["text"])
    ((_, raw, offsets),) = fm._slices(iter([batch]), "text")
    blocks, starts = fm._blocks(raw, offsets)
    first, before, n, found, _ = auto.scan(blocks, starts)
    for k, t in enumerate(own):
        ends = [len(t[: m.end()].encode()) for m in re.finditer(UNITS[unit], t)] if t else []
        assert n[k] == len(ends)
        assert found[k] == sum((t or "").count(s) for s in ("<P>", "<S>", "<M>"))
        got = [fm._places(auto, blocks, starts, first, before, np.array([k]), np.array([w]))[0] for w in range(len(ends) + 1)]
        assert got == [0, *ends]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_are_restored(spark, unit):
    own = [(i, t) for i, t in enumerate(texts(random.Random(1), 200, 50))]
    df = spark.createDataFrame(own, "key long, body string").repartition(2)
    turned = fm.rewritten(df, unit, rate=100, spm=50, id_col="key", text="body")
    got = fm.restored(turned).collect()
    assert all(r["restored"] == r["body"] for r in got) and len(got) == 200
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        if r["form"] == "psm" and unit == "line":
            prefix = r["rewritten"][3:].split("<S>")[0]
            assert prefix.count("\n") == r["prefix_chars"] and (not prefix or prefix.endswith("\n"))


def test_other_columns_and_clashes(spark):
    """Other columns stay, even those named as the draws are; a column in the way is named."""
    df = spark.createDataFrame([(1, "abc", 5, [1, 2])], "doc_id long, text string, draw_0 int, `odd name` array<int>")
    (row,) = fm.restored(fm.rewritten(df)).collect()
    assert row["draw_0"] == 5 and row["odd name"] == [1, 2] and row["restored"] == "abc"
    with pytest.raises(ValueError, match="form"):
        fm.rewritten(df.withColumnRenamed("draw_0", "Form"))


def test_bytes_that_are_no_utf8(spark):
    """A broken character joins the one after it; the text comes back as it was."""
    df = spark.sql("SELECT id AS doc_id, cast(concat(X'80C3', cast(repeat('a', cast(id AS int)) AS binary), X'E4B8') AS string) AS text FROM range(40)")
    got = fm.restored(fm.rewritten(df, rate=100)).selectExpr("cast(text AS binary) = cast(restored AS binary) AS same", "n", "doc_id", "form").collect()
    assert all(r["same"] for r in got) and all(r["n"] == r["doc_id"] for r in got)


def test_sentinels_are_short_and_ascii():
    with pytest.raises(ValueError, match="ASCII"):
        fm.Automaton(sentinels=(b"\xc3\xa9",))
    with pytest.raises(ValueError, match="letters"):
        fm.Automaton(sentinels=(b"<fim_prefix_of_a_text>",))
