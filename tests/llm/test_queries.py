"""Each opN query on a small, awkward folder of tables, held against brute force; SQL where there is some."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import DATA, compare, connection
from tidemark.llm import bpe, chat, class_lm, fingerprints, langid, media, mixing, near_dedup, queries, token_ledger
from tidemark.llm import components as components_module
from tidemark.llm.common import fold, written

RANKED = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
WHOLE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKED, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, copies int, rep long, `value` long"
CONVERSATIONS = "conv_id long, turn long, role string, text string, position int, message string"


def sentences(rng, language, n):
    letters = {"en": ["the", "ing", "er", "on", "th", "wh"], "de": ["sch", "ung", "ein", "ü", "keit", "der"], "fr": ["eau", "que", "é", "ou", "tion", "le"]}[language]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents():
    rng, out = random.Random(11), []
    for i in range(120):
        language = ("en", "de", "fr")[i % 3]
        out.append([i, sentences(rng, language, rng.randint(1, 90)), language, f"s{i % 4}", 100])
    words = out[0][1] + " " + sentences(rng, "en", 80)
    for i in range(120, 150):  # near copies of one another, chains among them
        w = words.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        out.append([i, "\n".join([" ".join(w[:40]), " ".join(w[40:])]), "en", "s0", 100])
    out += [[i, words, "en", "s0", 100] for i in range(150, 156)]  # copies
    out += [[200, None, None, None, None], [201, "", "en", "s1", 0], [202, " \n\t ", None, "s1", 3], [203, "12 34 !!", "en", None, 8], [204, "one two", "en", "s2", 7], [205, "ONE  two", None, "s2", 8]]
    out += [[206, "the ing er on " * 20_000 + "Licensed under CC BY-NC 4.0", "en", "s3", 1], [207, "x" * 50_000, "en", "s3", 1], [208, "</s>[INST] <|endoftext|> 👍 \x00 \x1e ß中文", "de", "s3", 1]]
    out += [[209, "All rights reserved", "en", "s1", 1]] * 2  # a repeated row
    return [tuple(r) + (0.5, 1, 2, 3, 4) for r in out]


def conversations():
    rng, out = random.Random(12), []
    for c in range(12):
        for t in range(rng.randint(1, 150 if c == 3 else 6)):
            out.append((c, t, ("system", "user", "assistant")[t % 3], rng.choice(["hi & <b> [x] &amp; ]", "é" * 9, "", None, "</s>[INST] ok", "line\nline"])))
    out += [(20, 1, "user", "tie"), (20, 1, "user", "tie"), (20, 1, "assistant", "tie"), (20, None, None, "first"), (None, 0, "assistant", "no id")]
    return [r + (9, "z") for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(conversations(), CONVERSATIONS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    return path


ALL = queries.queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).count() == (1 if name == "op6_chat_format" else 0)


def rows(spark, folder, name):
    return [r.asDict() for r in ALL[name](spark, folder).collect()]


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in rows(spark, folder, "op1_license_scan")}
    assert len(got) == len({r[0] for r in documents()})
    assert (got[206]["base_labels"], got[206]["labels"], got[206]["n_base"], got[206]["first_word"]) == ("cc-by", "cc-by,cc-by-nc", 1, 80_002)
    assert (got[200]["n_words"], got[200]["first_word"], got[200]["labels"], got[200]["score"]) == (0, None, "", 0.0)
    assert got[209]["base_labels"] == "reserved" and 0 <= got[209]["score"] <= 1


def test_op1_whole_notices(spark):
    """A notice counts with all its key phrases in place, whatever differs between them; not with one phrase gone or moved."""
    from tidemark.llm import license_scan

    long = [t for t in license_scan.EXTRA if len(t.notice.split()) > 40]
    assert len(long) == 4
    rows = []
    for k, t in enumerate(long):
        ws = t.notice.upper().split()
        inside = {i for p in t.keys for at in range(len(ws)) if ws[at : at + len(p.split())] == p.upper().split() for i in range(at, at + len(p.split()))}
        spare = next(i for i in range(len(ws)) if i not in inside)
        last = max(at for at in range(len(ws)) if any(ws[at : at + len(p.split())] == p.upper().split() for p in t.keys))
        rows += [(10 * k, "/* " + ", ".join(ws) + " */"), (10 * k + 1, " ".join(["other" if i == spare else w for i, w in enumerate(ws)]))]
        rows += [(10 * k + 2, " ".join(w for i, w in enumerate(ws) if i not in inside)), (10 * k + 3, " ".join(ws[:last] + ["new"] + ws[last:]))]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, t in enumerate(long):
        assert t.label in got[10 * k]["labels"].split(",") and got[10 * k]["score"] == 1.0
        assert t.label in got[10 * k + 1]["labels"].split(",")
        found = license_scan.license_scan(spark.createDataFrame([rows[4 * k + 2], rows[4 * k + 3]], "doc_id long, text string")).collect()
        assert not any(n["end"] - n["start"] > 40 for r in found for n in r["notices"])


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


@pytest.mark.parametrize("head", [30, 131_072])
def test_op2(spark, folder, monkeypatch, head):
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "CORE", 16)
    got = rows(spark, folder, "op2_class_lm")
    docs = documents()
    assert len(got) == len(docs)
    counts = Counter(w for d in docs if fold(d[0], 7) != 2 for w in tokens(d[1]))
    total, distinct = sum(counts.values()), len(counts)
    text = {d[0]: d[1] for d in docs}
    for r in got:
        own = tokens(text[r["doc_id"]])
        assert r["held_out"] == (fold(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_op2_probabilities_sum_to_one(spark, folder, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 30)
    monkeypatch.setattr(class_lm, "CORE", 16)
    model = class_lm.train(spark.read.parquet(f"{folder}/documents.parquet"))
    rest = model.rest.collect()
    for h in (0, class_lm.OTHER, class_lm.START):
        by_class = sum(model.transition[h, c] * (n + class_lm.DELTA) / model.room[c] for n, c in [*zip(model.head.counts, model.own, strict=True), *((r["n"], r["class"]) for r in rest)])
        assert by_class + model.unseen[h] == pytest.approx(1)
        assert (sum(model.head.counts + 1) + sum(r["n"] + 1 for r in rest) + 1) / model.base_room == pytest.approx(1)


@pytest.mark.parametrize("head", [30, 131_072])
def test_op2_every_word_has_a_class_as_predecessor(spark, folder, monkeypatch, head):
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "CORE", 16)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = class_lm.train(docs.filter(docs.doc_id % 7 != 2))
    words = model.head.blob.split(b"\n")
    own = dict(zip(words, map(int, model.own), strict=True)) | {bytes(r["word"]): r["class"] for r in model.rest.collect()}
    counts, table = Counter(), Counter()
    for d in documents():
        if d[0] % 7 != 2:
            toks = class_lm.tokens(d[1] or "")
            counts.update(toks)
            table.update((own[a] if a is not None else class_lm.START, own[b]) for a, b in zip([None, *toks], toks, strict=False))
    assert set(own) == set(counts)
    for h in (*range(class_lm.CLASSES), class_lm.START):
        n = sum(table[h, c] for c in range(class_lm.CLASSES))
        for c in range(class_lm.CLASSES):
            assert model.transition[h, c] == pytest.approx((table[h, c] + class_lm.ALPHA) / (n + class_lm.ALPHA * class_lm.CLASSES))
    text, total = {d[0]: d[1] for d in documents()}, sum(counts.values())
    for r in class_lm.score(docs, model).collect():
        toks, want = class_lm.tokens(text[r["doc_id"]] or ""), 0.0
        for a, b in zip([None, *toks], toks, strict=False):
            h = class_lm.START if a is None else own.get(a, class_lm.OTHER)
            by_class = model.transition[h, own[b]] * (counts[b] + class_lm.DELTA) / model.room[own[b]] if b in own else model.unseen[h]
            want += math.log10(class_lm.MIX * by_class + (1 - class_lm.MIX) * (counts[b] + 1) / (total + len(counts) + 1))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def _likelihood(bigrams, own):
    """Sum of N log N over class bigrams, less that over their sums by row and by column."""
    import numpy as np

    table = np.zeros((class_lm.STATES, class_lm.COLUMNS))
    for (v, w), n in bigrams.items():
        table[class_lm.START if v is None else own[v], own[w]] += n
    return sum(class_lm._g(x).sum() * sign for x, sign in ((table, 1), (table.sum(0), -1), (table.sum(1), -1))), table


def test_op2_sweep_is_exchange(spark):
    """A sweep moves each word to the class of the greatest likelihood, as trying all classes does; words follow themselves."""
    import numpy as np

    rng = random.Random(13)
    bigrams = Counter((rng.choice([None, *range(12)]), rng.randrange(12)) for _ in range(400))
    bigrams.update({(3, 3): 9, (5, 5): 20})
    own = [rng.randrange(class_lm.CLASSES) if w % 3 else class_lm.OTHER for w in range(12)]
    rows = np.zeros((12, class_lm.WIDTH), np.int64)
    for (v, w), n in bigrams.items():
        rows[w, class_lm.START if v is None else own[v]] += n
        if v is not None:
            rows[v, class_lm.STATES + own[w]] += n
            rows[v, -1] += n * (v == w)
    first = class_lm.move(rows[:1], np.array(own[:1]), _likelihood(bigrams, own)[1])
    tried = [_likelihood(bigrams, [c, *own[1:]])[0] for c in range(class_lm.CLASSES)]
    assert tried[first[0]] == pytest.approx(max(tried))
    # one word after another: the table is kept up to date, though the rows are those of the pass
    start, now = _likelihood(bigrams, own)[0], list(own)
    for w in range(12):
        fresh = np.zeros(class_lm.WIDTH, np.int64)
        for (v, x), n in bigrams.items():
            if x == w:
                fresh[class_lm.START if v is None else now[v]] += n
            if v == w:
                fresh[class_lm.STATES + now[x]] += n
                fresh[-1] += n * (x == w)
        tried = [_likelihood(bigrams, [*now[:w], c, *now[w + 1 :]])[0] for c in range(class_lm.CLASSES)]
        now[w] = int(class_lm.move(fresh[None], np.array([now[w]]), _likelihood(bigrams, now)[1])[0])
        assert tried[now[w]] == pytest.approx(max(tried))
    assert _likelihood(bigrams, now)[0] > start


def test_op2_sweeps_take_all_words(spark, folder, monkeypatch):
    """The word x class table of a pass is brute force's, and sweeps raise the likelihood beyond the words they start from."""
    import numpy as np

    monkeypatch.setattr(class_lm, "CORE", 16)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    head = class_lm.pick_head(class_lm.word_counts(docs))
    ids = class_lm.encoded(docs, head, F.lit(True))
    words = {w: i for i, w in enumerate(head.blob.split(b"\n"))}
    bigrams = Counter()
    for d in documents():
        own = [words[w] for w in class_lm.tokens(d[1] or "")]
        bigrams.update(zip([None, *own], own, strict=False))
    n = len(words)
    classes = np.append(np.arange(n) % class_lm.CLASSES, class_lm.OTHER)
    want = np.zeros((n, class_lm.WIDTH), np.int64)
    for (v, w), k in bigrams.items():
        want[w, class_lm.START if v is None else classes[v]] += k
        if v is not None:
            want[v, class_lm.STATES + classes[w]] += k
            want[v, -1] += k * (v == w)
    tables = class_lm.whole_tables(class_lm.class_counts(ids, classes).toArrow().to_batches(), n)
    for block, (rows_, pairs) in tables.items():
        assert (rows_ == want[block :: class_lm.BLOCKS]).all() and (pairs == _likelihood(bigrams, classes)[1]).all()
    assert len(tables) == class_lm.BLOCKS
    after = class_lm.sweep(ids, classes)
    assert _likelihood(bigrams, after)[0] > _likelihood(bigrams, classes)[0]
    assert (class_lm.sweep(ids, classes) == after).all() and (after[16:n] != classes[16:n]).any()
    assert set(class_lm.head_classes(ids, head)[:n]) <= set(range(class_lm.CLASSES))


def test_op2_long_words_have_ids():
    long = b"x" * 5000
    assert class_lm.tokens("A " + long.decode() + " b") == [b"a", class_lm._key(long), b"b", b""]
    assert len(class_lm._key(long)) == 33 and class_lm._key(long) != class_lm._key(long + b"x")


def test_op3(spark, folder):
    text = {d[0]: d[1] or "" for d in documents()}
    for r in rows(spark, folder, "op3_bpe"):
        ids = WHOLE.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    args = (public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    back = bpe.decode(bpe.encode(docs, *args), *args)
    assert all(bytes(r["decoded"]).decode() == text[r["doc_id"]] for r in back.collect())


@pytest.mark.parametrize("leaf", range(1, 65))
def test_op3_at_every_size_of_leaves(leaf):
    """The tree against the library, on texts whose pieces and merges run over every boundary."""
    rng = random.Random(leaf)
    own = bpe.Codec(RANKED, public_tokenizers.PATTERN, leaf=leaf, merge_leaf=rng.choice([1, 2, 3, 8, 16]))
    bits = [*"aab'  \n\t\r ~re'sé中٣1.👍xxx̀\u3000", "'re", "'ll", "  ", "xxxx"]
    for k in range(25):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200)))
        text = rng.choice("xa-= \n") * rng.randint(1, 500) if k % 5 == 0 else "".join(rng.choice("ethinsaor") for _ in range(300)) if k % 5 == 1 else text
        ids = own.encode(text)
        assert ids == WHOLE.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 1500, "-" * 2999, "abc" * 1111, "aab" * 800 + "a" * 700, "é" * 1500, "=-" * 900 + "=" * 1000])
def test_op3_runs(text):
    assert bpe.Codec(RANKED, public_tokenizers.PATTERN).encode(text) == WHOLE.encode_ordinary(text)


def test_op3_long_runs_take_little_time():
    """Time follows the length, whatever the period: a merge that meets the same bytes again looks them up."""
    import time

    for text in ("a" * 400_000, "ab" * 200_000, "-" * 400_000, "abc" * 130_000):
        began = time.process_time()
        ids = bpe.Codec(RANKED, public_tokenizers.PATTERN).encode(text)
        assert time.process_time() - began < 20
        assert b"".join(map(WHOLE.decode_single_token_bytes, ids)).decode() == text


def test_op3_refuses_what_it_cannot_know():
    with pytest.raises(ValueError, match="ahead"):
        bpe.Codec(RANKED, r"\w+|\W+")
    own = bpe.Codec(RANKED, r"\w+|\W+", ahead=1, leaf=3)
    assert own.encode("one  two!?three") == [i for p in ("one", "  ", "two", "!?", "three") for i in WHOLE._core_bpe.encode_single_piece(p.encode())]
    with pytest.raises(ValueError, match="no id 99999999"):
        own.decode([1, 99_999_999])


def xxhash64(data, seed=42):
    import xxhash

    n = xxhash.xxh64(data, seed=seed).intdigest()
    return n - (1 << 64) if n >> 63 else n


def merkle(text):
    """A fingerprint and its leaves, node by node: brute force for the column functions."""
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nodes = []
    for line in text.replace("\x1d", "\x1d0").replace("\x1e", "\x1d1").split("\n"):
        leaves, now = [], []
        for i, w in enumerate(words := line.split(" ")):
            now.append(w)
            if (w and xxhash64(w.encode()) % fingerprints.LEAF_WORDS == 0) or i % fingerprints.MOST_WORDS == fingerprints.MOST_WORDS - 1 or i == len(words) - 1:
                leaves.append(" ".join(now))
                now = []
        hashes = [hexed(x) for x in leaves]
        nodes.append((hexed("".join(hashes)), [h[:8] for h in hashes]))
    sections = [nodes[i : i + fingerprints.SECTION] for i in range(0, len(nodes), fingerprints.SECTION)]
    tops = [hexed("".join(h for h, _ in s)) for s in sections]
    root = hexed("".join(tops) + hexed(text))[:32]
    shape = "/".join(".".join("".join(x) for _, x in s) for s in sections)
    inner = "/".join(t[:8] + "".join(h[:8] for h, _ in s) for t, s in zip(tops, sections, strict=True))
    return f"{root}:{shape}|{inner}", {x for _, own in nodes for x in own}


def dice(a, b):
    (p, x), (q, y) = merkle(a), merkle(b)
    return 1.0 if p[:32] == q[:32] else 2 * len(x & y) / (len(x) + len(y))


def test_op4(spark, folder):
    """Each row against the tree built node by node; rows that share an id stand in order of their text."""
    docs = sorted(documents(), key=lambda d: (d[0], d[1] or ""))
    got = defaultdict(list)
    for r in rows(spark, folder, "op4_fingerprints"):
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    want = defaultdict(list)
    for k, d in enumerate(docs):
        text, after = d[1] or "", docs[(k + 1) % len(docs)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        want[d[0]].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle(text)[0], merkle(edited)[0], round(dice(text, edited), 9), round(dice(text, after), 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_edits_are_located(spark):
    lines = [f"line {i} with words" for i in range(20)]
    other = [*lines[:11], "changed", *lines[12:]]
    pair = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    row = pair.select(fingerprints.differing(F.col("a"), F.col("b")).alias("d"), fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).first()
    assert [(d["section"], d["paragraph"]) for d in row["d"]] == [(1, 3)] and 0.5 < row["n"] < 1


def test_descent_finds_what_lines_tell(spark):
    """Places of edits, against a comparison of all lines; texts of different lengths and equal ones among them."""
    rng, pairs = random.Random(21), []
    for _ in range(40):
        lines = [f"line {rng.randint(0, 5)}" for _ in range(rng.randint(1, 40))]
        other = [x if rng.random() < 0.9 else f"changed {rng.randint(0, 3)}" for x in lines][: rng.choice([None, len(lines), max(1, len(lines) - 3)])]
        pairs.append(("\n".join(lines), "\n".join(other)))
    made = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.differing(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("d"))
    for r in made.collect():
        a, b = r["a"].split("\n"), r["b"].split("\n")
        want = [divmod(i, fingerprints.SECTION) for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1]]
        assert [(d["section"], d["paragraph"]) for d in r["d"]] == want


@pytest.mark.parametrize(("a", "b"), [("one two\nend", "one two  \nend"), ("x\n\ny", "x\n   \ny"), ("one\x1e", "one"), ("one two three four five six", "one two\x1ethree four\x1efive six")])
def test_edits_of_blanks_have_a_place(spark, a, b):
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    row = pair.select(fingerprints.differing(F.col("a"), F.col("b")).alias("d"), fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).first()
    assert len(row["d"]) == 1 and row["n"] < 1


def test_op5_ledger(spark, folder, tmp_path):
    got = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rows(spark, folder, "op5_token_counts")}
    want: dict = defaultdict(lambda: [0, 0])
    for d in documents():
        for version, n in (("words-1", len(tokens(d[1])) - 1), ("chars-1", len(d[1] or "")), ("bytes-1", len((d[1] or "").encode()))):
            want[d[3], d[2], version][0] += 1
            want[d[3], d[2], version][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"))
    counts = token_ledger.counts(spark.read.parquet(f"{folder}/documents.parquet"))
    added = token_ledger.inserts(token_ledger.counted(counts, "words-1"))
    assert ledger.totals().count() == 0 and ledger.compact() == 0
    assert ledger.commit("a", added) and not ledger.commit("a", added)
    before = {tuple(r) for r in ledger.totals().collect()}
    assert ledger.commit("b", token_ledger.deletes(token_ledger.counted(counts, "words-1")))
    assert ledger.totals().count() == 0 and ledger.batches() == ["a", "b"]
    assert ledger.commit("c", added) and {tuple(r) for r in ledger.totals().collect()} == before
    ledger.has = lambda batch_id: False  # as for a writer that looked before another one's commit
    ledger.commit("c", added)  # either writer's table counts, and only one
    assert {tuple(r) for r in ledger.totals().collect()} == before
    del ledger.has
    assert ledger.batches() == ["a", "b", "c"]
    with pytest.raises(ValueError):
        ledger.commit("../x", added)
    # a base replaces the batches, and their ids stay known
    assert ledger.compact() == 3 and ledger.compact() == 0 and ledger.batches() == ["a", "b", "c"]
    assert not ledger.commit("b", added) and {tuple(r) for r in ledger.totals().collect()} == before
    assert ledger.commit("d", added)
    older = ledger.totals()  # a plan that is run after the next compaction
    assert ledger.compact() == 1
    twice = {(*t[:3], 2 * t[3], 2 * t[4]) for t in before}
    assert {tuple(r) for r in ledger.totals().collect()} == twice == {tuple(r) for r in older.collect()}
    ledger.grace = 0
    assert ledger.compact() == 0 and {tuple(r) for r in ledger.totals().collect()} == twice
    assert not list((tmp_path / "ledger").glob("data-*")) and not list((tmp_path / "ledger" / "commits").glob("*"))
    assert len(list((tmp_path / "ledger").glob("base-*"))) == 2 and ledger.batches() == ["a", "b", "c", "d"]


def test_op5_writers_that_die(spark, folder, tmp_path, monkeypatch):
    """Whatever step a writer gets to, its batch is in whole or can be sent again, and totals stay right."""
    counts = token_ledger.counts(spark.read.parquet(f"{folder}/documents.parquet"))
    added = token_ledger.inserts(token_ledger.counted(counts, "chars-1"))
    ledger = token_ledger.TokenLedger(spark, str(tmp_path), grace=0)
    totals = lambda: sorted(map(repr, ledger.totals().collect()))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, "_mark", dies)
        with pytest.raises(KeyboardInterrupt):
            ledger.commit("a", added)
    assert totals() == [] and ledger.batches() == []
    assert ledger.commit("a", added)
    once = totals()
    for step in ("_mark", "_clear"):  # before a base is named, and before what it replaces goes
        with monkeypatch.context() as m:
            m.setattr(ledger, step, dies)
            with pytest.raises(KeyboardInterrupt):
                ledger.compact()
        assert totals() == once and ledger.batches() == ["a"] and not ledger.commit("a", added)
    assert ledger.compact() == 0 and totals() == once and not ledger.commit("a", added)
    (tmp_path / "commits" / "b").mkdir(parents=True)  # a folder without a file says nothing
    assert ledger.batches() == ["a"] and ledger.commit("b", added) and ledger.batches() == ["a", "b"]


def test_op5_counts_by_ranks(spark, folder, tmp_path):
    """A tokenizer version from a rank file, and its revision to another one, against the library's counts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"))
    own = token_ledger.bpe_counted(docs, "multi-50k", public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    assert ledger.commit("bpe", token_ledger.inserts(own))
    want: dict = defaultdict(int)
    for d in documents():
        want[d[3], d[2]] += len(WHOLE.encode_ordinary(d[1] or ""))
    assert {(r["source"], r["lang"]): r["tokens"] for r in ledger.totals().collect()} == dict(want)


def test_op6(spark, folder):
    groups = defaultdict(list)
    for c, t, role, text, *_ in [*conversations(), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups[c].append((-math.inf if t is None else t, role or "", text or ""))
    got = {r["conv_id"]: r for r in rows(spark, folder, "op6_chat_format")}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_events_are_folded(spark):
    log = [(1, 0, 0, "open", "user", None), (1, 0, 1, "delta", "user", "he"), (1, 0, 2, "delta", "user", "llo"), (1, 1, 0, "open", "assistant", ""), (1, 1, 1, "delta", "assistant", "bad"), (1, 1, 2000, "regenerate", "assistant", "go"), (1, 1, 2001, "delta", "assistant", "od"), (1, 1, 5000, "edit", "assistant", "best"), (1, 2, 0, "open", "user", ""), (1, 2, 1, "drop", "user", None)]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert sorted((r["message"], r["role"], r["text"]) for r in folded.collect()) == [(0, "user", "hello"), (1, "assistant", "best")]
    shown = chat.render(folded.withColumn("part", chat.part_of(F.col("message")))).first()
    assert shown["formatted"] == "<s>[user] hello </s>\n<s>[assistant] best </s>\n"


def test_fold_is_a_state_machine(spark):
    """Random logs against events taken one by one; streams are longer than a chunk."""
    rng, log, want = random.Random(22), [], {}
    for message in range(60):
        state, open_, seq, ended = "", True, 0, False
        for _ in range(rng.randint(0, 25)):
            seq += rng.choice([1, 2, 700])
            kind, text = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0], rng.choice(["a", "bc", "", None, "d"])
            log.append((1, message, seq, kind, "user", text))
            if kind == "delta":
                state += "" if ended else text or ""
            else:
                state, ended = text or "", kind == "edit"
            open_ = False
        if not open_:
            want[message] = state
    rng.shuffle(log)
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert {r["message"]: r["text"] for r in got.collect()} == want


def test_log_has_all_kinds_of_events(spark, folder):
    rows_ = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = {r["kind"]: r["count"] for r in chat.events_of(rows_).groupBy("kind").count().collect()}
    assert set(kinds) == {"open", "delta", "edit", "regenerate"} and min(kinds.values()) > 10


def test_op7(spark, folder):
    got = rows(spark, folder, "op7_mixing")
    assert len(got) == len(documents())
    sums: dict = defaultdict(lambda: [0, 0, 0])
    source = {d[0]: d[3] for d in documents()}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["size"] == len(tokens(next(d[1] for d in documents() if d[0] == r["doc_id"]))) - 1
        sums[source[r["doc_id"]]][0] += r["size"]
        sums[source[r["doc_id"]]][1] += r["taken"]
        sums[source[r["doc_id"]]][2] = r["target"]
    order = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(v[0] for v in sums.values()), set()
    while True:
        level = (budget - sum(2 * sums[s][0] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * sums[s][0]}
        if not over:
            break
        full |= over
    for s in order:
        assert sums[s][2] == pytest.approx(2 * sums[s][0] if s in full else level * weight[s], abs=1e-5)
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, folder, "op7_mixing")))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert mixing.mixed(docs).count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + sum(0 for r in got if not r["size"]) + _copies_of_empty(docs)


def test_places_over_two_levels(spark, monkeypatch):
    """Spans of buckets give the prefix sums that one window over all groups would."""
    monkeypatch.setattr(mixing, "SPAN", 3)
    rng = random.Random(3)
    groups = [(s, c, b, rng.randint(1, 9)) for s in (None, "a", "b") for c in range(3) for b in range(20) if rng.random() < 0.8]
    got = {tuple(r)[:3]: r["_start"] for r in mixing._starts(spark.createDataFrame(groups, "source string, _class long, _bucket long, _rows long")).collect()}
    assert got == {g[:3]: sum(o[3] for o in groups if o[0] == g[0] and o[1:3] < g[1:3]) for g in groups}


def _copies_of_empty(docs):
    from tidemark.llm.common import written

    return mixing.copies(written(mixing.sized(docs, "doc_id"), "t")).filter("size = 0").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]


def components(docs):
    sets = {}
    for d in docs:
        w = (d[1] or "").encode().lower().split()
        sets[d[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [3, 1024])
def test_op8(spark, folder, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets, want = components(documents())
    got = rows(spark, folder, "op8_near_dedup")
    assert len(got) == len(documents())
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_links_within_a_block():
    from tidemark.llm.shingles import shingle_set

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 5)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    found = near_dedup._Block(list(range(40)), [0] * 40, [len(x) for x in sets], sets, True).links()
    _, want = components([(i, t) for i, t in enumerate(texts)])
    parent = {i: i for i in range(40)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {i: find(i) for i in parent} == want


def test_estimates_within_a_block():
    """The block's table of estimates is union_estimate() of each pair, for sets longer and shorter than a sketch."""
    from tidemark.llm.shingles import shingle_set

    rng = random.Random(5)
    sets = [shingle_set(" ".join(f"w{rng.randint(0, 5) + k}" for k in range(rng.choice([3, 12, 40, 90])))) for _ in range(30)]
    own = near_dedup._Block(list(range(30)), [0] * 30, [len(x) for x in sets], sets, True)
    import numpy as np

    for i in range(30):
        near = np.array([j for j in range(30) if j != i])
        assert own._estimates(i, near) == pytest.approx([near_dedup.union_estimate(sets[i], sets[j]) for j in near])


def test_pairs_count_in_their_first_list():
    """Over all lists of some members, each possible pair is found in the list of the first value that both are in."""
    import numpy as np
    from tidemark.llm.shingles import shingle_set

    rng = random.Random(14)
    base = [f"w{i}" for i in range(50)]
    sets, lists = [], []
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(50)] = f"e{rng.randint(0, 9)}"
        sets.append(shingle_set(" ".join(w)))
        lists.append(np.array(sorted(rng.sample(range(1, 9), rng.randint(1, 6)))))  # in one order for all
    found = set()
    for value in range(1, 9):
        members = [i for i in range(25) if value in lists[i]]
        if len(members) > 1:
            own = near_dedup._Block(members, [0] * len(members), [len(sets[i]) for i in members], [sets[i] for i in members], True, value, [lists[i] for i in members])
            for k, i in enumerate(members):
                for j in own._partners(k, np.ones(len(members), bool)):
                    assert min(set(lists[i].tolist()) & set(lists[members[j]].tolist())) == value
                    found.add((i, members[j]))
    want = {(i, j) for i in range(25) for j in range(25) if i != j and set(lists[i].tolist()) & set(lists[j].tolist()) and near_dedup.union_estimate(sets[i], sets[j]) >= near_dedup.OVERLAP / near_dedup.SKETCH and 100 * min(len(sets[i]), len(sets[j])) >= 75 * max(len(sets[i]), len(sets[j]))}
    assert found == want and len(want) > 50


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 nodes in order, dealt at random, and as alternating small and large ones: rounds and jumps stay logarithmic."""
    rng, tables = random.Random(6), []
    monkeypatch.setattr(components_module, "written", lambda df, name: tables.append(name) or written(df, name))
    mixed_order = rng.sample(range(1000), 1000)
    for order, most in ((list(range(1000)), 1), (mixed_order, 9)):
        tables.clear()
        edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
        got = components_module.connected_components(edges)
        assert {(r["node"], r["component"]) for r in got.collect()} == {(i, 0) for i in range(1000)}
        assert tables.count("least") <= most and tables.count("hooks") <= 12 + 4 * most


def test_components_of_no_edges_and_of_loops(spark):
    assert components_module.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = components_module.connected_components(spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 2)]


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
A = "alpha beta gamma delta epsilon zeta eta theta"


def test_rows_of_one_id_with_different_texts(spark):
    b, a = A, "uno dos tres cuatro cinco seis siete ocho"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(3, b), (5, b), (5, a)]], PLAIN)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()) == [(3, 3, True), (5, 3, False), (5, 5, True)]
    assert sorted(r[:2] for r in near_dedup.keep_one(docs).collect()) == [(3, b), (5, a)]


def test_keep_one_of_awkward_rows(spark):
    b, a = A, "uno dos tres cuatro cinco seis siete ocho"
    rows = [(None, b), (None, b), (1, b), (1, b), (1, a), (2, a), (4, None), (4, ""), (6, None), (7, "  " + b), (1, b.upper())]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], PLAIN)
    got = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, b), (None, b), (1, b.upper()), (1, a), (4, None), (6, None)], key=str)
    only = near_dedup.keep_one(docs.select("doc_id", "text"))
    assert sorted(map(tuple, only.collect()), key=str) == sorted(got, key=str) and only.columns == ["doc_id", "text"]


CLASHES = ("_sig", "sig", "sig_", "_id", "_rest", "rest", "others", "_row", "row", "mix_row", "_mix_row", "_mix_times", "mix_copy", "tie", "size", "copies", "target", "n_shingles", "component_id", "Others")


def test_clashing_names(spark):
    """Tables whose columns are named as the operators' own keep them."""
    docs = [(i, "one two three four five six " * (1 + i % 3), f"s{i % 2}", *range(len(CLASHES))) for i in range(9)]
    docs += [docs[0], (3, "other words in the same row as three has", None, *range(len(CLASHES))), (None, "no id", "s0", *range(len(CLASHES)))]
    columns = [c for c in CLASHES if c != "Others"]
    df = spark.createDataFrame([d[: 3 + len(columns)] for d in docs], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in columns))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {tuple(r)[3:] for r in kept.collect()} == {tuple(range(len(columns)))}
    taken = mixing.mixed(df)
    assert taken.columns == df.columns and taken.count() > 0 and {tuple(r)[3:] for r in taken.collect()} == {tuple(range(len(columns)))}


def test_null_ids_are_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 10)
    rows = spark.createDataFrame([(None, f"{'w ' * (1 + i % 2)}", "s") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.digest(rows.repartition(4)).collect()
    assert len(got) == 400 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 2
    own = mixing.written(mixing.sized(rows.withColumn("row", F.monotonically_increasing_id()), "doc_id", "row"), "rows")
    seen = []
    monkeypatch.setattr(mixing, "_starts", lambda counts, f=mixing._starts: seen.append(max(r["_rows"] for r in counts.collect())) or f(counts))
    mixing.copies(own, ties=("row",), row="row").count()
    assert seen and seen[0] < 40


def test_op9(spark, folder):
    text = {d[0]: d[1] or "" for d in documents()}
    for r in rows(spark, folder, "op9_media"):
        raw = text[r["doc_id"]].encode()
        payload = media.pad(raw)
        stored = media.encode_jpeg(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op10(spark, folder):
    docs = {d[0]: d for d in documents()}
    got = rows(spark, folder, "op10_language_id")
    assert len(got) == len(documents())
    held = [r for r in got if r["held_out"] and r["doc_id"] < 150 and len(docs[r["doc_id"]][1]) > 40]
    assert sum(r["lang_pred"] == docs[r["doc_id"]][2] for r in held) >= 0.9 * len(held) > 10
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in docs[r["doc_id"]][1] or ""):
            assert r["lang_pred"] == "und"


def test_folded_weights_are_the_kernel():
    """The folded matrix gives what kernels with the landmarks give."""
    import numpy as np

    rng = random.Random(8)
    texts, marks = [sentences(rng, "de", 30) for _ in range(5)], [sentences(rng, "fr", 30) for _ in range(4)]
    alpha = np.arange(8, dtype=float).reshape(4, 2)

    def grams(t):
        row = np.zeros(langid.DIMS, np.uint8)
        langid.presence(t, row)
        return row.astype(float)

    dense = np.stack([grams(m) / np.sqrt(grams(m).sum()) for m in marks])
    model = langid.Model(["a", "b"], (dense.T @ alpha).astype(np.float32))
    kernel = np.array([[grams(t) @ grams(m) / np.sqrt(grams(t).sum() * grams(m).sum()) for m in marks] for t in texts])
    assert np.allclose(model.scores(texts), kernel @ alpha, rtol=1e-3)


def test_rows_of_one_id_train_as_one(spark):
    rng = random.Random(9)
    rows = [(i, sentences(rng, ("de", "fr")[i % 2], 30), ("de", "fr")[i % 2]) for i in range(40)]
    often = spark.createDataFrame(rows + [rows[0]] * 300, "doc_id long, text string, lang string")
    model = langid.fit(often)
    assert model.predict([rows[k][1] for k in range(10)])[0] == ["de", "fr"] * 5
    assert (langid.fit(often.orderBy(F.col("doc_id").desc())).weights == model.weights).all()


def test_op10_is_kernel_ridge(spark):
    """Predictions against kernels, landmarks and the ridge system written out for whole texts."""
    import numpy as np

    rng = random.Random(31)
    rows = [(i, sentences(rng, ("de", "fr", "en")[i % 3], 25), ("de", "fr", "en")[i % 3]) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=20)

    def grams(t):
        raw = b" " + t.encode().lower() + b" "
        return {hash_of(raw[i : i + n], n) for n in range(1, langid.ORDERS + 1) for i in range(len(raw) - n + 1)}

    def hash_of(g, n):
        return ((int.from_bytes(g, "big") * int(langid._ODD[n - 1]) + (n - 1) * 40503) % (1 << 32)) >> (32 - langid.DIMS_BITS)

    def kernel(x, y):
        return len(x & y) / math.sqrt(len(x) * len(y))

    sets = [grams(r[1]) for r in rows]
    marks = sorted(range(60), key=lambda i: (rows[i][2], rows[i][0]))[:: 60 // 20]
    k_nm = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in range(60)])
    target = np.array([[float(r[2] == c) for c in ("de", "en", "fr")] for r in rows])
    system = k_nm.T @ k_nm + langid.RIDGE * 60 / len(marks) * k_nm[marks] + 1e-8 * np.eye(len(marks))
    alpha = np.linalg.solve(system, k_nm.T @ target)
    tried = [sentences(rng, language, 15) for language in ("de", "en", "fr") * 5]
    out = np.array([[kernel(grams(t), sets[j]) for j in marks] for t in tried]) @ alpha
    labels, scores, outputs = model.predict(tried)
    assert labels == [("de", "en", "fr")[k] for k in out.argmax(axis=1)]
    assert outputs == pytest.approx(out.max(axis=1).tolist(), abs=1e-3)
    e = np.exp(langid.SHARPNESS * (out - out.max(axis=1, keepdims=True)))
    assert scores == pytest.approx((e / e.sum(axis=1, keepdims=True)).max(axis=1).tolist(), abs=1e-2)


@pytest.mark.parametrize("languages", [1, 2, 3])
def test_language_stage_rejects_what_was_not_learned(spark, languages):
    """Texts of no learned language go, with as few as one language; texts without a letter go; others stay."""
    rng, names = random.Random(32), ("de", "fr", "en")[:languages]
    rows = [(i, sentences(rng, names[i % languages], 30), names[i % languages], "s", 1) for i in range(30)]
    rows += [(100, "Привет как дела сегодня хорошая погода", None, "s", 1), (101, "的一是不了人我在有他这为之大来以个中上们", None, "s", 1), (102, "12 34", None, "s", 1), (103, None, None, "s", 1), (None, rows[0][1], None, None, None)]
    left = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, PLAIN), "")
    assert {r["doc_id"] for r in left.collect()} == {None, *range(30)}


def test_stages_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_take_rows_one_by_one(spark):
    """Null ids, ids of several texts and sources, repeated rows: each stage's words by source are those of its rows."""
    rng = random.Random(33)
    rows = [(i % 30, sentences(rng, ("de", "fr")[i % 2], rng.randint(20, 60)), ("de", "fr")[i % 2], f"s{i // 30}", 1) for i in range(60)]
    rows += [(None, rows[k][1] + " ein ein", "de", None, 1) for k in range(5)] + [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, PLAIN)
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").count() == len(rows)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert kept.count() == len(rows) - 2
    mixed_rows = corpus_pipeline.STAGES[2][1](spark, kept, "").collect()
    size, words_of = defaultdict(int), defaultdict(int)
    for r in kept.collect():
        size[r["source"]] += len(r["text"].split())
    for r in mixed_rows:
        words_of[r["source"]] += len(r["text"].split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight, budget, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), set()
    while True:
        level = (budget - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        if not (over := {s for s in order if s not in full and level * weight[s] > 2 * size[s]}):
            break
        full |= over
    for s in order:
        target = 2 * size[s] if s in full else level * weight[s]
        assert abs(words_of[s] - target) <= 62  # a document's words: one whole copy more or less
    assert corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(mixed_rows, PLAIN), "").count() == len(mixed_rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(ALL[name](spark, DATA), connection(), queries.oracle_sql()[name])


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert first.columns == columns
    left = {r["doc_id"] for r in first.collect()}
    assert not left & {200, 201, 202, 203} and left >= set(range(120))
    kept = spark.createDataFrame([tuple(r) for r in first.collect()], first.schema)
    second = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    _, want = components([tuple(r) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(set(want.values()))
    third = corpus_pipeline.STAGES[2][1](spark, second, folder)
    assert third.columns == columns
    times = Counter(r["doc_id"] for r in third.collect())
    # each kept document comes floor or ceil of its expected copies times, in sources whose targets are brute force's
    sizes, by_source = {r["doc_id"]: len(tokens(r["text"])) - 1 for r in second.collect()}, defaultdict(list)
    for r in second.collect():
        by_source[r["source"]].append(r["doc_id"])
    total = {k: sum(sizes[i] for i in ids) for k, ids in by_source.items()}
    weight = {k: (3, 1, 2)[n % 3] for n, k in enumerate(sorted(total, key=lambda k: (k is None, k)))}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):  # the water level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[k], level * weight[k]) for k in total) < 1.5 * sum(total.values()) else (low, level)
    for k, ids in by_source.items():
        rate = min(2 * total[k], level * weight[k]) / total[k]
        assert all(math.floor(rate - 1e-6) <= times[i] <= math.ceil(rate + 1e-6) for i in ids)
    want = []
    for r in third.collect():
        ids = WHOLE.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, final.collect())) == sorted(want)
