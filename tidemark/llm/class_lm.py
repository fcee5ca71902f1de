"""Language-model scores from Brown class-based bigrams.

P(w | v) = MIX * P(c(w) | h(v)) * P(w | c(w)) + (1 - MIX) * P_base(w), with h(v) the class of v, whatever its count; words that
training didn't have share one state, with the classes' shares of all tokens, and a text begins in a state of its own.
P_base is the add-one unigram model. Classes come from exchange clustering on counts over all training documents:

1. Words are counted (one shuffle, with sums per task before it). The HEAD most frequent have ids, and texts are written
   once as ids, so each later pass is arithmetic on arrays. How many words have ids is bounded, whatever the corpus, and so is
   what is broadcast. Any other word has at most a share of about 1 / HEAD of the tokens, however long it is, so joins on
   it have no hot key.
2. Distributed exchange over all words with ids. In each of SWEEPS sweeps a pass over all bigrams counts, for each word,
   the classes before and after it: the word x class table, of which each task sums its part and sends it, by BLOCKS blocks of
   words, to the tasks that sum the parts. Each of these takes its words in order of falling count and moves each to the class that raises the bigram
   likelihood the most, against its own copy of the class bigram table, which it keeps up to date. The driver gets one class a word.
   The first sweep starts from classes of the CORE most frequent words, which the same exchange on the driver gives;
   all these words may move in the sweeps like any other.
3. Words without ids get their class by the same criterion from what precedes and follows them, in parallel, by one
   shuffle; bigrams of two such words are joined with both classes. So transitions are counts over all bigrams, each by
   the classes of both its words.
4. Scoring sums bigrams of two words with ids in place. Words without ids are joined with their counts and classes by
   word, once for the terms of the word and of the next one, and once more for two in a row; terms are summed by row.

Words that training didn't have get the mass that each class keeps for one unseen word. Tokens are [^\\x20\\x09-\\x0D]+
after lower-casing A-Z, then one end. A word of more than LONGEST bytes goes by a digest of it, whatever its count.

To the driver: at most HEAD words with counts, CORE * CORE sums and HEAD classes a sweep (about 4 MB, 50 MB and 1 MB). To each task: the
words with ids (up to 8 MB), their classes and counts. A task of a sweep holds HEAD * WIDTH sums of 4 bytes (36 MB).

Defined results: a null text counts as empty and has the end alone; without training rows every token has the base
probability 1 / 1; repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_col, lower_words, text_slices, written

HEAD, CORE, CLASSES, CORE_SWEEPS, SWEEPS, BLOCKS, LONGEST = 131_072, 2048, 32, 6, 3, 16, 64
MIX, ALPHA, DELTA = 0.95, 0.5, 1.0
#: States: CLASSES, then a word without a known class, then the start. Columns: CLASSES, then a word without a known class.
OTHER, START, STATES, COLUMNS = CLASSES, CLASSES + 1, CLASSES + 2, CLASSES + 1
#: A word's row in the word x class table: states before it, classes after it, and how often it follows itself.
WIDTH = STATES + COLUMNS + 1
END = b""
#: Of the tables' own type, without which additions at places are twenty times as slow.
_ONE = np.int32(1)
#: Words of a block in one row of the word x class table, as it is shuffled.
CHUNK = 64
#: Entries that a task's tables of words may hold before they are passed on.
FLUSH = 300_000


def _key(word: bytes) -> bytes:
    """The word, or 33 bytes that stand for a long one (no word begins with a space)."""
    return word if len(word) <= LONGEST else b" " + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def tokens(text: str) -> list[bytes]:
    own = [*lower_words(text), END]
    return [_key(w) for w in own] if max(map(len, own)) > LONGEST else own


def _g(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for _, texts in text_slices(batches, text):
            for t in texts:
                found.update(tokens(t))
            if len(found) > FLUSH:
                yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Head:
    """The most frequent words, in order of falling count; END is one of them. blob: the words, one a line."""

    blob: bytes
    counts: np.ndarray


@functools.lru_cache(maxsize=2)
def _ids(blob: bytes, n: int) -> dict[bytes, int]:
    """word -> id, once a Python worker."""
    return {w: i for i, w in enumerate(blob.split(b"\n"))} if n else {}


def pick_head(counts: DataFrame) -> Head:
    """At most HEAD words: all above a count, found from a histogram of about 4,000 steps."""
    step = F.floor(F.log2("n") * 64)
    short = counts.filter(F.col("word") != F.lit(END))
    steps = sorted(((r["s"], r["k"]) for r in short.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = None, 0
    for s, k in steps:
        if (held := held + k) >= HEAD:
            break
        least = s
    chosen = counts.filter(F.col("word") == F.lit(END))
    if least is not None:
        chosen = chosen.union(short.filter(step >= least))
    got = chosen.toArrow()
    rows = sorted(zip(got["n"].to_pylist(), got["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    return Head(b"\n".join(w for _, w in rows), np.array([n for n, _ in rows], np.int64))


def encoded(docs: DataFrame, head: Head, train: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, train, ids, rare) of each row: ids as bytes of int32, -1 for words without an id, which are in rare."""
    blob, n = head.blob, len(head.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _ids(blob, n).get
        for part, texts in text_slices(batches, text):
            ids, rare = [], []
            for t in texts:
                own = tokens(t)
                found = np.fromiter(map(get, own, repeat(-1)), np.int32, len(own))
                ids.append(found.tobytes())
                rare.append([own[i] for i in np.flatnonzero(found < 0)])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                names=["row", "doc_id", "train", "ids", "rare"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), train.alias("train"),
        F.col(text).alias(text),
    )
    return written(rows.mapInArrow(run, "row long, doc_id long, train boolean, ids binary, rare array<binary>"), "encoded")


@dataclass
class _Tokens:
    """The tokens of a batch of rows, one after another: ids, prev (-1 for none and for words without an id), first, last, row."""

    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> _Tokens:
        size = np.array([len(x) // 4 for x in column.to_pylist()]) if column.null_count else np.diff(
            np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        ) // 4
        ids = np.frombuffer(b"".join(x.as_buffer() for x in column), np.int32).astype(np.int64)
        ends = np.cumsum(size)
        first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        first[ends - size], last[ends - 1] = True, True  # each row has the end at least
        return cls(ids, first, last, np.repeat(np.arange(len(size)), size))

    def states(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state before, class) of each token; classes: id -> class, the last entry for -1."""
        c = classes[self.ids]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[self.first] = START
        return before, c

    def second(self, rare: np.ndarray) -> np.ndarray:
        """Which of the words without ids (places in rare, their places among the tokens) follow another one."""
        return np.flatnonzero((np.diff(rare) == 1) & ~self.first[rare[1:]]) + 1 if len(rare) else rare


def _id_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, _Tokens]]:
    """Batches of at most 1,024 rows with their tokens."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield part, _Tokens.of(part.column(column))


def _sums(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(code, n) of the entries that aren't 0."""
    codes = np.flatnonzero(table)
    for at in range(0, len(codes), FLUSH):
        some = codes[at : at + FLUSH]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some], pa.int64())], names=["code", "n"])


def _summed(ids: DataFrame, run) -> DataFrame:
    return ids.select("ids").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def core_bigrams(ids: DataFrame) -> np.ndarray:
    """CORE x CORE counts over all rows; each task sums its own table, and only sums are shuffled."""
    core = CORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(core * core, np.int32)
        for _, t in _id_slices(batches, 0):
            a, b = t.ids[:-1], t.ids[1:]
            keep = (a >= 0) & (a < core) & (b >= 0) & (b < core) & ~t.first[1:]
            np.add.at(table, a[keep] * core + b[keep], _ONE)
        yield from _sums(table)

    got = _summed(ids, run).toArrow()
    out = np.zeros(core * core, np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(core, core)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = CORE_SWEEPS) -> np.ndarray:
    """Class of each word: exchange clustering of a bigram table, from classes dealt by rank."""
    n = len(bigrams)
    own = np.arange(n) % classes
    member = np.eye(classes, dtype=np.int64)[own]
    after, before = bigrams @ member, member.T @ bigrams  # word x class, class x word
    table = (member.T @ after).astype(np.float64)
    every = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, s = own[w], float(bigrams[w, w])
            r, left = after[w].astype(np.float64), before[:, w].astype(np.float64)
            if not r.any() and not left.any():
                continue
            table[a] -= r
            table[:, a] -= left
            table[a, a] += s
            r[a] -= s
            left[a] -= s
            g = _g(table)
            rows, columns = _g(table + r) - g, _g(table + left[:, None]) - g
            diagonal = table[every, every]
            gain = rows.sum(1) - rows[every, every] + columns.sum(0) - columns[every, every] + _g(diagonal + r + left + s) - _g(diagonal)
            starts, ends = table.sum(1), table.sum(0)
            gain -= _g(starts + r.sum() + s) - _g(starts) + _g(ends + left.sum() + s) - _g(ends)
            b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            table[b] += r
            table[:, b] += left
            table[b, b] += s
            if b != a:
                moved += 1
                own[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[a] -= bigrams[w]
                before[b] += bigrams[w]
        if not moved:
            break
    return own


def class_counts(ids: DataFrame, classes: np.ndarray) -> DataFrame:
    """(block, chunk, codes, counts): each task's part of the word x class table, sparse, for CHUNK words of a block in a row;
    rows of chunk -1 hold the class bigram table of the task, for each block.

    classes: id -> class, OTHER where there is none; the last entry is for words without an id. Word i is word i // BLOCKS
    of block i % BLOCKS, and codes are word in the chunk * WIDTH + place in the word's row.
    """
    n, blocks = len(classes) - 1, BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs = np.zeros(n * WIDTH, np.int32), np.zeros(STATES * COLUMNS, np.int64)
        for _, t in _id_slices(batches, 0):
            before, c = t.states(classes)
            pairs += np.bincount(before * COLUMNS + c, minlength=STATES * COLUMNS)
            known = t.ids >= 0
            np.add.at(table, t.ids[known] * WIDTH + before[known], _ONE)
            follows = known[:-1] & ~t.last[:-1]
            a, b = t.ids[:-1][follows], t.ids[1:][follows]
            np.add.at(table, a * WIDTH + STATES + c[1:][follows], _ONE)
            np.add.at(table, a[a == b] * WIDTH + WIDTH - 1, _ONE)
        rows: list[tuple] = [(b, -1, b"", pairs.tobytes()) for b in range(blocks)]
        words = table.reshape(n, WIDTH)
        for b in range(blocks):
            own = words[b::blocks]
            for k in range(-(-len(own) // CHUNK)):
                part = own[k * CHUNK : (k + 1) * CHUNK].ravel()
                if len(found := np.flatnonzero(part)):
                    rows.append((b, k, found.astype(np.uint16).tobytes(), part[found].tobytes()))
        for at in range(0, len(rows), 256):
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + 256], strict=True), kinds, strict=True)],
                names=["block", "chunk", "codes", "counts"],
            )

    return ids.select("ids").mapInArrow(run, "block int, chunk int, codes binary, counts binary")


def whole_tables(batches: Iterator[pa.RecordBatch], n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """block -> (its words x WIDTH, class bigram table): sums of class_counts() rows of n words with ids."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, chunk, codes, counts in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)), strict=True):
            if block not in out:
                out[block] = (np.zeros(len(range(block, n, BLOCKS)) * WIDTH, np.int64), np.zeros(STATES * COLUMNS, np.int64))
            words, pairs = out[block]
            if chunk < 0:
                pairs += np.frombuffer(counts.as_buffer(), np.int64)
            else:
                words[
                    np.frombuffer(codes.as_buffer(), np.uint16).astype(np.int64) + chunk * CHUNK * WIDTH
                ] += np.frombuffer(counts.as_buffer(), np.int32)
    return {b: (words.reshape(-1, WIDTH), pairs.reshape(STATES, COLUMNS)) for b, (words, pairs) in out.items()}


def move(rows: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One sweep over some words: rows of the word x class table in the order in which they move, their classes, and the
    class bigram table (STATES x COLUMNS) with all words in it. Returns the new classes."""
    table, own = table.astype(np.float64), own.copy()
    every = np.arange(CLASSES)
    g = _g(table)
    starts, ends = table.sum(1), table.sum(0)

    def shift(a: int, sign: float, before: np.ndarray, after: np.ndarray, s: float) -> None:
        table[:, a] += sign * before
        table[a] += sign * after
        table[a, a] += sign * s
        starts[:] += sign * before
        starts[a] += sign * (after.sum() + s)
        ends[:] += sign * after
        ends[a] += sign * (before.sum() + s)
        g[:, a], g[a] = _g(table[:, a]), _g(table[a])

    for w, row in enumerate(rows):
        a, s = int(own[w]), float(row[-1])
        before, after = row[:STATES].astype(np.float64), row[STATES:-1].astype(np.float64)
        if not before.any() and not after.any():
            continue
        before[a] -= s  # of the word's bigrams with itself
        after[a] -= s
        shift(a, -1, before, after, s)
        h, c = np.flatnonzero(before), np.flatnonzero(after)
        # the word's row and column join those of each class; where they cross, all come together
        gain = (_g(table[h, :CLASSES] + before[h, None]) - g[h, :CLASSES]).sum(0) + (_g(table[:CLASSES, c] + after[c]) - g[:CLASSES, c]).sum(1)
        x, y, d = before[:CLASSES], after[:CLASSES], table[every, every]
        gain += _g(d + x + y + s) - _g(d + x) - _g(d + y) + g[every, every]
        p, q = before.sum() + s, after.sum() + s
        # the same for the sums of rows and columns: of the class itself, and of the states and classes beside the word
        gain -= _g(starts[:CLASSES] + x + q) - _g(starts[:CLASSES] + x) + _g(ends[:CLASSES] + y + p) - _g(ends[:CLASSES] + y)
        b = a if a < CLASSES and gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
        shift(b, 1, before, after, s)
        own[w] = b
    return own


def sweep(ids: DataFrame, classes: np.ndarray) -> np.ndarray:
    """New classes of all words with ids: the word x class table, summed and moved in BLOCKS blocks, each in one task."""
    n, blocks = len(classes) - 1, BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (rows, table) in whole_tables(batches, n).items():
            words = np.arange(block, n, blocks)  # ids fall with counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.int64()), pa.array(move(rows, classes[words], table), pa.int64())], names=["word", "class"],
            )

    got = class_counts(ids, classes).repartition(blocks, "block").mapInArrow(run, "word long, class long").toArrow()
    out = classes.copy()
    out[got["word"].to_numpy()] = got["class"].to_numpy()
    return out


def head_classes(ids: DataFrame, head: Head) -> np.ndarray:
    """id -> class after all sweeps; a last entry, OTHER, for words without an id."""
    n = len(head.counts)
    classes = np.full(n + 1, OTHER, np.int64)
    if not n:
        return classes
    m = min(n, CORE)
    classes[:m] = exchange(core_bigrams(ids)[:m, :m])
    for _ in range(SWEEPS):
        classes = sweep(ids, classes)
    classes[:n][classes[:n] == OTHER] = 0
    return classes


def transitions(ids: DataFrame, classes: np.ndarray) -> DataFrame:
    """(prev, word, code, n) over all bigrams, with the classes of all words with ids. For a word with an id both words are
    null and code is state * COLUMNS + class; for one without, word is set and code is state * COLUMNS + class of the
    next word, OTHER where that has no id or is missing; for two without ids in a row, both are set. A preceding word
    without an id is OTHER in codes."""

    def summed(prev: pa.Array, words: pa.Array, codes: np.ndarray) -> pa.RecordBatch:
        table = pa.table({"prev": prev, "word": words, "code": pa.array(codes, pa.int64())})
        got = table.group_by(["prev", "word", "code"]).aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(got.column(c).to_pylist(), kind) if got.column(c).num_chunks != 1 else got.column(c).chunk(0) for c, kind in zip(("prev", "word", "code", "count_all"), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["prev", "word", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(STATES * COLUMNS, np.int64)
        for part, t in _id_slices(batches, 0):
            before, c = t.states(classes)
            known = t.ids >= 0
            table += np.bincount(before[known] * COLUMNS + c[known], minlength=STATES * COLUMNS)
            rare, words = np.flatnonzero(~known), part.column(1).flatten()
            if len(rare):
                after = np.where(t.last[rare], OTHER, c[np.minimum(rare + 1, len(c) - 1)])
                yield summed(pa.nulls(len(rare), pa.binary()), words, before[rare] * COLUMNS + after)
                second = t.second(rare)
                if len(second):
                    yield summed(words.take(pa.array(second - 1)), words.take(pa.array(second)), np.zeros(len(second), np.int64))
        codes = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(codes), pa.binary()), pa.nulls(len(codes), pa.binary()), pa.array(codes, pa.int64()),
                pa.array(table[codes], pa.int64()),
            ],
            names=["prev", "word", "code", "n"],
        )

    return written(
        ids.select("ids", "rare").mapInArrow(
            run, "prev binary, word binary, code long, n long",
        ).groupBy("prev", "word", "code").agg(F.sum("n").alias("n")),
        "states",
    )


def gains(counts: np.ndarray, states: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For entries (state, n) of a word: what each class gains in sum of N(h, c) log N(h, c); entries x classes."""
    now = counts[states]
    return _g(now + n[:, None]) - _g(now)


def rest_classes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n, class) of words without ids; rows with a null word hold sums n for state * CLASSES + class in `class`, of
    bigrams that have one such word."""
    each = rows.filter("word is not null and prev is null").groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("e"))
    each = each.select("word", F.col("e.code").alias("h"), F.col("e.n").alias("k"))
    after = counts[:CLASSES].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(STATES * CLASSES, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            codes, k = lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            word = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            total = np.bincount(word, k, batch.num_rows).astype(np.int64)
            h, c = codes // COLUMNS, codes % COLUMNS
            gain, sides = np.zeros((batch.num_rows, CLASSES)), []
            for table, width, w, x, m in ((counts, STATES, word, h, k), (after, CLASSES, word[c < CLASSES], c[c < CLASSES], k[c < CLASSES])):
                keys, at = np.unique(w * width + x, return_inverse=True)
                m = np.bincount(at, m, len(keys))
                w, x = keys // width, keys % width
                sides.append((w, x, m))
                sizes = table.sum(0)
                np.add.at(gain, w, gains(table, x, m))
                gain -= _g(sizes + np.bincount(w, m, batch.num_rows)[:, None]) - _g(sizes)
            own = gain.argmax(1)
            (w, x, m), (w2, x2, m2) = sides
            sure = x != OTHER
            np.add.at(sums, x[sure] * CLASSES + own[w[sure]], m[sure].astype(np.int64))
            np.add.at(sums, own[w2] * CLASSES + x2, m2.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(own, pa.int64())], names=["word", "n", "class"])
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(codes), pa.binary()), pa.array(sums[codes], pa.int64()), pa.array(codes, pa.int64())],
            names=["word", "n", "class"],
        )

    return written(each.mapInArrow(run, "word binary, n long, class long"), "rest")


@dataclass
class Model:
    """What scoring needs: all of bounded size but `rest`, a table (word, n, class)."""

    head: Head
    states: np.ndarray  # id -> class, and OTHER for -1
    total: int
    distinct: int
    transition: np.ndarray  # states x classes
    room: np.ndarray  # class -> its emission's denominator
    unseen: np.ndarray  # state -> probability of an unseen word by classes
    rest: DataFrame

    @property
    def own(self) -> np.ndarray:
        return self.states[:-1]

    @property
    def base_room(self) -> float:
        return float(self.total + self.distinct + 1)


def fit(ids: DataFrame, counts: DataFrame, head: Head) -> Model:
    """Classes and probabilities from training rows of encoded()."""
    size = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    classes = head_classes(ids, head)
    own = classes[:-1]
    rows = transitions(ids, classes)
    table = np.zeros((STATES, CLASSES))
    for r in rows.filter("word is null").collect():  # at most STATES * CLASSES rows
        table[r["code"] // COLUMNS, r["code"] % COLUMNS] += r["n"]
    both = rest_classes(rows, table)
    sums = both.filter("word is null").groupBy("class").agg(F.sum("n").alias("n")).collect()
    rest = both.filter("word is not null")
    members = np.bincount(own, minlength=CLASSES).astype(np.float64)
    for r in rest.groupBy("class").agg(F.count("*").alias("k")).collect():
        members[r["class"]] += r["k"]
    table[OTHER] = 0  # the bigrams after words without ids, now by these words' classes
    for r in sums:
        table[r["class"] // CLASSES, r["class"] % CLASSES] += r["n"]
    pairs = rows.filter("prev is not null").select("prev", "word", F.col("n").alias("times"))
    pairs = pairs.join(rest.select(F.col("word").alias("prev"), F.col("class").alias("h")), "prev").join(rest.select("word", "class"), "word")
    for r in pairs.groupBy("h", "class").agg(F.sum("times").alias("n")).collect():  # at most CLASSES * CLASSES rows
        table[r["h"], r["class"]] += r["n"]
    room = table.sum(0) + DELTA * (members + 1)
    table[OTHER] = table.sum(0)
    transition = (table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * CLASSES)
    return Model(head, classes, size["n"] or 0, size["v"], transition, room, transition @ (DELTA / room), rest)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """A model of all rows of docs."""
    counts = written(word_counts(docs, text), "counts")
    head = pick_head(counts)
    return fit(encoded(docs, head, F.lit(True), id_col, text), counts, head)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """score_encoded() of each row of docs."""
    return score_encoded(encoded(docs, model.head, F.lit(False), id_col, text), model)


def score_encoded(ids: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of encoded(); scores are log10 probabilities."""
    n, states, base_room = len(model.head.counts), model.states, model.base_room
    base = np.append((model.head.counts + 1) / base_room, 1.0)  # the last entry, for id -1, isn't used
    emission = np.append((model.head.counts + DELTA) / model.room[model.own] if n else np.zeros(0), 1.0)
    transition = np.concatenate([model.transition, np.ones((STATES, 1))], axis=1)
    names = ["row", "doc_id", "prev", "word", "state", "next", "next_in_class", "next_base", "n", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _id_slices(batches, 2):
            k, (before, c) = part.num_rows, t.states(states)
            row, known = part.column(0).to_numpy(), t.ids >= 0
            sure = known & (before != OTHER)
            p = MIX * transition[before, c] * emission[t.ids] + (1 - MIX) * base[t.ids]
            sums = lambda x: np.bincount(t.row, x, minlength=k)
            own = [
                np.bincount(t.row, minlength=k), sums(known).astype(np.int64), sums(np.where(known, np.log10(base[t.ids]), 0.0)),
                sums(np.where(sure, np.log10(p), 0.0)),
            ]
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), none(pa.binary(), k), none(pa.binary(), k), none(pa.int64(), k),
                    none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), *map(pa.array, own),
                ],
                names=names,
            )
            rare, words = np.flatnonzero(~known), part.column(3).flatten()
            second = t.second(rare)
            for at, one in ((np.arange(len(rare)), True), (second, False)):
                if m := len(at):
                    place = rare[at]
                    after = np.where(t.last[place], -1, t.ids[np.minimum(place + 1, len(t.ids) - 1)])
                    gone = (after < 0) | (not one)
                    zero = np.zeros(m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[t.row[place]]), none(pa.int64(), m), none(pa.binary(), m) if one else words.take(pa.array(at - 1)), words.take(pa.array(at)),
                         pa.array(before[place]) if one else none(pa.int64(), m), pa.array(states[after], mask=gone), pa.array(emission[after], mask=gone), pa.array(base[after], mask=gone),
                         pa.array(np.ones(m, np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)],
                        names=names,
                    )

    schema = "row long, doc_id long, prev binary, word binary, state long, next long, next_in_class double, next_base double, n long, n_known long, base double, score double"
    rows = written(ids.select("row", "doc_id", "ids", "rare").mapInArrow(run, schema), "scored")
    array = lambda x: F.array(*[F.lit(float(v)) for v in np.ravel(x)])
    cells, rest = array(model.transition), model.rest
    single = rows.filter("word is not null and prev is null").select(
        "row", "word", "state", "next", "next_in_class", "next_base", F.col("n").alias("times"), F.lit(True).alias("one"),
    )
    double = rows.filter("prev is not null").select("row", "prev", "word", F.col("n").alias("times"))
    double = double.join(rest.select(F.col("word").alias("prev"), F.col("class").alias("before")), "prev", "left")
    none = F.lit(None)
    double = double.select(
        "row", "word", F.coalesce("before", F.lit(OTHER)).alias("state"), none.cast("long").alias("next"),
        none.cast("double").alias("next_in_class"), none.cast("double").alias("next_base"), "times", F.lit(False).alias("one"),
    )
    joined = single.union(double).join(rest, "word", "left")
    seen = F.col("class").isNotNull()
    by_class = F.when(
        seen,
        F.get(cells, F.col("state") * CLASSES + F.col("class")) * (F.col("n") + DELTA) / F.get(array(model.room), F.col("class")),
    ).otherwise(F.get(array(model.unseen), F.col("state")))
    plain = (F.coalesce("n", F.lit(0)) + 1) / F.lit(base_room)
    # a single row after another word without an id leaves its own term to the double row
    mine = F.when(F.col("one") & (F.col("state") == OTHER), 0.0).otherwise(F.log10(MIX * by_class + (1 - MIX) * plain))
    follow = MIX * F.get(cells, F.coalesce("class", F.lit(OTHER)) * CLASSES + F.col("next")) * F.col("next_in_class") + (1 - MIX) * F.col("next_base")
    terms = joined.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.when(seen & F.col("one"), F.col("times")).otherwise(0).alias("n_known"),
        F.when(F.col("one"), F.col("times") * F.log10(plain)).otherwise(0.0).alias("base"), (F.col("times") * (mine + F.when(F.col("next").isNull(), 0.0).otherwise(F.log10(follow)))).alias("score"),
    )
    whole = rows.filter("word is null").select("row", "doc_id", "n", "n_known", "base", "score").union(terms)
    sums = whole.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return sums.drop("row")


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns and perplexity, 10 ** (-score / n_tokens): train on folds other than 2 of 7, score all."""
    train = fold_col(F.col(id_col), 7) != 2
    counts = written(word_counts(docs.filter(train)), "counts")
    head = pick_head(counts)
    ids = encoded(docs, head, train, id_col)
    model = fit(ids.filter("train"), counts, head)
    return score_encoded(ids, model).select(
        "doc_id", (fold_col(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
