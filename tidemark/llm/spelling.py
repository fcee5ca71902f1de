"""Groups of spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

1. Runs of letters are counted by task and then overall; frequent words are the vocabulary, a written table.
2. Each word is its bigrams with their positions. Two words one edit apart, the longer of L code points, share at least
   T = L - 1 - Q of them at the same position, or one further on in the longer word (behind the edit). So of the words'
   grams, rarest first, the first k that they share stand among the first Q + k of the longer (or equally long) and
   Q + k - 1 of the shorter: an inverted list is named by L and k such grams at their positions in the longer word, and
   each word enters the lists of its own rarest grams only.
3. Lists are dealt to tasks by their names. Within a list each word's postings (its grams, by position and length) are
   merged from a heap; words that come up at least T times are verified. A pair counts only in the list that is named by
   the first k grams that it shares, so each pair comes up once.
4. A list of more than LIST words isn't merged: its words go on to lists that are named by one more gram, in the next round.
   With k = T nothing but the edited place is left open, so a list has at most as many words as two letters have values;
   a list with k = T or k = MOST, as long words have, is merged whatever its size. No list, pair or word is dropped.
5. Each word's form is its best neighbour, if that is much more frequent; forms are followed by pointer jumping.

The rarity of grams only orders them; it is counted over the vocabulary in COUNTERS shared counters, which is all that the
driver collects, and any order gives the same pairs.

Defined results: a null or empty text has no words; null ids count as no digits where words are altered by id; repeated rows
count each time; ties between forms go to the smallest in code-point order; very long words are words like others (their
lists are named by a few grams); an empty table gives no words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_slices, written
from .components import followed

#: Code points of a gram.
Q = 2
#: Grams that name a list in the first round.
FIRST = 2
#: Grams that name a list at most: a word enters (k + 1) * (k + 2) / 2 lists of its own length.
MOST = 6
#: Words of a list that are merged at once; larger lists are split by one more gram.
LIST = 64
#: Counters that grams share.
COUNTERS = 1 << 16
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18

LETTERS = r"A-Za-zÀ-ÿ"
_AZ = {c: c + 32 for c in range(65, 91)}
_MASK = (1 << 64) - 1

#: From a row's id, what becomes of each of its words.
Alter = Callable[[int | None], Callable[[str], str]]


def dropped_letter(every: int = 199) -> Alter:
    """Of a word whose crc32 with its row's id divides by every, one code point goes: typing errors that one can count on."""

    def of(doc_id: int | None) -> Callable[[str], str]:
        begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

        def alter(word: str) -> str:
            h = zlib.crc32(word.encode(), begun)
            if h % every:
                return word
            at = h % len(word)
            return word[:at] + word[at + 1 :]

        return alter

    return of


def vocabulary(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, alter: Alter | None = None, id_col: str = "doc_id", text: str = "text", letters: str = LETTERS,
) -> DataFrame:
    """(word, n): maximal runs of letters in whole texts, A-Z lower-cased, of at least min_chars and min_count occurrences.

    alter may shorten a word by its row's id, but doesn't lengthen it. Counts are summed within tasks before the shuffle.
    """
    run_of = re.compile(f"[{letters}]{{{min_chars},}}")  # shorter runs hold no match

    def rows(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for part, texts in text_slices(batches, "text"):
            for doc_id, t in zip(part.column(0).to_pylist(), texts, strict=True):
                own = Counter(run_of.findall(t))
                altered = alter(doc_id) if alter is not None else None
                for word, n in own.items():
                    if not word.islower():
                        word = word.lower() if word.isascii() else word.translate(_AZ)
                    if altered is not None:
                        word = altered(word)
                        if len(word) < min_chars:
                            continue
                    found[word] += n
                if len(found) >= HELD:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _bucket(a: str, b: str) -> int:
    return (ord(a) * 0x9E3B + ord(b)) % COUNTERS


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of COUNTERS classes of bigrams stands in the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                found.update(map(_bucket, w, w[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["bucket", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in words.select("word").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def ranked(word: str, counts: np.ndarray) -> list[int]:
    """Positions of the word's grams, rarest first."""
    return sorted(range(len(word) - 1), key=lambda p: (counts[_bucket(word[p], word[p + 1])], word[p : p + 2], p))


def needed(length: int) -> int:
    """Grams that words one edit apart share at least; length: of the longer."""
    return length - Q + 1 - Q


def edit_place(x: str, y: str) -> int | None:
    """Where x, as long as y or one longer, differs from y by one replaced or one more code point; None: it doesn't."""
    if x == y:
        return None
    at = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(y))
    return at if x[at + 1 :] == y[at + (len(x) == len(y)) :] else None


#: The grams that name a list: of each its place in the word's order, twice, and 1 more if it is shifted.
Chosen = tuple[int, ...]


def packed(chosen: Chosen) -> int:
    """chosen as one number; places are less than Q + MOST, so each takes five bits."""
    code = 1
    for c in chosen:
        code = code << 5 | c
    return code


def unpacked(code: int) -> Chosen:
    out = []
    while code > 1:
        out.append(code & 31)
        code >>= 5
    return tuple(reversed(out))


def longer_lists(word: str, order: list[int], length: int, chosen: Chosen) -> Iterator[Chosen]:
    """chosen with one more gram, in all ways.

    Lists are of words of length and of one less; grams of the latter may stand one further on in the longer word, and do
    so behind any that does.
    """
    k, short = len(chosen) + 1, len(word) < length
    limit = min(Q + k - short, len(order))
    for j in range(chosen[-1] // 2 + 1 if chosen else 0, limit):
        for shift in (0, 1) if short else (0,):
            p = order[j]
            if all(c % 2 <= shift if order[c // 2] < p else c % 2 >= shift for c in chosen):
                yield (*chosen, 2 * j + shift)


def list_name(word: str, order: list[int], length: int, chosen: Chosen) -> int:
    """64 bits of the list's length and grams with their positions in the longer word, in order. Collisions only cost time."""
    name = length
    for c in chosen:
        p = order[c // 2]
        name = (name * 0x9E3779B97F4A7C15 + (ord(word[p]) << 42) + (ord(word[p + 1]) << 21) + p + c % 2 + 1) & _MASK
        name ^= name >> 29
    return name - (1 << 63)


def merged(members: dict[str, tuple[int, int]], length: int, counts: np.ndarray) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, n) for the pairs of one list that count here. members: word -> n, and its grams that name the list, packed."""
    words = sorted(members)
    postings: dict[tuple[bool, int, str], list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        for p in range(len(w) - 1):
            postings[len(w) < length, p, w[p : p + 2]].append(i)
    none: list[int] = []
    for i, x in enumerate(words):
        if len(x) != length:
            continue
        order, (n, code) = ranked(x, counts), members[x]
        own = unpacked(code)
        # all words of the list share the grams that name it, so the others decide
        rest = [(p, x[p : p + 2]) for p in set(range(length - 1)).difference(order[c // 2] for c in own)]
        least = needed(length) - len(own)
        lists = [later for p, g in rest if (found := postings.get((False, p, g), none)) and (later := found[bisect_right(found, i) :])]
        lists += [found for p, g in rest for at in (p, p - 1) if (found := postings.get((True, at, g)))]
        for j, came in groupby(merge(*lists)) if least > 0 else ((j, (j,)) for j in range(len(words))):
            y = words[j]
            if sum(1 for _ in came) < least or j <= i and len(y) == length:
                continue
            at = edit_place(x, y)
            if at is None:
                continue
            shared = [2 * k for k, p in enumerate(order) if not at - Q < p <= at]
            if tuple(shared[: len(own)]) == own:
                yield x, n, y, members[y][0]


_ENTRY = "name long, word string, n long, length int, chosen long"
_ENTRY_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, kinds, names)
            held = []
    yield _batch(held, kinds, names)


def near_pairs(words: DataFrame, size: int = LIST) -> DataFrame:
    """(word, n, near, near_n) for all pairs of words (word, n; a written table) one edit apart, each pair once, the longer first.

    The words are distinct, and have at least 2 * Q + 1 code points, so that words one edit apart share a gram.
    """
    counts = gram_counts(words)
    entry_names = [c.split()[0] for c in _ENTRY.split(", ")]
    pair_names, pair_kinds = ["word", "n", "near", "near_n"], [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    order = ranked(word, counts)
                    for length in (len(word), len(word) + 1):
                        chosen: list[Chosen] = [()]
                        for _ in range(FIRST):
                            chosen = [more for own in chosen for more in longer_lists(word, order, length, own)]
                        for own in chosen:
                            yield list_name(word, order, length, own), word, n, length, packed(own)

        yield from _batches(rows(), _ENTRY_TYPES, entry_names)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for word, n, length, chosen in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "length", "chosen")), strict=True):
                    order = ranked(word, counts)
                    for own in longer_lists(word, order, length, unpacked(chosen)):
                        yield list_name(word, order, length, own), word, n, length, packed(own)

        yield from _batches(rows(), _ENTRY_TYPES, entry_names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists come one after another. Pairs have no length; words of lists that are too large have no near word."""

        def entries() -> Iterator[tuple]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column("name").to_numpy()
                begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
                sizes = np.diff(np.append(begins, len(names)))
                longer = pc.equal(pc.utf8_length(batch.column("word")), batch.column("length")).to_numpy(zero_copy_only=False)
                # lists of one word, and of none of the greater length, have no pair; the batch's first and last may go on in others
                useful = (sizes > 1) & np.logical_or.reduceat(longer, begins)
                useful[[0, -1]] = True
                part = batch.filter(pa.array(np.repeat(useful, sizes)))
                yield from zip(*(part.column(c).to_pylist() for c in entry_names), strict=True)

        def rows() -> Iterator[tuple]:
            for _, own in groupby(entries(), key=lambda r: r[0]):
                members: dict[str, tuple[int, Chosen]] = {}
                held: list[tuple] = []
                split = False
                for _, word, n, length, chosen in own:
                    if split:
                        yield word, n, None, None, length, chosen
                        continue
                    held.append((word, n, length, chosen))
                    members[word] = n, chosen
                    if len(held) > size and len(unpacked(chosen)) < min(needed(length), MOST):
                        split = True
                        yield from ((w, m, None, None, l, c) for w, m, l, c in held)
                if not split and len(members) > 1:
                    length = held[0][2]
                    yield from ((*pair, None, None) for pair in merged(members, length, counts))

        yield from _batches(rows(), [*pair_kinds, *_ENTRY_TYPES[3:]], [*pair_names, *entry_names[3:]])

    found, left, out = "word string, n long, near string, near_n long, length int, chosen long", None, None
    while True:
        entries = words.select("word", "n").mapInArrow(enter, _ENTRY) if left is None else left.mapInArrow(extend, _ENTRY)
        table = written(entries.repartition("name").sortWithinPartitions("name").mapInArrow(compare, found), "lists")
        pairs = table.filter("length is null").select(*pair_names)
        out = pairs if out is None else out.unionByName(pairs)
        left = table.filter("length is not null")
        if left.isEmpty():
            return out


def variants(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words: the most frequent near word with at least ratio times its count.

    Form counts rise along a chain, so chains end; they are followed by pointer jumping, whatever their length. A word has few
    near words (a place and a letter each), so no group is large.
    """
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"),
    )
    formed = written(joined.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    ends, _ = followed(formed.filter("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")))
    ends = ends.select(F.col("from").alias("word"), F.col("to").alias("end"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, alter: Alter | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """variants() of the frequent words of docs."""
    if min_chars < 2 * Q + 1:
        raise ValueError(f"words need at least {2 * Q + 1} code points")
    words = written(vocabulary(docs, min_chars, min_count, alter, id_col, text), "words")
    return variants(words, near_pairs(words), ratio)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for all rows of docs."""
    return spelling_variants(docs, alter=dropped_letter())
