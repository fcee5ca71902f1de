"""Packing token sequences of documents into as few training sequences as best fit finds, by hierarchical residual packing.

1. Each text becomes its tokenizer's ids and one end id; longer documents are cut into pieces of a whole sequence's size,
   whose last piece may be shorter. A piece is one row with its place and its ids' crc32 (and the ids, if asked for).
2. Each task packs its own pieces by best fit in decreasing order: the fullest bin that still has room takes the next piece.
   Bins with at most SLACK places left are emitted; they are final.
3. Underfull bins are items of their fill's length in the next round. Rounds deal them to ever fewer groups of about ITEMS
   items, which pack them by best fit again, until one group is left, or until a round over several groups merges less than
   one in twenty of them (groups of one mixture can't do better by being dealt anew).
4. A bin's place in its sequence is the sum of places up the tree. The chains are composed from the top down over the small
   tables of underfull bins, and pieces meet them in one join.

No task holds more than ITEMS lengths at a time, nothing but row counts reaches the driver, and no text or id is shuffled.

Defined results: a null or empty text is the end id alone; rows that share an id, and rows with a null id, are documents of
their own; ties in length keep the order of rows; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_slices, written

#: Tokens of a sequence.
SIZE = 2048
#: A bin with at most so many places left is nearly full, and final.
SLACK = 4
#: Lengths that one call of best fit takes.
ITEMS = 1 << 16
#: Words whose ids a Python worker remembers (about 100 MB), and bytes of a word that is remembered.
WORDS, WORD_BYTES = 1 << 19, 64
#: Bytes of a text that are cut into words at a time.
WINDOW = 1 << 20
#: A round over several groups has to merge one in so many items to be followed by another.
GAIN = 20

_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = "bin long, `offset` long, fill long"


class Words:
    """ids of whole texts by a tokenizer that never lets a token cross ASCII white space, a word at a time.

    Such tokenizers (white space is dropped or ends a word) give each run of other characters its own ids, so runs that
    were met before come from a table. split=False is for any other tokenizer: whole texts are given to it.
    """

    def __init__(self, path: str, split: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.known = Tokenizer.from_file(path), split, {}
        marks = [(k, t) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (marks[0][0], marks[0][1].content) if marks else (None, "")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        """ids of each word, from one text in which a special token, which no word holds, stands between them."""
        if self.mark_id is None or any(self.mark in w for w in words):
            return self._ids(words)
        ids = np.frombuffer(self._ids([self.mark.join(words)])[0], "<u4")
        ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
        if len(ends) != len(words):
            return self._ids(words) if words else []
        return [ids[a:b].tobytes() for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]

    def __call__(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, in parts."""
        if not self.split:
            yield from self._ids([text])
            return
        raw, at = text.encode("utf-8", "replace"), 0
        while at < len(raw):
            stop = _SPACE.search(raw, at + WINDOW)
            end = stop.start() if stop else len(raw)
            words = raw[at:end].split()
            new = [w for w in set(words) if w not in self.known]
            if len(self.known) + len(new) > WORDS:
                self.known, new = {}, list(set(words))
            own = self.known
            once = {}
            for w, ids in zip(new, self._each([w.decode() for w in new]), strict=True):
                (own if len(w) <= WORD_BYTES else once)[w] = ids
            yield b"".join([own[w] if w in own else once[w] for w in words] if once else [own[w] for w in words])
            at = end


@lru_cache(2)
def words_of(path: str, split: bool = True) -> Words:
    """One table for all tasks that a Python worker runs."""
    return Words(path, split)


def cut(parts: Iterator[bytes], end_id: int, size: int) -> Iterator[bytes]:
    """Pieces of at most size ids, 4 bytes each, of a text's ids and the end id."""
    held = b""
    for part in parts:
        held += part
        whole = len(held) - len(held) % (4 * size)
        for i in range(0, whole, 4 * size):
            yield held[i : i + 4 * size]
        held = held[whole:]
    yield held + np.array([end_id], "<u4").tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, ids: bool = False, split: bool = True, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each row; ids are packed as unsigned 32-bit numbers.

    tokenizer: a tokenizers file that every executor can read at that path.
    """
    schema = _PIECE + (", ids binary" if ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words_of(tokenizer, split)
        for part, texts in text_slices(batches, "text"):
            rows = []
            for doc_id, t in zip(part.column(0).to_pylist(), texts, strict=True):
                at = 0
                for k, own in enumerate(cut(encode(t), end_id, size)):
                    rows.append((doc_id, k, at, len(own) // 4, zlib.crc32(own)) + ((own,) if ids else ()))
                    at += len(own) // 4
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and its place there, and each bin's fill: best fit in decreasing order of length, ties by position.

    Bins are stacked by the room that they have left; a number's bits say which stacks aren't empty.
    """
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    some, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = some >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += length
        if room > length:
            by_room[room - length].append(b)
            some |= 1 << (room - length)
    return bins, places, np.array(fills, np.int64)


def _round(items: DataFrame, level: int, size: int) -> DataFrame:
    """items with bin, offset and the bin's fill; each task packs its rows, ITEMS at a time. items has a column length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", " + _BIN

    def pack(held: list[pa.RecordBatch], task: int, made: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(held).combine_chunks()
        bins, places, fills = best_fit(table.column("length").to_numpy(), size)
        own = (level << 57) + (task << 33) + made + bins  # tasks below 2**24, bins of a task below 2**33
        for name, values in (("bin", own), ("offset", places), ("fill", fills[bins] if len(bins) else bins)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.to_batches()[0], made + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, n, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                if n + part.num_rows > ITEMS:
                    out, made = pack(held, task, made)
                    yield out
                    n, held = 0, []
                if part.num_rows:
                    held.append(part)
                    n += part.num_rows
        if held:
            yield pack(held, task, made)[0]

    return items.mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = SIZE, slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a written table with a column length, 1 to size; other columns stay.

    Sequences are gapless from offset 0. A table that isn't written would be computed once for each round.
    """
    first = written(_round(pieces, 0, size), "packed-0")
    tables, left, groups, before = [], first, None, None
    while groups != 1:
        underfull = left.filter((F.col("offset") == 0) & (F.col("fill") < size - slack))
        underfull = underfull.select(F.col("bin").alias("id"), F.col("fill").alias("length"))
        n = underfull.count()
        if n < 2 or before is not None and n * GAIN > before * (GAIN - 1):
            break
        groups, before = -(-n // items), n
        left = written(_round(underfull.repartition(groups, "id"), len(tables) + 1, size), f"packed-{len(tables) + 1}")
        tables.append(left)
    chains = None
    for table in reversed(tables):
        step = table.select("id", "bin", "offset")
        if chains is not None:
            up = chains.select(F.col("id").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("more"))
            step = step.join(up, "bin", "left").select("id", F.coalesce("top", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        chains = step
    own = [c for c in pieces.columns]
    if chains is None:
        return first.select(*own, F.col("bin").alias("sequence_id"), "offset")
    chains = written(chains, "chains")
    discard(*tables)
    up = chains.select(F.col("id").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("more"))
    return first.join(up, "bin", "left").select(
        *own, F.coalesce("top", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, starts): each sequence's ids in order, with its documents' ids and where each begins.

    packed: pack() of token_pieces(ids=True). A sequence has at most its size of ids, so no group is large.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("rows"))
    return rows.select(
        "sequence_id", F.aggregate("rows.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
        F.aggregate("rows.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("starts"),
    )


def digest(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The contract's columns for all rows of docs."""
    return pack(written(token_pieces(docs, tokenizer, size=size), "pieces"), size)
