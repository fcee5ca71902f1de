"""Byte-level BPE encoding and decoding as a monoid over texts.

An element is an encoded text: its pieces (matches of the splitting pattern), which are the seams, and each piece's
tokens. Encoding halves the text down to leaves of LEAF code points, whatever its length, then joins neighbours. A join
encodes a window around the boundary again; it grows to the right until a piece's end falls on an end of the right-hand
side's pieces. What is outside is provably stable where a match depends only on what follows its start and looks at
most `ahead` code points beyond its end, which is so for the patterns in LOOKS_AHEAD:

* a left piece with `ahead` code points of the left text behind it stays;
* once the window and the right-hand side agree on one start, all later pieces agree.

A long piece is encoded in the same way with merges in place of pieces: halves down to MERGE_LEAF bytes are merged by
rank, and two halves' tokens are joined by encoding a window around the boundary again, which grows to the left and
moves on to the right until the tokens at both seams are compatible (encoding the two tokens' bytes gives these two
tokens). A sequence of tokens whose neighbours are all compatible is the encoding of its bytes, so tokens outside are
stable.

Decoding maps halves of the ids to bytes and concatenates up the tree.

The ranks travel to the executors with the job; no file is opened there, and no tokenizer library takes part.

Defined results: null counts as empty, with no tokens; special tokens are ordinary text; lone surrogates can't occur
in Spark strings; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
A pattern that isn't in LOOKS_AHEAD needs `ahead`, else ValueError; an id that the vocabulary lacks is a ValueError
that names it, and null ids count as empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Code points of a leaf, bytes of a piece's leaf, tokens by which a window moves on at most, ids of a decoding leaf, pieces
#: that a worker remembers.
LEAF, MERGE_LEAF, WINDOW, DECODE_LEAF, REMEMBERED = 1024, 64, 32, 512, 400_000
#: Windows of long pieces that a worker remembers, and their bytes.
REMEMBERED_WINDOWS, REMEMBERED_BYTES = 4096, 2048
#: Bytes that are merged by lists rather than by a heap, and a rank above all.
SHORT, _NONE = 96, 1 << 60
#: Public splitting patterns, with how many code points beyond its end a match may look at. Runs of spaces
#: look at the space that they leave and at what follows it; an apostrophe looks at the two letters of a contraction.
LOOKS_AHEAD = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": 2}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


#: An encoded text: pieces and their tokens, of one length.
Element = tuple[list[str], list[tuple[int, ...]]]


class Codec:
    """Encoder and decoder of one vocabulary. ranks: bytes -> id; pattern: splits texts; leaf, merge_leaf: sizes of leaves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, ahead: int | None = None, leaf: int | None = None, merge_leaf: int | None = None):
        if ahead is None and pattern not in LOOKS_AHEAD:
            raise ValueError("how far the pattern looks ahead isn't known; state it as ahead")
        self.ahead = LOOKS_AHEAD[pattern] if ahead is None else ahead
        self.leaf, self.merge_leaf = leaf or LEAF, merge_leaf or MERGE_LEAF
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.windows: dict[bytes, list[int]] = {}

    # pieces -----------------------------------------------------------------------------------------------------

    def piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern."""
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = (self.ranks[raw],) if raw in self.ranks else tuple(self._merge_tree(raw))
            if len(raw) <= self.merge_leaf:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Single bytes merged by rank, the lowest first and of equal ones the leftmost."""
        return self._merge_short(raw) if len(raw) <= SHORT else self._merge_long(raw)

    def _merge_short(self, raw: bytes) -> list[int]:
        """By the least of all neighbours' ranks, which lists find fast where there are few."""
        rank, starts = self.ranks.get, list(range(len(raw) + 1))
        ranks = [rank(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            del starts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(raw[starts[i - 1] : starts[i + 1]], _NONE)
            if i < len(ranks):
                ranks[i] = rank(raw[starts[i] : starts[i + 2]], _NONE)
        return [self.ranks[raw[a:b]] for a, b in pairwise(starts)]

    def _merge_long(self, raw: bytes) -> list[int]:
        """By a heap of neighbours' ranks."""
        rank, n = self.ranks.get, len(raw)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part's end is the next one's start
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n + [False]
        while heap:
            _, i, j, end = heappop(heap)
            if not alive[i] or ends[i] != j or not alive[j] or ends[j] != end:
                continue  # one of the two parts has been merged since
            alive[j], ends[i] = False, end
            if end < n:
                before[end] = i
                if (r := rank(raw[i : ends[end]])) is not None:
                    heappush(heap, (r, i, end, ends[end]))
            if (p := before[i]) >= 0 and (r := rank(raw[p:end])) is not None:
                heappush(heap, (r, p, i, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : ends[at]]])
            at = ends[at]
        return out

    def _merge_tree(self, raw: bytes) -> list[int]:
        if len(raw) <= self.merge_leaf:
            return list(self._window(raw))
        half = self.merge_leaf
        while 2 * half < len(raw):  # leaves begin at multiples of their size, so those of a run are alike
            half *= 2
        return self._merge_join(self._merge_tree(raw[:half]), self._merge_tree(raw[half:]))

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _window(self, raw: bytes) -> list[int]:
        """merge(), remembered: the windows and leaves of a run are alike."""
        found = self.windows.get(raw)
        if found is None:
            found = self.merge(raw)
            if len(raw) <= REMEMBERED_BYTES:
                if len(self.windows) >= REMEMBERED_WINDOWS:
                    self.windows.clear()
                self.windows[raw] = found
        return found

    def _merge_join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbours together; left is extended in place."""
        at, k = 0, 1
        while at < len(right) and not (left and self.compatible(left[-1], right[at])):
            back, to = 1, min(len(right), at + k)
            while True:
                i = max(0, len(left) - back)
                mid = self._window(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[at:to])))
                if i == 0 or self.compatible(left[i - 1], mid[0]):
                    break
                back *= 2
            left[i:] = mid
            at, k = to, min(2 * k, WINDOW)
        left += right[at:]
        return left

    # texts ------------------------------------------------------------------------------------------------------

    def element(self, text: str) -> Element:
        """The encoded text, by the tree."""
        if len(text) <= self.leaf:
            pieces = self.split(text)
            return pieces, self._tokens(pieces)
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    def _tokens(self, pieces: list[str]) -> list[tuple[int, ...]]:
        known, piece = self.known.get, self.piece
        return [known(p) or piece(p) for p in pieces]

    def join(self, left: Element, right: Element) -> Element:
        """The encoded text of two neighbouring ones together; left is extended in place."""
        (pieces, ids), (more, more_ids) = left, right
        keep, n = len(pieces), 0
        while keep and n < self.ahead:  # a left piece stays if as many code points of left follow it
            keep -= 1
            n += len(pieces[keep])
        head = "".join(pieces[keep:])
        k = 2
        while True:
            taken = more[:k]
            window = self.split(head + "".join(taken))
            used = len(window) if k >= len(more) else None
            skip = min(k, len(more))
            if used is None:
                ends, at = {}, len(head)
                for i, p in enumerate(taken, 1):
                    at += len(p)
                    ends[at] = i
                limit, at = at - self.ahead, 0
                for i, p in enumerate(window, 1):
                    at += len(p)
                    if at > limit:
                        break
                    if at in ends:
                        used, skip = i, ends[at]
                        break
            if used is not None:
                pieces[keep:], ids[keep:] = window[:used], self._tokens(window[:used])
                pieces += more[skip:]
                ids += more_ids[skip:]
                return left
            k *= 2

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return list(chain.from_iterable(self.element(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; ValueError for an id that the vocabulary lacks."""
        try:
            return self._decode(ids)
        except KeyError as missing:
            raise ValueError(f"the vocabulary has no id {missing.args[0]}") from missing

    def _decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self._decode(ids[:half]) + self._decode(ids[half:])


_codecs: dict[tuple[bytes, str, int | None], Codec] = {}


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """The rank file's bytes, read on the driver and sent to each executor once: about 1 MB for 50,000 tokens."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def codec(blob: bytes, pattern: str, ahead: int | None = None) -> Codec:
    """One codec a Python worker."""
    key = (hashlib.sha256(blob).digest(), pattern, ahead)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(blob), pattern, ahead)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", ahead: int | None = None) -> DataFrame:
    """Per row: id and ids array<int>. One pass, no shuffle; a worker holds one slice of texts and the vocabulary."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, ahead)
        for part, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ahead: int | None = None) -> DataFrame:
    """Per row: id and the decoded bytes."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, ahead)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([own.decode(i or []) for i in part.column(1).to_pylist()], pa.binary())],
                    names=[id_col, "decoded"],
                )

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", ahead: int | None = None) -> DataFrame:
    """Encode, decode the ids, and return the digests of both in one pass."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, ahead)
        for part, texts in text_slices(batches, text):
            rows = []
            for t in texts:
                ids = own.encode(t)
                rows.append(
                    (
                        len(ids), hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest(),
                        hashlib.sha256(own.decode(ids)).hexdigest(),
                    )
                )
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counts(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...], text: str = "text", ahead: int | None = None) -> DataFrame:
    """columns of each row and tokens, its number of tokens."""
    shared = _shared(docs, path)
    kept = docs.select(*columns, F.col(text))
    schema = kept.select(*columns, F.lit(None).cast("long").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, ahead)
        for part, texts in text_slices(batches, text):
            n = [sum(map(len, own.element(t)[1])) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "tokens"])

    return kept.mapInArrow(run, schema)
