"""Fill-in-the-middle rewriting of texts by a table-driven automaton over their UTF-8 bytes.

One table, built by automaton(), maps (state, byte) to the next state and to what the transition emits: the end of a unit,
and the end of a sentinel. Its states know how many continuation bytes a character still needs, how much of a sentinel
has been read, and, for words and lines, whether a unit is open. So one scan finds characters, units and sentinels.

1. A scan counts. A batch's texts are cut into blocks of BLOCK bytes, and all blocks of the batch take a step at a time, each
   from every state that it may begin in; what a block did is then known by its first state, and a text's blocks are put
   together from left to right. This gives each text's units and sentinels and each block's first state and count.
2. The text's cuts, in units, are drawn from a hash of its id.
3. A second pass looks only at blocks that hold a cut, and finds the byte after which the unit ends.

The text is rewritten as bytes, so it is never decoded. restored() undoes it: the same scan finds the sentinels, of which
a rewritten text has just its own three, as texts that hold one stay plain.

Units: "char" (code points), "word" (a run of other than white space with the white space after it; white space that a text
begins with is one, too) and "line" (up to and with its line feed). What follows the last whole unit belongs to the suffix.

Defined results: a null text is empty; empty texts, texts that hold a sentinel and the share that the hash says stay plain;
a null id hashes as no digits; repeated rows come out alike; very long texts take as many blocks as they need; a byte
that is no UTF-8 joins the character after it; an empty table gives no rows; columns that clash with those added are
an error that names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: Fixed by the contract, in the order prefix, suffix, middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Bytes of a block: steps that one scan takes.
BLOCK = 512
#: Bytes and rows of texts that are scanned together.
SCAN_BYTES, SCAN_ROWS = 4 << 20, 4096
#: Stands behind a text's last byte in its last block; it is in no UTF-8 text, and no state moves on it.
PAD = 0xFF

_UNIT, _SENTINEL = 1 << 12, 1 << 24  # a block has less than 2**12 units
_STATE = _UNIT - 1
_ADDED = "n long, form string, prefix_chars long, middle_chars long, rewritten string"


class Automaton:
    """table[state * 256 + byte]: next state * 256, plus _UNIT where a unit has just ended, plus _SENTINEL where a sentinel has.

    For words a unit ends before the byte that is read (late), else with it.
    """

    def __init__(self, unit: str = "char", sentinels: tuple[bytes, ...] = SENTINELS):
        if unit not in ("char", "word", "line"):
            raise ValueError(f"no such unit: {unit}")
        if any(b >= 0x80 for s in sentinels for b in s):
            raise ValueError("sentinels are ASCII")
        self.unit, self.late = unit, unit == "word"
        # a state: (continuation bytes that are due, what has been read of sentinels, in the white space after a word)
        begin = (0, b"", False)
        states, rows = {begin: 0}, []
        todo = [begin]
        for state in todo:  # grows as states are met
            row = []
            for byte in range(256):
                after, emits = self._step(state, byte, sentinels)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append(states[after] * 256 + emits)
            rows.append(row)
        self.states, self.table = len(states), np.array(rows, np.int32).reshape(-1)
        if self.states * 256 > _UNIT:
            raise ValueError("sentinels have too many letters")

    def _step(self, state: tuple[int, bytes, bool], byte: int, sentinels: tuple[bytes, ...]) -> tuple[tuple[int, bytes, bool], int]:
        due, read, gap = state
        if byte == PAD:
            return state, 0
        if 0x80 <= byte < 0xC0 and due:
            whole = due == 1
            return (due - 1, b"", False), _UNIT if whole and self.unit == "char" else 0
        if byte >= 0x80:
            due = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
            return (due, b"", False), _UNIT if gap and self.late else 0
        own = read + bytes([byte])
        while own and not any(s.startswith(own) for s in sentinels):
            own = own[1:]
        emits = _SENTINEL if own in sentinels else 0
        own = b"" if own in sentinels else own
        space = byte == 0x20 or 0x09 <= byte <= 0x0D
        if self.unit == "char" or self.unit == "line" and byte == 0x0A or self.late and gap and not space:
            emits += _UNIT
        return (0, own, self.late and space), emits

    def scan(self, blocks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """blocks: rows of BLOCK bytes. starts: the number of the first block of each text, and that of all blocks.

        Each block's first state and the units before it in its text, each text's units and sentinels, and its last state.
        """
        n = len(blocks)
        state = np.repeat(np.arange(self.states, dtype=np.int32) * 256, n).reshape(self.states, n)
        done = np.zeros_like(state)
        step = np.empty_like(state)
        for column in np.ascontiguousarray(blocks.T):
            state += column
            np.take(self.table, state, out=step, mode="clip")
            np.bitwise_and(step, _STATE, out=state)
            step >>= 12
            done += step
        state >>= 8
        first, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        units, found, last = (np.zeros(len(starts) - 1, np.int64) for _ in range(3))
        # the k-th blocks of all texts together
        sizes, alive, k = np.diff(starts), np.arange(len(starts) - 1), 0
        while len(alive := alive[sizes[alive] > k]):
            at = starts[alive] + k
            first[at], before[at] = last[alive], units[alive]
            own = done[last[alive], at]
            units[alive] += own & 0xFFF
            found[alive] += own >> 12
            last[alive] = state[last[alive], at]
            k += 1
        return first, before, units, found, last

    def ends(self, blocks: np.ndarray, first: np.ndarray, wanted: np.ndarray, event: int = _UNIT) -> np.ndarray:
        """Of each block, from its first state, the number of bytes up to the end of its wanted-th event, from 1."""
        state, seen, at = first * 256, np.zeros(len(blocks), np.int64), np.full(len(blocks), -1, np.int64)
        for k, column in enumerate(np.ascontiguousarray(blocks.T)):
            step = self.table[state + column]
            state = step & _STATE
            seen += (step // event) & 1
            at[(at < 0) & (seen == wanted)] = k + 1
        return at - (self.late and event == _UNIT)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and the last ends; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most SCAN_ROWS rows and about SCAN_BYTES of text, or one row, with _raw() of them."""
    for batch in batches:
        raw, offsets = _raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + SCAN_BYTES, "right")) - 1, at + SCAN_ROWS, batch.num_rows))
            yield batch.slice(at, end - at), raw, offsets[at : end + 1]
            at = end


def _blocks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in rows of BLOCK bytes, padded, and where each text's rows begin and all end."""
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))]).astype(np.int64)
    out = np.full(int(starts[-1]) * BLOCK, PAD, np.uint8)
    for at, i, j in zip((starts[:-1] * BLOCK).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[at : at + j - i] = raw[i:j]
    return out.reshape(-1, BLOCK), starts


def _places(auto: Automaton, blocks: np.ndarray, starts: np.ndarray, first: np.ndarray, before: np.ndarray, texts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each of texts (numbers of texts, ascending) the bytes up to the end of its wanted-th unit; 0: none."""
    at = np.zeros(len(texts), np.int64)
    own = np.flatnonzero(wanted > 0)
    if not len(own):
        return at
    t, w = texts[own], wanted[own]
    # the last block of the text before which fewer than w units have ended
    span = int(before.max()) + 1
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    block = np.searchsorted(of * span + before, t * span + np.minimum(w, span), "left") - 1
    at[own] = (block - starts[t]) * BLOCK + auto.ends(blocks[block], first[block], w - before[block])
    return at


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32: 8-digit groups of the hex sha256 of the seed, a colon and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rewritten(
    docs: DataFrame, unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (units; null: plain) and rewritten.

    rate percent of texts are rewritten, and spm percent of those have their suffix first. One pass, no shuffle.
    """
    _unused(docs, _ADDED)
    auto = Automaton(unit)
    names = [f.name for f in docs.schema]
    drawn = free(docs, "draw_0", "draw_1", "draw_2", "draw_3")
    own = docs.select("*", *[d.alias(c) for c, d in zip(drawn, draws(F.col(id_col), seed), strict=True)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _ADDED
    tags = [np.frombuffer(s, np.uint8) for s in SENTINELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _slices(batches, text):
            h = [part.column(c).to_numpy() for c in drawn]
            blocks, starts = _blocks(raw, offsets)
            first, before, n, found, _ = auto.scan(blocks, starts)
            sizes = np.diff(offsets)
            plain = (sizes == 0) | (found > 0) | (h[2] % 100 >= rate)
            turned = np.flatnonzero(~plain)
            a, b = h[0][turned] % (n[turned] + 1), h[1][turned] % (n[turned] + 1)
            low, high = np.minimum(a, b), np.maximum(a, b)
            p = _places(auto, blocks, starts, first, before, turned, low)
            m = _places(auto, blocks, starts, first, before, turned, high)
            form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
            cuts = {t: (int(x), int(y)) for t, x, y in zip(turned.tolist(), p, m, strict=True)}
            out = []
            for t, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if t not in cuts:
                    out.append(raw[i:j].tobytes())
                    continue
                x, y = i + cuts[t][0], i + cuts[t][1]
                sides = (tags[0], raw[i:x]), (tags[1], raw[y:j])
                out.append(np.concatenate([v for side in (sides if form[t] == "psm" else sides[::-1]) for v in side] + [tags[2], raw[x:y]]).tobytes())
            counts = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            counts[0][turned], counts[1][turned] = low, high - low
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names]
                + [pa.array(n), pa.array(form.tolist(), pa.string()), *[pa.array(c, mask=plain) for c in counts], pa.array(out, pa.binary()).view(pa.string())],
                names=[*names, "n", "form", "prefix_chars", "middle_chars", "rewritten"],
            )

    return own.mapInArrow(run, schema)


def restored(texts: DataFrame, form: str = "form", text: str = "rewritten") -> DataFrame:
    """texts with restored: the text that rewritten() got, from its output and form alone."""
    _unused(texts, "restored string")
    auto = Automaton()
    names = texts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _slices(batches, text):
            forms = part.column(form).to_pylist()
            blocks, starts = _blocks(raw, offsets)
            first, *_ = auto.scan(blocks, starts)
            ends = _sentinels(auto, blocks, starts, first, np.array([f not in (None, "plain") for f in forms]))
            out = []
            for t, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if t not in ends:
                    out.append(raw[i:j].tobytes())
                    continue
                # the first sentinel begins the text; the others end the first and the second part
                _, second, third = (i + e for e in ends[t])
                one, two, middle = raw[i + 3 : second - 3], raw[second : third - 3], raw[third:j]
                out.append(np.concatenate([one, middle, two] if forms[t] == "psm" else [two, middle, one]).tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary()).view(pa.string())], names=[*names, "restored"])

    return texts.mapInArrow(run, schema)


def _sentinels(auto: Automaton, blocks: np.ndarray, starts: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> dict[int, tuple[int, ...]]:
    """By text, of those wanted, the bytes up to the end of each of its three sentinels."""
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    mine = np.flatnonzero(wanted[of])
    state, rows, at = first[mine] * 256, [], []
    for k, column in enumerate(np.ascontiguousarray(blocks[mine].T)):
        step = auto.table[state + column]
        state = step & _STATE
        hit = np.flatnonzero(step >= _SENTINEL)
        rows.append(mine[hit])
        at.append((mine[hit] - starts[of[mine[hit]]]) * BLOCK + k + 1)
    ends: dict[int, tuple[int, ...]] = {}
    for end, t in sorted(zip(np.concatenate(at).tolist(), of[np.concatenate(rows)].tolist(), strict=True)) if rows else []:
        ends[t] = (*ends.get(t, ()), end)
    for t, own in ends.items():
        if len(own) != len(SENTINELS):
            raise ValueError(f"a rewritten text has {len(own)} sentinels")
    return ends


def _unused(df: DataFrame, added: str) -> None:
    clash = {c.lower() for c in df.columns} & {c.split()[0] for c in added.split(", ")}
    if clash:
        raise ValueError(f"columns are in the way: {sorted(clash)}")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for all rows of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    turned = rewritten(own).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "rewritten")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    out = restored(turned)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("rewritten").alias("output_sha256"), sha("restored"))
