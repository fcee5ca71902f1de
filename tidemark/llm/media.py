"""Media columns: baseline JPEG files that carry a payload losslessly, and DC-only features read back from them.

Storing: the unit of storage is the quantised coefficient: each payload byte is one coefficient of a three-component
(4:4:4) baseline image, 64 to a block and 192 to a unit of three blocks. No byte maps to a zero coefficient. The Huffman
tables are chosen so that code and extra bits of every symbol fill whole bytes, so numpy writes a scan at once. A comment
segment states the payload's length; the grid's spare blocks hold byte 32. A restart marker follows every RESTART units.

Reading takes any baseline file: markers are parsed, and the scan is cut at its restart markers into segments, which can
be decoded each by itself. Segments of all files of a batch are Huffman-decoded side by side, one symbol of each in a
step of numpy, with the tables that the files state; DC differences are summed within segments. Sampling of components
(4:4:4, 4:2:0, others), zero runs, ends of blocks, grey images and files without restart markers are read.

Features come from DC coefficients of the luminance component alone: they are dequantised to a thumbnail of one
pixel a block, which is averaged down to 8 x 8 and hashed.

Defined results: a null text counts as empty (192 bytes of 32); equal texts give equal bytes and features; repeated rows
give repeated results; other columns are ignored; an empty table gives an empty result. A file that is null, cut,
damaged or no baseline JPEG has null in all columns that are read from it; a baseline file without the comment has
features, and no payload.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

UNIT, RESTART = 192, 4
#: Order in which a block's coefficients are stored; the payload is laid out in this order, so no reordering is needed.
_QUANT = 8


def _value_tables() -> tuple[np.ndarray, np.ndarray]:
    """byte -> coefficient and back: 1..127 and -1..-127 for bytes 0..253, -128 and 128 for 254 and 255."""
    to = np.empty(256, np.int16)
    for b in range(254):
        to[b] = b // 2 + 1 if b % 2 == 0 else -(b // 2 + 1)
    to[254], to[255] = -128, 128
    back = np.zeros(257, np.uint8)  # index: value + 128
    back[to + 128] = np.arange(256)
    return to, back


TO_VALUE, TO_BYTE = _value_tables()


def _category(v: int) -> int:
    return abs(v).bit_length()


def _extra(v: int, size: int) -> int:
    return v if v > 0 else v + (1 << size) - 1


#: Symbols by code length. AC: (run 0, size s) takes 8 - s bits for s up to 7, and (0, 8) eight. DC: size s takes 16 - s.
AC_LENGTHS = {s: 8 - s for s in range(1, 8)} | {8: 8}
DC_LENGTHS = {s: 16 - s for s in range(0, 10)}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as a JPEG decoder derives them from a DHT segment."""
    codes, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], -x[0])):
        code <<= n - last
        codes[symbol] = (code, n)
        code, last = code + 1, n
    return codes


AC_CODES, DC_CODES = canonical(AC_LENGTHS), canonical(DC_LENGTHS)


def _ac_words() -> tuple[np.ndarray, np.ndarray]:
    """For each byte of payload, the code word of its coefficient and whether that is two bytes long."""
    out, wide = np.zeros(256, np.uint16), np.zeros(256, bool)
    for b in range(256):
        v = int(TO_VALUE[b])
        s = _category(v)
        code, n = AC_CODES[s]
        out[b], wide[b] = code << s | _extra(v, s), n + s == 16
    return out, wide


def _dc_words() -> np.ndarray:
    """index diff + 256 -> 16-bit word."""
    out = np.zeros(513, np.uint16)
    for v in range(-256, 257):
        s = _category(v)
        code, _ = DC_CODES[s]
        out[v + 256] = code << s | (_extra(v, s) if s else 0)
    return out


AC_WORD, AC_WIDE = _ac_words()
DC_WORD = _dc_words()


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], -s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    body = bytes([kind]) + counts + bytes(order)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


#: Bytes that one group of segments may hold while it is decoded: eight times as much is in memory.
GROUP_BYTES = 8 << 20
_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([_QUANT]) * 64)
_TABLES = _dht(0x00, DC_LENGTHS) + _dht(0x10, AC_LENGTHS)
_SOS = _segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))


def pad(raw: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of UNIT."""
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def encode_jpeg(payload: bytes) -> bytes:
    """A baseline JPEG whose quantised coefficients are the payload's bytes."""
    units = len(payload) // UNIT
    across = min(units, math.isqrt(units - 1) + 1)
    down = -(-units // across)
    filled = payload + b" " * (across * down * UNIT - len(payload))
    blocks = np.frombuffer(filled, np.uint8).reshape(-1, 3, 64)
    dc = TO_VALUE[blocks[:, :, 0]].astype(np.int32)
    diff = np.diff(dc, axis=0, prepend=np.zeros((1, 3), np.int32))
    diff[::RESTART] = dc[::RESTART]  # after a restart marker the prediction is 0
    # two bytes a coefficient, of which the first is used for DC and for wide words, and two a unit for its marker
    pairs, use = np.zeros((len(blocks), 194, 2), np.uint8), np.zeros((len(blocks), 194, 2), np.uint8)
    words = AC_WORD[blocks]
    words[:, :, 0] = DC_WORD[diff + 256]
    wide = AC_WIDE[blocks]
    wide[:, :, 0] = True
    pairs[:, :192, 0], pairs[:, :192, 1] = (words >> 8).reshape(-1, 192), (words & 255).reshape(-1, 192)
    use[:, :192, 0], use[:, :192, 1] = wide.reshape(-1, 192), 1
    use += (pairs == 255) & (use == 1)  # byte 255 is followed by a 0
    at = np.arange(RESTART - 1, len(blocks) - 1, RESTART)
    pairs[at, 192, 1], pairs[at, 193, 1] = 255, 0xD0 + np.arange(len(at)) % 8
    use[at, 192, 1], use[at, 193, 1] = 1, 1
    flat, times = pairs.ravel(), use.ravel()
    scan = np.repeat(flat, times)
    scan[np.cumsum(times)[times == 2] - 1] = 0
    comment = _segment(0xFE, b"payload-bytes=%d" % len(payload))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return _HEAD + comment + frame + _TABLES + _segment(0xDD, struct.pack(">H", RESTART)) + _SOS + scan.tobytes() + b"\xff\xd9"


@dataclass
class Component:
    """A component of the frame: blocks across and down in a unit, and numbers of its tables."""

    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Parsed:
    """What the markers say. huffman: (class, id) -> counts by length and symbols, as stored; segments: without stuffing."""

    width: int = 0
    height: int = 0
    quant: dict[int, bytes] = field(default_factory=dict)
    huffman: dict[tuple[int, int], bytes] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)
    payload_bytes: int | None = None
    restart: int = 0
    segments: list[bytes] = field(default_factory=list)

    @property
    def layout(self) -> list[int]:
        """The component of each block of a unit."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.across * c.down)]

    @property
    def grid(self) -> tuple[int, int]:
        """Units across and down."""
        most = (1, 1) if len(self.components) == 1 else (max(c.across for c in self.components), max(c.down for c in self.components))
        return -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))


_MARK = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Parsed:
    """Read a baseline file's markers; ValueError where it isn't one, or is cut."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as cut:
        raise ValueError("the file is cut") from cut


def _parse(data: bytes) -> Parsed:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    got, at, ids = Parsed(), 2, []
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if len(body) != n - 2:
            raise ValueError("the file is cut")
        at += 2 + n
        if marker == 0xFE and (stated := re.fullmatch(rb"payload-bytes=(\d{1,18})", body)):
            got.payload_bytes = int(stated[1])
        elif marker == 0xDB:
            while body:
                if body[0] >> 4 or len(body) < 65:
                    raise ValueError("not baseline")
                got.quant[body[0]], body = body[1:65], body[65:]
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                got.huffman[body[0] >> 4, body[0] & 15], body = body[1:m], body[m:]
        elif marker == 0xDD:
            got.restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            bits, got.height, got.width, count = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(count)]
            got.components = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            if bits != 8 or not got.height or not got.width or not count or any(not 1 <= x <= 4 for c in got.components for x in (c.across, c.down)):
                raise ValueError("not baseline")
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if body[0] != len(ids) or not ids:
                raise ValueError("only files of one scan are read")
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            for c, own in zip(ids, got.components, strict=True):
                if c not in tables or own.quant not in got.quant or (0, tables[c] >> 4) not in got.huffman or (1, tables[c] & 15) not in got.huffman:
                    raise ValueError("a table is missing")
                own.dc, own.ac = tables[c] >> 4, tables[c] & 15
            break
    end = data.rfind(b"\xff\xd9")
    if end < at:
        raise ValueError("the file is cut")
    got.segments = [x.replace(b"\xff\0", b"\xff") for x in _MARK.split(data[at:end])]
    across, down = got.grid
    if len(got.segments) != (-(-across * down // got.restart) if got.restart else 1):
        raise ValueError("restart markers are missing")
    return got


@functools.lru_cache(maxsize=64)
def lookup(stored: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code that they begin with; 0 where there is none. stored: as in DHT."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length, count in enumerate(stored[:16], 1):
        for symbol in stored[at : at + count]:
            if code >> length:
                raise ValueError("a Huffman table is overfull")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_segments(segments: list[bytes], blocks: list[int], tables: np.ndarray, layout: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (all blocks, 64) in stored order, with DC differences; which segments are whole).

    blocks: number of blocks of each segment; tables: lookup() arrays one after another; layout: for each block of a
    unit the numbers of its DC and AC tables. Each step decodes one symbol of every segment that isn't done.
    """
    held = b"".join(x + bytes(8) for x in segments) + bytes(8)
    raw = np.frombuffer(held, np.uint8)
    ahead = np.zeros(len(raw) - 7, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        ahead = ahead << np.uint64(8) | raw[k : len(raw) - 7 + k]
    sizes = np.array([len(x) for x in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    count = np.array(blocks, np.int64)
    firsts = np.concatenate([[0], np.cumsum(count)[:-1]])
    out, whole = np.zeros(int(count.sum()) * 64, np.int16), np.ones(len(segments), bool)
    of_dc, of_ac = (np.array([t[k] for t in layout], np.int64) << 16 for k in (0, 1))
    flat = tables.ravel()
    own = np.flatnonzero(count > 0)
    at, last, block, limit, k = starts[own] * 8, (starts + sizes)[own] * 8, firsts[own], (firsts + count)[own], np.zeros(len(own), np.int64)
    unit = np.zeros(len(own), np.int64)  # which block of its unit
    while len(own):
        dc = k == 0
        bits = ahead[at >> 3] << (at & 7).astype(np.uint64)
        found = flat[np.where(dc, of_dc[unit], of_ac[unit]) + (bits >> np.uint64(48)).astype(np.int64)]
        length, size = found >> 8, found & 15
        run = np.where(dc, 0, found >> 4 & 15)
        extra = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra << 1 < 1 << size, extra - (1 << size) + 1, extra)
        at = at + length + size
        place = k + run
        bad = (length == 0) | (at > last) | ((size > 0) & (place > 63)) | (dc & ((found & 255) > 15))
        some = (size > 0) & ~bad
        out[(block * 64 + place)[some]] = value[some]
        k = np.where((size > 0) | dc, place + 1, np.where(run == 15, k + 16, 64))
        done = k >= 64
        if done.any() or bad.any():
            block = block + done
            unit = np.where(done, (unit + 1) % len(layout), unit)
            k = np.where(done, 0, k)
            whole[own[bad]] = False
            stay = ~bad & (block < limit)
            if not stay.all():
                own, at, last, block, limit, k, unit = (x[stay] for x in (own, at, last, block, limit, k, unit))
    return out.reshape(-1, 64), whole


@dataclass
class Decoded:
    """A file's markers and its coefficients, by block in the order of the scan."""

    parsed: Parsed
    coefficients: np.ndarray


def decode(files: list[bytes | None]) -> list[Decoded | None]:
    """All files of a batch; None for one that is null, cut, damaged or no baseline file."""
    parsed: list[Parsed | None] = []
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, data in enumerate(files):
        try:
            got = parse(data) if data is not None else None
            if got is not None:
                for stored in got.huffman.values():
                    lookup(stored)
                key = (tuple(sorted(got.huffman.items())), tuple((c.across, c.down, c.dc, c.ac) for c in got.components))
                groups[key].append(i)
        except ValueError:
            got = None
        parsed.append(got)
    out: list[Decoded | None] = [None] * len(files)
    for members in groups.values():
        while members:  # by size, so memory stays bounded
            some, held = [], 0
            while members and (not some or held < GROUP_BYTES):
                some.append(members.pop())
                held += sum(map(len, parsed[some[-1]].segments))
            for i, coefficients in zip(some, _decode_group([parsed[i] for i in some]), strict=True):
                if coefficients is not None:
                    out[i] = Decoded(parsed[i], coefficients)
    return out


def _decode_group(files: list[Parsed]) -> list[np.ndarray | None]:
    """Coefficients of files of one layout, with DC values."""
    first, layout = files[0], files[0].layout
    names = sorted(first.huffman)
    tables = np.stack([lookup(first.huffman[x]) for x in names])
    places = [(names.index((0, first.components[c].dc)), names.index((1, first.components[c].ac))) for c in layout]
    segments, blocks, ends = [], [], []
    for got in files:
        units = got.grid[0] * got.grid[1]
        step = got.restart or units
        segments += got.segments
        blocks += [min(step, units - at) * len(layout) for at in range(0, units, step)]
        ends.append(len(segments))
    found, whole = decode_segments(segments, blocks, tables, places)
    # DC: running sums of a component's differences within each segment
    limits = np.concatenate([[0], np.cumsum(blocks)])
    segment = np.repeat(np.arange(len(blocks)), blocks)
    component = np.array(layout)[(np.arange(len(found)) - limits[segment]) % len(layout)]
    for c in set(layout):
        mine = np.flatnonzero(component == c)
        sums = np.cumsum(found[mine, 0], dtype=np.int64)
        before = np.searchsorted(mine, limits[:-1])  # a segment's first block of the component
        found[mine, 0] = sums - np.concatenate([[0], sums])[before][segment[mine]]
    out, at = [], 0
    for to in ends:
        out.append(found[limits[at] : limits[to]] if whole[at:to].all() else None)
        at = to
    return out


def payload_of(got: Decoded) -> bytes | None:
    """The bytes that the coefficients stand for; None without the comment or with coefficients that stand for none."""
    stated, held = got.parsed.payload_bytes, got.coefficients
    if stated is None or stated > held.size or (held == 0).any() or (held < -128).any() or (held > 128).any():
        return None
    return TO_BYTE[held.ravel()[:stated] + 128].tobytes()


def thumbnail(got: Decoded) -> np.ndarray:
    """Luminance from DC alone: one pixel a block."""
    parsed, c = got.parsed, got.parsed.components[0]
    across, down = parsed.grid
    h, v = (1, 1) if len(parsed.components) == 1 else (c.across, c.down)
    own = got.coefficients[:, 0].reshape(down * across, len(parsed.layout))[:, : h * v]
    dc = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.float32) * parsed.quant[c.quant][0]
    most = (1, 1) if len(parsed.components) == 1 else (max(x.across for x in parsed.components), max(x.down for x in parsed.components))
    wide, high = -(-parsed.width * h // (8 * most[0])), -(-parsed.height * v // (8 * most[1]))
    return np.clip(np.rint(dc[:high, :wide] / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64-bit average hash of the thumbnail brought to 8 x 8."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * h // 8, np.arange(8) * w // 8
    y1, x1 = np.maximum(y0 + 1, (np.arange(8) + 1) * h // 8), np.maximum(x0 + 1, (np.arange(8) + 1) * w // 8)
    small = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / ((y1 - y0)[:, None] * (x1 - x0)[None])
    return np.packbits(small > small.mean()).tobytes().hex()


def feature(got: Decoded) -> str:
    """Dimensions, the thumbnail's size, mean and hash."""
    pixels = thumbnail(got)
    return f"{got.parsed.width}x{got.parsed.height};{pixels.shape[1]}x{pixels.shape[0]};{pixels.mean():.3f};{thumbnail_hash(pixels)}"


def features(media: bytes | None) -> tuple[bytes | None, str | None]:
    """The payload and the feature text of a stored file; None where they can't be read."""
    got = decode([media])[0]
    return (None, None) if got is None else (payload_of(got), feature(got))


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes and the stored file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([encode_jpeg(pad(r)) for r in raw], pa.binary()),
                ],
                names=[id_col, "n_bytes", "media"],
            )

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, n_bytes long, media binary")


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored files back: sizes, digests and features."""
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                files, rows = part.column(2).to_pylist(), []
                for media, got in zip(files, decode(files), strict=True):
                    payload = None if got is None else payload_of(got)
                    read = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                    rows.append(
                        (
                            *read, *((None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())),
                            None if got is None else feature(got),
                        )
                    )
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
