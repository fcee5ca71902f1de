"""Baseline files of any sampling, written bit by bit, against the reader; damaged files; the stored form."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from tidemark.llm import media


def codes_of(stored):
    """symbol -> bits of a table as in DHT."""
    out, code, at = {}, 0, 16
    for length, count in enumerate(stored[:16], 1):
        for symbol in stored[at : at + count]:
            out[symbol] = format(code, f"0{length}b")
            code, at = code + 1, at + 1
        code <<= 1
    return out


def table(rng, symbols):
    """A random prefix code that leaves the code of all ones free."""
    lengths, room = [], 1 << 16
    for k in range(len(symbols)):
        least = next(n for n in range(1, 17) if (1 << (16 - n)) <= room - (len(symbols) - k))
        n = min(16, least + rng.randint(0, 2) if len(symbols) - k > 1 else least + 1)
        while (1 << (16 - n)) > room - (len(symbols) - k):
            n += 1
        lengths.append(n)
        room -= 1 << (16 - n)
    rng.shuffle(symbols)
    pairs = sorted(zip(lengths, symbols, strict=True), key=lambda x: x[0])
    return bytes(lengths.count(n) for n in range(1, 17)) + bytes(s for _, s in pairs)


def bits_of(v):
    size = abs(v).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def picture(rng, sampling, width, height, restart, comment=b""):
    """(file, coefficients by block in scan order, component of each block) written symbol by symbol."""
    most = (max(h for h, _ in sampling), max(v for _, v in sampling)) if len(sampling) > 1 else (1, 1)
    units = -(-width // (8 * most[0])) * -(-height // (8 * most[1]))
    layout = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)] if len(sampling) > 1 else [0]
    dc_tables = [table(rng, list(range(12))) for _ in range(2)]
    ac_tables = [table(rng, [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 10)]) for _ in range(2)]
    blocks, scan, text, last = [], b"", "", [0] * len(sampling)

    def flush():
        padded = text + "1" * (-len(text) % 8)
        return int(padded or "0", 2).to_bytes(len(padded) // 8, "big").replace(b"\xff", b"\xff\0")

    for u in range(units):
        if restart and u and u % restart == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            text, last = "", [0] * len(sampling)
        for c in layout:
            block = [0] * 64
            block[0] = rng.randint(-500, 500)
            for k in rng.sample(range(1, 64), rng.choice([0, 1, 5, 30, 63])):
                block[k] = rng.choice([-1, 1, rng.randint(-400, 400)])
            size, extra = bits_of(block[0] - last[c])
            last[c] = block[0]
            text += codes_of(dc_tables[c > 0])[size] + extra
            own, run = codes_of(ac_tables[c > 0]), 0
            end = max((k for k in range(1, 64) if block[k]), default=0)
            for k in range(1, end + 1):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    text, run = text + own[0xF0], run - 16
                size, extra = bits_of(block[k])
                text, run = text + own[run << 4 | size] + extra, 0
            if end < 63:
                text += own[0]
            blocks.append(block)
    scan += flush()
    quant = [bytes(rng.randint(1, 40) for _ in range(64)) for _ in range(2)]
    out = b"\xff\xd8" + (media._segment(0xFE, comment) if comment else b"")
    out += b"".join(media._segment(0xDB, bytes([k]) + q) for k, q in enumerate(quant))
    out += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, c > 0]) for c, (h, v) in enumerate(sampling)))
    out += b"".join(media._segment(0xC4, bytes([kind << 4 | k]) + t) for kind, own in ((0, dc_tables), (1, ac_tables)) for k, t in enumerate(own))
    if restart:
        out += media._segment(0xDD, struct.pack(">H", restart))
    out += media._segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, (c > 0) * 0x11]) for c in range(len(sampling))) + bytes([0, 63, 0]))
    return out + scan + b"\xff\xd9", np.array(blocks), quant, layout, most


SAMPLINGS = [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(2, 2)]]


@pytest.mark.parametrize("sampling", SAMPLINGS)
def test_any_sampling_and_restart(sampling):
    rng = random.Random(len(sampling) * 10 + sampling[0][0])
    made = [picture(rng, sampling, rng.randint(1, 70), rng.randint(1, 70), restart) for restart in (0, 1, 2, 5, 0)]
    files = [m[0] for m in made]
    mixed = [files[0], None, files[1], b"junk", *files[2:]]
    got = media.decode(mixed)
    assert got[1] is None and got[3] is None
    for (_, blocks, quant, layout, most), own in zip(made, [got[0], got[2], *got[4:]], strict=True):
        assert (own.coefficients == blocks).all()
        parsed, (h, v) = own.parsed, sampling[0] if len(sampling) > 1 else (1, 1)
        across, down = parsed.grid
        want = np.zeros((down * v, across * h))
        lumas = [b[0] for k, b in enumerate(blocks) if layout[k % len(layout)] == 0]
        for k, dc in enumerate(lumas):  # block by block
            unit, inside = divmod(k, h * v)
            want[unit // across * v + inside // h, unit % across * h + inside % h] = min(255, max(0, round(dc * quant[0][0] / 8 + 128)))
        shown = media.thumbnail(own)
        assert np.abs(shown.astype(int) - want[: shown.shape[0], : shown.shape[1]]).max() <= 0
        assert shown.shape == (-(-parsed.height * v // (8 * most[1])), -(-parsed.width * h // (8 * most[0])))
        assert media.payload_of(own) is None and media.feature(own).startswith(f"{parsed.width}x{parsed.height};")


def test_cut_and_damaged_files_are_none():
    rng = random.Random(3)
    whole = media.encode_jpeg(media.pad(bytes(rng.randrange(256) for _ in range(3000))))
    for bad in [None, b"", *(whole[:n] for n in range(0, len(whole) - 2, 37)), whole.replace(b"\xff\xc0", b"\xff\xc2"), whole.replace(b"\xff\xd1", b"\xff\0", 1)]:
        assert media.features(bad) == (None, None)
    for _ in range(200):  # bytes changed anywhere: never an error
        some = bytearray(whole)
        some[rng.randrange(len(some))] = rng.randrange(256)
        media.features(bytes(some))


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 383, 768, 769, 5000, 40_000])
def test_payload_comes_back(n):
    rng = random.Random(n)
    payload = media.pad(bytes(rng.choice([rng.randrange(256), 254, 255, 32]) for _ in range(n)))
    stored = media.encode_jpeg(payload)
    got, shown = media.features(stored)
    assert got == payload and shown
    parsed = media.parse(stored)
    assert len(parsed.segments) == -(-parsed.grid[0] * parsed.grid[1] // media.RESTART)


def test_bad_media_in_a_table(spark):
    whole = media.encode_jpeg(media.pad(b"text"))
    rows = [(1, 4, whole), (2, 4, None), (3, 4, whole[:-20]), (4, 4, b"x")]
    got = {r["doc_id"]: r for r in media.digest(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["payload_bytes"] == 192 and got[1]["feature"]
    assert all(got[i]["payload_bytes"] is None and got[i]["feature"] is None for i in (2, 3, 4))
    assert got[2]["media_bytes"] is None and got[3]["media_bytes"] == len(whole) - 20
