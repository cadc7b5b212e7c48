"""The progressive decoder against streams of a small encoder that uses what the format allows."""

import struct

import numpy as np
import pytest

from statloom.llm import jpeg, media


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - k) & 1 for k in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def size_of(v):
    return int(abs(v)).bit_length()


def encode(parts, sampling, width, height, rng, restart):
    """parts: blocks (rows x columns x 64) of each component."""
    order = rng.permutation(256).astype(np.uint8)
    code = {int(s): ((i, 8) if i < 254 else (508 + i - 254, 9)) for i, s in enumerate(order)}
    table = bytes([0] * 7 + [254, 2] + [0] * 7) + order.tobytes()
    quant = rng.integers(1, 9, 64).astype(np.uint8)
    n = len(parts)
    out = [b"\xff\xd8", segment(0xDB, bytes([0]) + quant.tobytes()), segment(0xC2, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, sampling[i][0] * 16 + sampling[i][1], 0]) for i in range(n)))]
    out += [segment(0xC4, bytes([0]) + table), segment(0xC4, bytes([0x10]) + table), segment(0xDD, struct.pack(">H", restart))]
    wide, tall = max(s[0] for s in sampling), max(s[1] for s in sampling)

    def scan(chosen, start, end, high, low):
        if len(chosen) > 1:
            columns, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
            units = [[(c, my * sampling[c][1] + y, mx * sampling[c][0] + x) for c in chosen for y in range(sampling[c][1]) for x in range(sampling[c][0])] for my in range(rows) for mx in range(columns)]
        else:
            (c,) = chosen
            h, v = sampling[c]
            columns, rows = -(-(-(-width * h // wide)) // 8), -(-(-(-height * v // tall)) // 8)
            units = [[(c, y, x)] for y in range(rows) for x in range(columns)]
        pieces = []
        every = restart or len(units)
        for a in range(0, len(units), every):
            w, before, run, waiting = Writer(), {c: 0 for c in chosen}, 0, []

            def flush():
                nonlocal run, waiting
                if run:
                    r = run.bit_length() - 1
                    w.put(*code[r << 4])
                    w.put(run - (1 << r), r)
                    w.bits += waiting
                    run, waiting = 0, []

            for c, y, x in (b for u in units[a : a + every] for b in u):
                block = parts[c][y, x]
                if start == 0 and not high:
                    v = int(block[0]) >> low
                    d, before[c] = v - before[c], v
                    s = size_of(d)
                    w.put(*code[s])
                    w.put(d if d > 0 else d + (1 << s) - 1, s)
                elif start == 0:
                    w.put(int(block[0]) >> low & 1, 1)
                else:
                    now = [int(np.sign(block[k])) * (abs(int(block[k])) >> low) for k in range(start, end + 1)]
                    old = [v if not high else int(np.sign(block[k])) * (abs(int(block[k])) >> (low + 1)) for k, v in zip(range(start, end + 1), now)]
                    fresh = [k for k, (v, o) in enumerate(zip(now, old)) if v and (not high or not o)]
                    zeros, held = 0, []
                    for k in range(fresh[-1] + 1 if fresh else 0):
                        if high and old[k]:
                            held.append(abs(now[k]) & 1)
                        elif not now[k]:
                            zeros += 1
                            if zeros == 16:
                                flush()
                                w.put(*code[0xF0])
                                w.bits += held
                                zeros, held = 0, []
                        else:
                            flush()
                            s = 1 if high else size_of(now[k])
                            w.put(*code[zeros << 4 | s])
                            w.put((now[k] > 0) if high else now[k] if now[k] > 0 else now[k] + (1 << s) - 1, s)
                            w.bits += held
                            zeros, held = 0, []
                    last = fresh[-1] + 1 if fresh else 0
                    if last < len(now):
                        run += 1
                        waiting += held + ([abs(v) & 1 for v, o in zip(now[last:], old[last:]) if o] if high else [])
                        if run == 0x7FFF:
                            flush()
            flush()
            pieces.append(w.bytes())
        joined = pieces[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(pieces[1:]))
        out.append(segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([c + 1, 0]) for c in chosen) + bytes([start, end, high << 4 | low])) + joined)

    every = list(range(n))
    scan(every, 0, 0, 0, 1)
    for c in every:
        scan([c], 1, 5, 0, 2)
        scan([c], 6, 63, 0, 2)
    for c in every:
        scan([c], 1, 63, 2, 1)
    scan(every, 0, 0, 1, 0)
    for c in every:
        scan([c], 1, 63, 1, 0)
    return b"".join([*out, b"\xff\xd9"]), quant


@pytest.mark.parametrize("seed", range(12))
def test_decoder_reads_what_the_format_allows(seed):
    rng = np.random.default_rng(seed)
    sampling = [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3][seed % 4]
    width, height, restart = int(rng.integers(1, 70)), int(rng.integers(1, 70)), [0, 3][seed % 2]
    wide, tall = max(s[0] for s in sampling), max(s[1] for s in sampling)
    columns, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
    parts = []
    for h, v in sampling:
        b = rng.integers(-200, 200, (rows * v, columns * h, 64)) * (rng.random((rows * v, columns * h, 64)) < rng.choice([0.02, 0.2, 0.7]))
        b[rng.random(b.shape[:2]) < 0.4, 1:] = 0  # runs of empty blocks
        parts.append(b)
    data, quant = encode(parts, sampling, width, height, rng, restart)
    picture = jpeg.decode(data)
    got = list(picture.components.values())
    for c, b in zip(got, parts):
        # blocks beyond the picture are coded in interleaved scans only
        own_rows, own_columns = -(-(-(-height * c.v // tall)) // 8), -(-(-(-width * c.h // wide)) // 8)
        assert (c.blocks[:own_rows, :own_columns] == b[:own_rows, :own_columns]).all()
    out = jpeg.pixels(picture, media.INVERSE)
    assert out.shape == (height, width, 3)
    # one luma sample by the definition of the transform
    zz = sorted(((r, q) for r in range(8) for q in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    y = sum(c(u) * c(v) / 4 * parts[0][0, 0, k] * quant[k] * np.cos(u * np.pi / 16) * np.cos(v * np.pi / 16) for k, (v, u) in enumerate(zz)) + 128
    if len(parts) == 1:
        assert abs(float(out[0, 0, 0]) - np.clip(y, 0, 255)) <= 1


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_decoder_reads_our_own_streams(n):
    data = media.payload(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes())
    stored = media.encode(data)
    parts, columns, rows = media.coefficients(stored)
    picture = jpeg.decode(stored)
    for part, c in zip(parts, picture.components.values()):
        assert (c.blocks.reshape(-1, 64) == part).all()
    assert (jpeg.pixels(picture, media.INVERSE) == media.rgb(parts, columns, rows)).all()


def test_broken_streams_raise():
    data = media.encode(media.payload(b"x" * 700))
    for bad in (b"", b"no", data[:300], data.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_tensors_of_stored_pictures(spark):
    rng = np.random.default_rng(1)
    picture, _ = encode([rng.integers(-50, 50, (1, 1, 64))], [(1, 1)], 7, 5, rng, 0)
    rows = [(1, media.encode(media.payload(b"text"))), (2, bytes(picture)), (3, b"broken"), (4, None)]
    got = {r["id"]: r for r in media.tensors(spark.createDataFrame(rows, "id long, media binary"), "media").collect()}
    assert (got[2]["width"], got[2]["height"], len(got[2]["rgb"])) == (7, 5, 105) and len(got[1]["rgb"]) == 3 * got[1]["width"] * got[1]["height"]
    assert got[3]["rgb"] is None and got[3]["error"] and got[4]["rgb"] is None and got[4]["error"] is None
