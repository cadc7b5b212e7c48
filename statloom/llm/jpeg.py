"""A decoder of progressive JPEG by the format's rules: any Huffman tables, samplings, scans and restarts.

Scans are accumulated into coefficient arrays: spectral selection gives a scan its band, successive
approximation its bit.  Coefficients are dequantised and transformed by one matrix product for all
blocks, chroma is upsampled by repetition, and the picture is cut to its size.

Not read: arithmetic coding, lossless and hierarchical frames, samples of other than 8 bits, four
components; these raise ValueError, as do broken streams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Component:
    h: int
    v: int
    table: int
    blocks: np.ndarray  # rows x columns x 64, zigzag order


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)


class _Bits:
    """Bits of one restart interval; past its end come zeros."""

    def __init__(self, coded: bytes):
        bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8)).astype(np.int32)
        self.ahead = np.zeros(len(bits), np.int32)  # the next 16 bits at each place
        for k in range(16):
            self.ahead[: len(bits) - k] |= bits[k:] << (15 - k)
        self.at, self.end = 0, len(bits) - 17

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = int(self.ahead[min(self.at, self.end)]) >> (16 - n)
        self.at += n
        return value

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        code = self.ahead[min(self.at, self.end)]
        length = int(table[0][code])
        if not length:
            raise ValueError("no such Huffman code")
        self.at += length
        return int(table[1][code])

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) for each 16 bits that begin with a code."""
    lengths, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = slice(code << (16 - length), (code + 1) << (16 - length))
            lengths[span], values[span] = length, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, values


def _first_ac(bits: _Bits, block: np.ndarray, start: int, end: int, low: int, table, run: int) -> int:
    if run:
        return run - 1
    k = start
    while k <= end:
        zeros, size = divmod(bits.symbol(table), 16)
        if size:
            k += zeros
            if k > end:
                raise ValueError("a coefficient outside of its band")
            block[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros < 15:
            return (1 << zeros) - 1 + bits.take(zeros)
        else:
            k += 16
    return 0


def _refine_ac(bits: _Bits, block: np.ndarray, start: int, end: int, low: int, table, run: int) -> int:
    step = 1 << low

    def corrected(value: int) -> int:
        return value + (step if value > 0 else -step) if bits.take(1) else value

    k = start
    while not run and k <= end:
        zeros, size = divmod(bits.symbol(table), 16)
        new = 0
        if size:
            new = step if bits.take(1) else -step
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= end:
            if block[k]:
                block[k] = corrected(int(block[k]))
            elif zeros:
                zeros -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if run:
        for j in range(k, end + 1):
            if block[j]:
                block[j] = corrected(int(block[j]))
        run -= 1
    return run


def _scan(picture: Picture, chosen: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, codes: dict, restart: int, intervals: list[bytes]) -> None:
    parts = picture.components
    wide, tall = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    if len(chosen) > 1:
        # all blocks of a unit, component by component
        columns, rows = -(-picture.width // (8 * wide)), -(-picture.height // (8 * tall))
        inside = [(i, y, x) for i, (c, _, _) in enumerate(chosen) for y in range(parts[c].v) for x in range(parts[c].h)]
        units = ([(i, my * parts[chosen[i][0]].v + y, mx * parts[chosen[i][0]].h + x) for i, y, x in inside] for my in range(rows) for mx in range(columns))
    else:
        c = parts[chosen[0][0]]
        columns, rows = -(-(-(-picture.width * c.h // wide)) // 8), -(-(-(-picture.height * c.v // tall)) // 8)
        units = ([(0, y, x)] for y in range(rows) for x in range(columns))
    n = columns * rows
    every = restart or n
    if len(intervals) < -(-n // every):
        raise ValueError("a scan ends early")
    bits, before, run = None, [], 0
    for at, unit in enumerate(units):
        if at % every == 0:
            bits, before, run = _Bits(intervals[at // every]), [0] * len(chosen), 0
        for i, y, x in unit:
            name, dc, ac = chosen[i]
            block = parts[name].blocks[y, x]
            if band[0] == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    before[i] += bits.signed(bits.symbol(codes[dc]))
                    block[0] = before[i] << low
            elif high:
                run = _refine_ac(bits, block, *band, low, codes[16 + ac], run)
            else:
                run = _first_ac(bits, block, *band, low, codes[16 + ac], run)


def decode(data: bytes) -> Picture:
    """The accumulated coefficients of all scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    picture, codes, restart, at = Picture(), {}, 0, 2
    try:
        while data[at + 1] != 0xD9:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xC2:
                if body[0] != 8 or body[5] not in (1, 3):
                    raise ValueError("8-bit samples of one or three components are read")
                picture.height, picture.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                shapes = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                wide, tall = max(s[1] for s in shapes), max(s[2] for s in shapes)
                columns, rows = -(-picture.width // (8 * wide)), -(-picture.height // (8 * tall))
                picture.components = {name: Component(h, v, table, np.zeros((rows * v, columns * h, 64), np.int32)) for name, h, v, table in shapes}
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive frame")
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    width = 2 if body[k] >> 4 else 1
                    picture.tables[body[k] & 15] = np.frombuffer(body, ">u2" if width == 2 else "u1", 64, k + 1).astype(np.float32)
                    k += 1 + 64 * width
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    codes[body[k]] = _huffman(counts, body[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                intervals, start = [], at
                while True:
                    at = data.index(b"\xff", at)
                    if data[at + 1] == 0:
                        at += 2
                    elif 0xD0 <= data[at + 1] <= 0xD7:
                        intervals.append(data[start:at])
                        at = start = at + 2
                    else:
                        break
                intervals.append(data[start:at])
                _scan(picture, chosen, (body[-3], body[-2]), body[-1] >> 4, body[-1] & 15, codes, restart, intervals)
    except (IndexError, KeyError) as e:
        raise ValueError(f"a broken stream: {e!r}") from e
    if not picture.components:
        raise ValueError("no frame")
    return picture


def pixels(picture: Picture, inverse: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes; inverse: 64 x 64, from a block's coefficients in zigzag order to its samples by rows."""
    wide, tall = max(c.h for c in picture.components.values()), max(c.v for c in picture.components.values())
    planes = []
    for c in picture.components.values():
        rows, columns, _ = c.blocks.shape
        samples = (c.blocks.reshape(-1, 64) * picture.tables.get(c.table, np.ones(64, np.float32))).astype(np.float32) @ inverse + 128
        plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        planes.append(np.clip(plane, 0, 255).repeat(tall // c.v, axis=0).repeat(wide // c.h, axis=1)[: picture.height, : picture.width])
    if len(planes) == 1:
        return (planes[0][:, :, None].repeat(3, axis=2) + 0.5).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return (np.clip(out, 0, 255) + 0.5).astype(np.uint8)
