"""Media columns: progressive JPEG images decoded to full-resolution RGB tensors.

The payload is carried losslessly in the format's own unit, the quantised DCT coefficient:
byte v is the coefficient +v for v >= 128 and v - 255 below, so every coefficient has
magnitude 128 to 255.  An image has three components with 4:2:0 sampling; a unit (MCU) of
six blocks carries 384 bytes.  Scans, in order:

1. DC of all components, interleaved, with a restart after each unit;
2. for each component two spectral bands of AC, without the lowest bit;
3. for each component the lowest bit of all AC.

As all magnitudes share one size category, each scan has fixed-length records, and both
directions are numpy array operations.  The files are ordinary progressive JPEGs.

Decoding reads the stored bytes alone: it accumulates the scans into coefficient arrays,
takes the inverse transform in numpy, upsamples chroma and converts to RGB.

Defined results: null text is empty; an empty text's payload is 576 bytes of 255; rows are
judged one by one, and equal texts give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import bounded_batches, chunks

PAD = 255
GRAIN = 576
UNIT = 384
#: Last coefficient of the first spectral band.
SPLIT = 5


def _zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each position of the zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _transform() -> np.ndarray:
    """M with block (64) = coefficients in zigzag order (64) @ M."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.kron(c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _transform()


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(1, -(-len(text) // GRAIN)) * GRAIN - len(text))


def shape(n: int) -> tuple[int, int]:
    """Columns and rows of units that hold n bytes."""
    units = max(1, -(-n // UNIT))
    columns = int(np.ceil(np.sqrt(units)))
    return columns, -(-units // columns)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table with the one code 0 for a symbol."""
    return bytes([kind, 1, *[0] * 15, symbol])


def _stuffed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes, with 0 after each 0xFF."""
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], tables: int, start: int, end: int, approx: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), start, end, approx]))


def _dc_records(values: np.ndarray) -> np.ndarray:
    """Units x 6 bytes to units x 7 bytes: six times the code 0 and eight bits, then ones to the byte's end."""
    bits = np.ones((len(values), 56), np.uint8)
    bits[:, 0:54:9] = 0
    for i in range(6):
        bits[:, 9 * i + 1 : 9 * i + 9] = np.unpackbits(values[:, i : i + 1], axis=1)
    return np.packbits(bits, axis=1)


def encode(data: bytes) -> bytes:
    """The payload as a progressive JPEG."""
    columns, rows = shape(len(data))
    raw = np.full(columns * rows * UNIT, PAD, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    units = raw.reshape(rows, columns, 6, 64)
    y = units[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = [y, units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    out = [
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, _one_code(0x00, 8)),
        _segment(0xDD, struct.pack(">H", 1)),
        _scan([1, 2, 3], 0x00, 0, 0, 0x00),
    ]
    records = _dc_records(units[:, :, :, 0].reshape(-1, 6))
    n = len(records)
    joined = np.empty((n, 9), np.uint8)
    joined[:, :7] = records
    joined[:, 7] = 0xFF
    joined[:, 8] = 0xD0 + np.arange(n) % 8
    if (records == 0xFF).any():
        out += [b"".join(_stuffed(r[:7]) + (r[7:].tobytes() if i < n - 1 else b"") for i, r in enumerate(joined))]
    else:
        out.append(joined.tobytes()[:-2])
    out += [_segment(0xDD, struct.pack(">H", 0)), _segment(0xC4, _one_code(0x10, 7))]
    for c, part in enumerate(parts, 1):
        for a, b in ((1, SPLIT), (SPLIT + 1, 63)):
            # value v: seven bits of the magnitude without its lowest bit; negative ones are inverted, as the format has it
            v = part[:, a : b + 1]
            out += [_scan([c], 0x00, a, b, 0x01), (v >> 1).tobytes()]
    out.append(_segment(0xC4, _one_code(0x10, 0)))
    for c, part in enumerate(parts, 1):
        v = part.copy()
        v[:, 0] = 0  # the code for the end of the block; then a bit for each coefficient
        low = np.where(v >= 128, v, 255 - v) & 1
        low[:, 0] = 0
        out += [_scan([c], 0x00, 1, 63, 0x10), _stuffed(np.packbits(low, axis=1))]
    return b"".join([*out, b"\xff\xd9"])


def _sections(data: bytes):
    """(marker, body, entropy-coded bytes after it)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        coded = b""
        if marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            coded, at = data[at:end], end
        yield marker, body, coded


def coefficients(data: bytes) -> tuple[list[np.ndarray], int, int]:
    """Coefficient arrays (blocks x 64, zigzag order, int16) of the three components, and columns and rows of units."""
    parts: list[np.ndarray] = []
    columns = rows = 0
    for marker, body, coded in _sections(data):
        if marker == 0xC2:
            rows, columns = struct.unpack(">HH", body[1:5])
            rows, columns = rows // 16, columns // 16
            parts = [np.zeros((rows * columns * k, 64), np.int16) for k in (4, 1, 1)]
        elif marker == 0xDA:
            start, end, approx = body[-3:]
            if body[0] == 3:  # DC, a unit in each restart interval
                raw = np.frombuffer(_without_restarts(coded, rows * columns), np.uint8).reshape(-1, 7)
                bits = np.unpackbits(raw, axis=1)[:, :54].reshape(-1, 6, 9)[:, :, 1:]
                value = _signed(np.packbits(bits, axis=2)[:, :, 0], 8)
                y = np.cumsum(value[:, :4], axis=1).reshape(rows, columns, 2, 2).transpose(0, 2, 1, 3).ravel()
                for part, dc in zip(parts, (y, value[:, 4], value[:, 5])):
                    part[:, 0] = dc
            elif approx == 0x01:
                raw = np.frombuffer(coded, np.uint8).reshape(-1, end - start + 1)
                parts[body[1] - 1][:, start : end + 1] = _signed(raw, 7) * 2
            else:
                raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 8)
                part = parts[body[1] - 1]
                low = np.unpackbits(raw, axis=1)[:, 1:].astype(np.int16)
                part[:, 1:] += np.where(part[:, 1:] < 0, -low, low)
    return parts, columns, rows


def _signed(raw: np.ndarray, bits: int) -> np.ndarray:
    """The format's signed values of one size category."""
    half = 1 << (bits - 1)
    raw = raw.astype(np.int16)
    return np.where(raw >= half, raw, raw - (2 * half - 1))


def _without_restarts(coded: bytes, n: int) -> bytes:
    if len(coded) == 9 * n - 2:
        return np.frombuffer(coded + b"\0\0", np.uint8).reshape(n, 9)[:, :7].tobytes()
    out, at = [], 0
    for _ in range(n):
        record = bytearray()
        while len(record) < 7:
            record.append(coded[at])
            at += 2 if coded[at] == 0xFF else 1
        out.append(bytes(record))
        at += 2
    return b"".join(out)


def payload_of(parts: list[np.ndarray], columns: int, rows: int) -> np.ndarray:
    """The bytes that coefficients carry; block differences of DC are within a unit."""
    units = np.empty((rows, columns, 6, 64), np.int16)
    units[:, :, :4] = parts[0].reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, 64)
    units[:, :, 4] = parts[1].reshape(rows, columns, 64)
    units[:, :, 5] = parts[2].reshape(rows, columns, 64)
    units[:, :, 1:4, 0] -= units[:, :, 0:3, 0].copy()
    return np.where(units < 0, units + 255, units).astype(np.uint8).ravel()


def rgb(parts: list[np.ndarray], columns: int, rows: int) -> np.ndarray:
    """Height x width x 3 bytes: inverse transform, chroma upsampled by repetition."""
    planes = []
    for part, k in zip(parts, (2, 1, 1)):
        pixels = part.astype(np.float32) @ INVERSE + 128
        plane = pixels.reshape(rows * k, columns * k, 8, 8).transpose(0, 2, 1, 3).reshape(rows * k * 8, columns * k * 8)
        planes.append(np.clip(plane, 0, 255) if k == 2 else np.clip(plane, 0, 255).repeat(2, axis=0).repeat(2, axis=1))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return (np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel, and a CRC of the tensor."""
    flat = pixels.reshape(-1, 3)
    mean = np.round(flat.sum(axis=0, dtype=np.int64) / len(flat), 3)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:" + ",".join(f"{m:.3f}" for m in mean) + f":{zlib.crc32(pixels.tobytes()):08x}"


def media_columns(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with tensors also media, width, height and rgb."""
    bounded_batches(docs.sparkSession)

    def build(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            rows = []
            for text in texts:
                size = len(payload(text))
                media = encode(payload(text))
                parts, w, h = coefficients(media)
                read = payload_of(parts, w, h)[:size].tobytes()
                pixels = rgb(parts, w, h)
                rows.append((len(text), size, hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels), *((media, pixels.shape[1], pixels.shape[0], pixels.tobytes()) if tensors else ())))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary())))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, width int, height int, rgb binary" * tensors
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, schema)


def tensors(df: DataFrame, column: str) -> DataFrame:
    """df with width, height, rgb (bytes, by rows) and error of the progressive JPEG in a column, whoever made it.  Null gives nulls; what cannot be read gives its error."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # pictures may be large: one at a time
                data, found = batch.column(column)[i].as_py(), (None, None, None, None)
                if data is not None:
                    try:
                        out = jpeg.pixels(jpeg.decode(data), INVERSE)
                        found = (out.shape[1], out.shape[0], out.tobytes(), None)
                    except ValueError as e:
                        found = (None, None, None, str(e))
                new = [pa.array([v], t) for v, t in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *new], names=[*batch.schema.names, "width", "height", "rgb", "error"])

    shape = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(read, f"{shape}, width int, height int, rgb binary, error string")
