"""Packing by non-negative least squares.

Documents are tokenized once and cut into full sequences, a body that is a multiple of
``unit`` tokens, and a rest shorter than a unit; a later step only places these pieces, so
token ids are never shuffled.  The histogram of piece lengths has at most
``window/unit + unit`` bars.  Shallow combinations of lengths that fill the window exactly
are enumerated, non-negative least squares finds how often to repeat each, counts are
rounded down to what is there, and what is left is packed greedily on the histogram.

A piece finds its place from its rank among pieces of equal length, by a table of rank
intervals; ranks are counted in salted groups, so a length that a third of all pieces have
is spread over many tasks.

Defined results: null text is empty and has the end token only; rows that share an id get
places of their own; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, scratch
from .tokenize import default_path, gathered, token_ids

END_ID = 1
#: Pieces of one length in one window task, about.
RANK_ROWS = 20_000


def cut(n: int, window: int, unit: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    body = n % window // unit * unit
    return [window] * (n // window) + [x for x in (body, n % window - body) if x]


@lru_cache
def combinations(units: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Non-increasing part lists of at most so many parts that sum to units."""

    def below(left: int, most: int, depth: int):
        if left == 0:
            yield ()
        elif depth and most * depth >= left:
            for x in range(min(left, most), 0, -1):
                for rest in below(left - x, x, depth - 1):
                    yield (x, *rest)

    return tuple(below(units, units, parts))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| with x >= 0, by an active set."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ (b - a @ x)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        free = np.where(passive, -np.inf, slope)
        if not n or free.max() <= tolerance:
            break
        passive[int(free.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        slope = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], window: int, unit: int, parts: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences); together they use each piece of the histogram once."""
    left = {k: v for k, v in histogram.items() if v}
    lengths = sorted(left)
    row = {k: i for i, k in enumerate(lengths)}
    patterns = [tuple(unit * p for p in c) for c in combinations(window // unit, parts)]
    patterns += [(k,) * (window // k) for k in lengths if k < unit]
    patterns = [p for p in patterns if all(k in row for k in p)]
    out: list[tuple[tuple[int, ...], int]] = []
    if patterns:
        a = np.zeros((len(lengths), len(patterns)))
        for j, p in enumerate(patterns):
            for k in p:
                a[row[k], j] += 1
        x = nnls(a, np.array([left[k] for k in lengths], float))
        for j in np.argsort(-x, kind="stable"):
            p = patterns[j]
            need = {k: p.count(k) for k in p}
            times = min(int(x[j] + 0.5), *(left[k] // v for k, v in need.items()))
            if times > 0:
                out.append((p, times))
                for k, v in need.items():
                    left[k] -= v * times
    # the rest, greedily: the longest length that fits, as often as it does
    while any(left.values()):
        space, need = window, {}
        for k in reversed(lengths):
            if k <= space and left[k] and (n := min(left[k], space // k)):
                need[k], space = n, space - n * k
        times = min(left[k] // v for k, v in need.items())
        out.append((tuple(k for k, v in need.items() for _ in range(v)), times))
        for k, v in need.items():
            left[k] -= v * times
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length << 40 | first rank of an interval), first rank, first sequence, offset."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for p, times in patterns:
        offset = 0
        for k in p:
            first = rank.get(k, 0)
            rows.append((k << 40 | first, first, base, offset))
            rank[k] = first + times
            offset += k
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, unit: int = 64, parts: int = 8) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = tokenizer or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pieces(batches):
        import pyarrow as pa

        for part, texts in gathered(batches, "text", ["doc_id"]):
            ids, at = token_ids(path, texts)
            ids = ids.astype("<u4")
            rows: list[list[int]] = [[], [], [], [], []]
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = np.append(ids[a:b], np.array([END_ID], "<u4"))
                raw, start = memoryview(own.tobytes()), 0
                for n in cut(len(own), window, unit):
                    for row, v in zip(rows, (i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(own))):
                        row.append(v)
                    start += n
            doc = part.column("doc_id").combine_chunks().take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc if isinstance(doc, pa.Array) else doc.combine_chunks(), *(pa.array(r, pa.int64()) for r in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    cutup = scratch(docs.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window/unit + unit rows at most
    table = places(plan(histogram, window, unit, parts))
    held = spark.sparkContext.broadcast(table)

    salts = max(16, -(-max(histogram.values(), default=0) // RANK_ROWS))
    salted = cutup.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = salted.withColumn("rank", within).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))

    def place(batches):
        import pyarrow as pa

        keys, first, base, offset = held.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            j = np.searchsorted(keys, b.column("length").to_numpy() << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[j] + rank - first[j]), pa.array(offset[j])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
