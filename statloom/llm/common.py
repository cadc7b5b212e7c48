"""Helpers shared by the corpus operators: tables, scratch storage, vectorised words.

Words are runs of bytes other than ASCII blanks (0x20, 0x09-0x0D).  All byte-level
helpers work on one chunk of texts at a time, so memory is bounded by CHUNK_BYTES
plus the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch at most, about.
BATCH_BYTES = 4 << 20

_LIBC = ctypes.CDLL(None)

WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to BATCH_BYTES, for Python workers of bounded memory; a lower one stays.

    Spark has this bound for a session only, and reads it when a query is planned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster.  None is named in a local session only, which then gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="statloom-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders to delete at the end of each passing() that is open, the innermost last.
_PASSING: list[list[str]] = []


def scratch(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.  Within passing() it goes at the end unless it is to be kept."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what scratch() wrote within; a result that outlives it must read only tables that were kept."""
    _PASSING.append([])
    try:
        yield
    finally:
        _delete(spark, _PASSING.pop())


def discard(df: DataFrame) -> None:
    """Delete a table that scratch() wrote and nothing reads any more."""
    _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of jobs that have ended.

    It does so once the driver's JVM has dropped what refers to them, which on a heap with room
    may be long after; their results must have been written.
    """
    gc.collect()
    spark._jvm.System.gc()


#: A key that holds more than one row in so many is joined apart; there are fewer such keys than this.
HOT_SHARE = 1000
#: Rows that one task can take, whatever their key.
TASK_ROWS = 1_000_000


def spread_join(rows: DataFrame, keyed: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows joined (inner) to the one row of keyed for their key, where keyed.n counts the key's rows among total.

    Keys with more than total / HOT_SHARE rows are fewer than HOT_SHARE, so their side is broadcast
    and their rows stay where they are; all others are shuffled.  keyed is read three times.  No key can be
    too much for a task if there are no more than TASK_ROWS rows in all.
    """
    if total <= TASK_ROWS:
        return rows.join(keyed.drop("n"), key)
    hot = F.col("n") * HOT_SHARE > total
    often = F.broadcast(keyed.where(hot))
    apart = rows.join(often.drop("n"), key)
    rest = rows.join(often.select(*key), key, "left_anti").join(keyed.where(~hot).drop("n"), key)
    return apart.unionByName(rest.select(*apart.columns))


#: Rows of a bitmap that says which keys are wanted: 4 kB each, 16 MB at most.
MOST_BUCKETS = 1 << 12


def maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows with a flag ``maybe``: false only if the column's value is not among those of wanted (one column).

    A bitmap of hashes of at most MOST_BUCKETS rows is broadcast; with far more than 10**8 values more
    flags are true.  Only DataFrame functions.  wanted is read twice.
    """
    buckets, need = 16, 16 * wanted.count()
    while buckets < MOST_BUCKETS and buckets << 15 < need:
        buckets <<= 1
    hashed = wanted.toDF("_h").select(F.xxhash64("_h").alias("_h"))
    hashed = hashed.select(F.pmod(F.shiftright("_h", 15), buckets).alias("_bucket"), F.pmod("_h", F.lit(1 << 15)).alias("_at"))
    maps = F.broadcast(hashed.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map")))
    h = F.xxhash64(column)
    at = F.pmod(h, F.lit(1 << 15))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    flagged = rows.withColumn("_bucket", F.pmod(F.shiftright(h, 15), buckets)).join(maps, "_bucket", "left")
    return flagged.withColumn("maybe", F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop("_bucket", "_map")


# --- vectorised words -------------------------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers are kept in multiples of so many; the next power of two would hold twice what a chunk needs.
POWER_STEP = 1 << 16


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
        if size <= 1 << 23:
            _POWERS[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[first:last] for each pair, by prefix sums."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[last] - sums[first]) * down[first]


class Words:
    """Word boundaries and hashes of a list of texts (bytes)."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = _BLANK, fold: np.ndarray | None = None):
        self.joined = b" ".join(texts) + b" "
        data = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_end = np.cumsum(lengths)
        self.doc_start = self.doc_end - lengths
        is_blank = blank[data]
        change = np.flatnonzero(is_blank[1:] != is_blank[:-1]) + 1
        if len(data) and not is_blank[0]:
            change = np.concatenate([[0], change])
        self.start, self.end = change[0::2], change[1::2]
        self.data = data if fold is None else fold[data]
        self.doc = np.searchsorted(self.doc_end, self.start, side="right")
        self.first = np.searchsorted(self.start, self.doc_start)  # first word of each text
        self.count = np.diff(np.append(self.first, len(self.start)))

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first bytes."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        h = runs_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, end, _BASE)
        return mix(h ^ ((end - self.start).astype(np.uint64) << np.uint64(56)))

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words that start a window of size words of one text."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        i = np.arange(n - size + 1)
        return i[self.doc[: n - size + 1] == self.doc[size - 1 :]]


def window_hash(hashes: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    salted = mix(hashes ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1))
    return mix(runs_hash(salted, at, at + size, _STEP))


def trim() -> None:
    """Gives freed memory back to the system: workers outlive their task, and what they keep counts with the next stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def chunks(batches, text: str, limit: int = CHUNK_BYTES):
    """(Arrow batch slice, texts as bytes) with about limit bytes of text each; nulls become b''.

    Spark bounds a batch by bytes; only the slice at hand is turned into Python objects.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, n = 0, len(total)
        while start < n:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start), [t or b"" for t in column.slice(start, stop - start).to_pylist()]
            start = stop
    trim()


def grouped_runs(batches, keys: tuple[str, ...]):
    """(key, table) for each run of equal keys of sorted Arrow batches; a run may go over several batches."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            now = tuple(int(c[a]) for c in columns)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = now
    if held:
        yield key, pa.Table.from_batches(held)
