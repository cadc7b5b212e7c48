"""Substring dedup with a count-min prefilter.

A window is ``size`` consecutive words of one document.  A word is removed if a window
that covers it also starts in a document with a smaller id.

A window is counted under its anchor: the ``gram``-word run inside it with the least hash.
Equal windows have equal anchors, so the count of the documents that hold an anchor is at
least the count of those that hold the window.

Pass 1 makes a count-min sketch of each partition (sparse: only cells with a count) and merges
these by cell.  The sketch has ``2**log2_cells`` cells in each of ``depth`` rows, far more than
there are anchors, as it is never held whole: cells that are counted twice or more go into
a bitmap of bounded size that is broadcast.  A corpus that fills the bitmap (some 10**9 anchors) lets more anchors
pass, which costs pass 2 about a third of the text in shuffled rows at most; none is ever lost.

Pass 2 emits only windows whose estimate is two or more, as runs of consecutive windows with one
anchor.  Runs are grouped exactly, by a 96-bit fingerprint of all their words: all but the run in
the least document go.  That run's windows are compared one by one with those of other runs with
its anchor, by 96-bit fingerprints too.  So copies cost a row for a run, not for a window.  Hot keys
are safe: minima are pre-aggregated, and rows of hot keys stay where they are.

Defined results: null or empty text has no words; null ids count as larger than any id;
rows that share an id share their windows and are judged one by one; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, chunks, maybe_in, mix, runs_hash, scratch, spread_join, window_hash

LAST = (1 << 63) - 1
_ROW_SALT = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_STEP = np.uint64(0xC6A4A7935BD1E995)


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i:i+width], by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        gap = width - have
        out = op(out[: len(out) - gap], out[gap:])
    return out


def _anchors(words: Words, size: int, gram: int):
    """(window starts, anchor hash of each window, word hashes)."""
    hashes = words.hashes()
    at = words.windows(size)
    if not len(at):
        return at, np.zeros(0, np.uint64), hashes
    grams = window_hash(hashes, np.arange(len(hashes) - gram + 1), gram, 7)
    return at, _sliding(grams, size - gram + 1, np.minimum)[at], hashes


def _cells(anchor: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    """The anchor's cell in a row of the sketch; the row is part of the number."""
    return (mix(anchor ^ np.uint64(_ROW_SALT[row])) >> np.uint64(64 - log2_cells) | np.uint64(row << log2_cells)).view(np.int64)


def _signed(crc: int) -> int:
    return crc - (1 << 32) if crc >> 31 else crc


def _anchors_by_document(texts: list[bytes], size: int, gram: int) -> np.ndarray:
    """Each anchor once for each document that holds it."""
    words = Words(texts)
    at, anchor, _ = _anchors(words, size, gram)
    if not len(at):
        return anchor
    both = np.stack([words.doc[at].astype(np.uint64), anchor])
    both = both[:, np.lexsort(both)]
    return both[1, np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0))]


def merged_sketch(docs: DataFrame, text_col: str, size: int, gram: int, log2_cells: int, depth: int) -> DataFrame:
    """(cell, n): cells of the merged sketch that count two or more documents."""

    def sketch(batches):
        import pyarrow as pa

        for _, texts in chunks(batches, text_col):
            anchor = _anchors_by_document(texts, size, gram)
            for row in range(depth):
                cell, n = np.unique(_cells(anchor, row, log2_cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counted = docs.select(text_col).mapInArrow(sketch, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")


def runs(docs: DataFrame, size: int, gram: int, log2_cells: int, depth: int) -> DataFrame:
    """k, crc, anchor, h1, h2 (fingerprint of all words), first, last (its windows' starts), cells, w1, w2 (the windows' fingerprints) of each run of windows with one anchor; docs: k, text."""

    def emit(batches):
        import pyarrow as pa

        names = ["k", "crc", "anchor", "h1", "h2", "first", "last", *[f"cell{r}" for r in range(depth)], "w1", "w2"]
        for batch, texts in chunks(batches, "text"):
            words = Words(texts)
            at, anchor, hashes = _anchors(words, size, gram)
            if not len(at):
                continue
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]]))
            edge = np.flatnonzero(new)
            stop = np.append(edge[1:], len(at))
            first, last, doc = at[edge], at[stop - 1], words.doc[at[edge]]
            length = (last - first).astype(np.uint64)
            full = []
            for salt in (11, 12):
                salted = mix(hashes ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1))
                full.append(mix(runs_hash(salted, first, last + size, _STEP) ^ mix(length + np.uint64(salt))))
            crc = np.fromiter((_signed(zlib.crc32(t)) for t in texts), np.int32, len(texts))
            ends = pa.array(np.append(0, stop).astype(np.int32))
            w = [window_hash(hashes, at, size, 1).view(np.int64), (window_hash(hashes, at, size, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32)]
            own = words.first[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").take(pa.array(doc)), pa.array(crc[doc]), pa.array(anchor[edge].view(np.int64)), pa.array(full[0].view(np.int64)), pa.array((full[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array((first - own).astype(np.int32)), pa.array((last - own).astype(np.int32)), *[pa.array(_cells(anchor[edge], r, log2_cells)) for r in range(depth)],
                    *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in w],
                ],
                names=names,
            )

    cells = "".join(f"cell{r} long, " for r in range(depth))
    return docs.mapInArrow(emit, f"k long, crc int, anchor long, h1 long, h2 int, first int, last int, {cells}w1 array<long>, w2 array<int>")


def repeated_runs(docs: DataFrame, size: int, gram: int, log2_cells: int, depth: int) -> DataFrame:
    """The runs whose anchor the merged sketch takes for repeated."""
    sketch = scratch(merged_sketch(docs, "text", size, gram, log2_cells, depth), "sketch").select("cell")
    found = runs(docs, size, gram, log2_cells, depth)
    for r in range(depth):
        found = maybe_in(found, f"cell{r}", sketch).where("maybe").drop("maybe", f"cell{r}")
    return found


def _later(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows with ``least``, the least k of their key, where it is not the only one; groups of two k or more."""
    groups = rows.groupBy(*key).agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    groups = scratch(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return spread_join(rows, groups, key, total), groups


def removed_windows(docs: DataFrame, size: int, gram: int, log2_cells: int, depth: int) -> DataFrame:
    """(k, crc, first, last): ranges of window starts that a document with a smaller id holds too."""
    found = scratch(repeated_runs(docs, size, gram, log2_cells, depth), "runs")
    copies, _ = _later(found.select("k", "crc", "h1", "h2", "first", "last"), ["h1", "h2"])
    gone = scratch(copies.where("k > least").select("k", "crc", "first", "last"), "copies")
    # of each run its least document's; those whose anchor no other run has need no more
    kinds = found.groupBy("anchor", "h1", "h2").agg(F.min("k").alias("k"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    kinds = kinds.join(several, "anchor", "left_semi").select("h1", "h2", "k")
    kept = found.join(kinds, ["h1", "h2", "k"], "left_semi")
    windows = kept.select("k", "crc", "first", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w")).select("k", "crc", (F.col("first") + F.col("i")).alias("at"), "w.w1", "w.w2")
    windows = scratch(windows, "windows")
    single, _ = _later(windows, ["w1", "w2"])
    return gone.unionByName(single.where("k > least").select("k", "crc", F.col("at").alias("first"), F.col("at").alias("last")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 10, log2_cells: int = 40, depth: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(LAST)))
    gone = removed_windows(keyed.select("k", "text"), size, gram, log2_cells, depth)
    # a row is known by its id and its text's CRC-32, as ids may repeat
    gone = scratch(gone.groupBy("k", "crc").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "gone")
    keyed = maybe_in(keyed, "k", gone.select("k"))
    whole = keyed.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,last:int>>").alias("gone"))
    touched = keyed.where("maybe").withColumn("crc", F.shiftright(F.shiftleft(F.crc32("text"), 32), 32).cast("int"))
    touched = touched.join(gone, ["k", "crc"], "left").select("doc_id", "text", "gone")

    def keep(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            words = Words(texts)
            removed, digest, kept_text = [], [], []
            ranges = batch.column("gone")
            for i, text in enumerate(texts):
                n, a = int(words.count[i]), int(words.first[i])
                covered = np.zeros(n + 1, np.int64)
                if ranges[i].is_valid:
                    first, last = (ranges[i].values.field(f).to_numpy() for f in ("first", "last"))
                    np.add.at(covered, first, 1)
                    np.add.at(covered, np.minimum(last + size, n), -1)
                lost = np.cumsum(covered)[:n] > 0
                if lost.any():
                    left = np.flatnonzero(~lost)
                    kept = b" ".join(words.joined[s:e] for s, e in zip(words.start[a + left].tolist(), words.end[a + left].tolist()))
                else:
                    kept = b" ".join(text.split())
                removed.append(int(lost.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return whole.unionByName(touched).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
