"""Exact n-gram Jaccard self-join with signature trees.

A document's set holds its distinct ``n``-word shingles (64-bit hashes).  Documents with
equal sets form a class; only class representatives are compared.

The tree's upper levels are spread over the cluster, its lower levels live in tasks:

* peeling (below a similarity of about 0.87): a set that holds more tokens of its own, which no other set has, than a
  linked one can lack, links with nothing and goes.  Tokens are counted exactly, a slice of their hashes
  in each round, among the sets that are left; so what stays are sets that others cover nearly whole, however large the corpus;
* candidates: sets have keys such that linked ones share one; sets that keys connect form a family,
  and sets of different families never link.  From a similarity of about 0.87 on keys are whole
  segments of a set (``segments.py``).  Below it segments are too short to tell sets apart, and keys
  are first tokens: tokens have one order for all sets, rare ones first, by a merged count sketch of
  the sets that peeling left (any order gives the same result; this one keeps passages that many documents
  share out of the way), and linked sets share a token among their first ones, of the smaller set
  those that it can lack and still reach ``2t / (1 + t)`` of itself, of the larger those that
  it can lack and still reach ``t`` of itself;
* lower levels: within a family, nodes hold OR-combined token bitmaps and size ranges.  A
  dual traversal drops node pairs whose largest possible overlap is too small; surviving
  leaf pairs are verified exactly.

Families larger than ``block`` are dealt in blocks, so no task holds an unbounded group: each
block is joined with itself, then one set of each block's main part with those of others.
What is then in the family's main part needs no more comparing with itself; only sets outside of it
are sent to all blocks.  Only labels of what links reach leave a task.

Defined results: null text, empty text and text without words give an empty set, linked
with nothing; a text with fewer than n words has one shingle, the whole sequence; null ids
take no part in links; rows that share an id are one node of the graph; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Words, bounded_batches, chunks, discard, grouped_runs, maybe_in, mix, passing, release, scratch, spread_join, window_hash
from .segments import segment_keys, suits
from .union_find import components

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bits of a node's bitmap at most.
MAP_BITS = 1 << 16
FANOUT = 8
#: Cells of the count sketch that orders tokens, a byte each to broadcast: 4 to 32 MB.  Chance keeps passages of few
#: documents apart from single tokens while a cell counts some six tokens at most, so there are more cells for more text.
LOG2_CELLS, MOST_LOG2_CELLS = 22, 25
#: Bytes of text to a cell, about: four tokens.
CELL_BYTES = 28
#: Cells of a part of the sketch that travels and is merged as one row.
LOG2_PART = 16
#: Fragments of one part that a task merges at once, about; after two such steps few are left of any corpus.
FAN_IN = 64
#: Tokens of a block at most, about.
BLOCK_TOKENS = 4_000_000
#: A round of peeling counts one token in so many of the corpus.
ROUND_SHARE = 8
#: Slices of tokens are ranges of a hash of so many bits.
SLICE_BITS = 32


def shingle_sets(texts: list[bytes], n: int):
    """(tokens, offsets): the sorted distinct shingle hashes of text i are tokens[offsets[i]:offsets[i+1]]."""
    words = Words(texts, fold=_FOLD)
    hashes = words.hashes()
    at = words.windows(n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    token = [window_hash(hashes, at, n, 1)] + [window_hash(hashes, words.first[[i]], int(words.count[i]), int(words.count[i]) + 2) for i in short]
    doc = np.concatenate([words.doc[at], short]).astype(np.int64)
    token = np.concatenate(token)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    if len(doc):
        new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))
        doc, token = doc[new], token[new]
    return token, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_lengths(size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first tokens a set needs as the smaller one of a linked pair, and as either one."""
    smaller = size - -(-2 * num * size // (num + den)) + 1
    either = size - -(-num * size // den) + 1
    return np.minimum(smaller, size), np.minimum(either, size)


def log2_cells(text_bytes: int) -> int:
    """The size of the sketch for so much text."""
    return min(max(int(text_bytes // CELL_BYTES).bit_length(), LOG2_CELLS), MOST_LOG2_CELLS)


def _cell(tokens: np.ndarray, log2: int) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0x7F4A7C159E3779B9)) >> np.uint64(64 - log2)).astype(np.int64)


def prefixes(tokens: np.ndarray, at: np.ndarray, num: int, den: int, rank: np.ndarray):
    """(tokens, whether needed as the smaller set's, offsets): the first tokens of each set, in the order of their cells' rank, then of their hash."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((mix(tokens), rank[_cell(tokens, len(rank).bit_length() - 1)], doc))
    place = np.arange(len(tokens)) - np.repeat(at[:-1], size)
    smaller, either = prefix_lengths(size, num, den)
    keep = place < np.repeat(either, size)
    return tokens[order][keep], (place < np.repeat(smaller, size))[keep], np.concatenate([[0], np.cumsum(either)])


class _Sets:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def signature_tree(tokens: list[np.ndarray], bits: int | None = None):
    """Levels from leaves to root: (OR bitmaps, least size, largest size, most collisions); leaves in the order given by the second result; whether bitmaps are exact."""
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    known, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a token of one set only adds to no overlap
    place = np.cumsum(shared) - 1
    exact = bits is None and int(shared.sum()) <= MAP_BITS
    width = max(64, -(-int(shared.sum()) // 64) * 64) if exact else bits or MAP_BITS
    size = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(tokens)), size)
    use = shared[inverse]
    where = (place[inverse[use]] if exact else (mix(known) % np.uint64(width)).astype(np.int64)[inverse[use]]).astype(np.int64)
    maps = np.zeros((len(tokens), width // 64), np.uint64)
    np.bitwise_or.at(maps, (owner[use], where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
    have = np.bincount(owner[use], minlength=len(tokens))
    least = np.array([int(t[0]) if len(t) else 0 for t in tokens], np.uint64)
    order = np.lexsort((least, size))
    level = (maps[order], size[order], size[order], (have - _bit_count(maps))[order])
    levels = [level]
    while len(levels[-1][0]) > 1:
        m, lo, hi, extra = levels[-1]
        edge = np.arange(0, len(m), FANOUT)
        levels.append((np.bitwise_or.reduceat(m, edge, axis=0), np.minimum.reduceat(lo, edge), np.maximum.reduceat(hi, edge), np.maximum.reduceat(extra, edge)))
    return levels, order, exact


def tree_links(tokens: list[np.ndarray], num: int, den: int, bits: int | None = None, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links between the sets, by dual traversal of their signature tree with itself.  Sets of one part count as linked already."""
    if len(tokens) < 2:
        return []
    levels, order, exact = signature_tree(tokens, bits)
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        if depth < len(levels) - 1:  # children of the surviving pairs, each pair of them once
            n = len(levels[depth][0])
            i = (a[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            j = (b[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
            ok = (i < n) & (j < n) & (i <= j)
            a, b = i[ok], j[ok]
        maps, lo, hi, extra = levels[depth]
        if depth == 0:
            ok = a < b
            if parts is not None:
                ok &= parts[order[a]] != parts[order[b]]
            a, b = a[ok], b[ok]
        keep = np.zeros(len(a), bool)
        step = max(1, (1 << 22) // maps.shape[1])
        for s in range(0, len(a), step):
            x, y = a[s : s + step], b[s : s + step]
            most = _bit_count(maps[x] & maps[y]) + np.minimum(extra[x], extra[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            need = num * (lo[x] + lo[y])  # (num + den) * overlap >= num * (|A| + |B|)
            keep[s : s + step] = (num + den) * most >= need
            keep[s : s + step] &= (den * hi[x] >= num * lo[y]) & (den * hi[y] >= num * lo[x])
        a, b = a[keep], b[keep]
    sets, links = _Sets(len(tokens)), []
    if parts is not None:
        _, first, inverse = np.unique(parts, return_index=True, return_inverse=True)
        for i, f in enumerate(first[inverse].tolist()):
            sets.join(i, f)
    for i, j in zip(order[a].tolist(), order[b].tolist()):
        if sets.find(i) == sets.find(j):
            continue
        if not exact:
            both = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
            if den * both < num * (len(tokens[i]) + len(tokens[j]) - both):
                continue
        sets.join(i, j)
        links.append((i, j))
    return links


#: What _describe gives.
DESCRIBED = "doc_id long, n_shingles long, d1 long, d2 long, part int, bucket int, cells binary"


def _describe(n: int, log2: int):
    """For each row its id, set size and 128-bit set digest; then, unless log2 is 0, the partition's count sketch of 2**log2 cells in parts."""

    def describe(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "n_shingles", "d1", "d2", "part", "bucket", "cells"]
        count = np.zeros(1 << log2 if log2 else 0, np.uint8)
        for batch, texts in chunks(batches, "text"):
            tokens, at = shingle_sets(texts, n)
            size = np.diff(at)
            digest = np.zeros((2, len(texts)), np.uint64)
            full = np.flatnonzero(size)
            for i, salt in enumerate((3, 5)):
                if len(full):
                    digest[i, full] = mix(np.add.reduceat(mix(tokens ^ np.uint64(salt)), at[full]) ^ size[full].astype(np.uint64))
            if log2:
                cell, times = np.unique(_cell(tokens, log2), return_counts=True)
                count[cell] = np.minimum(count[cell] + times, 255)
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=names
            )
        if not log2:
            return
        one, task = pa.nulls(1), TaskContext.get().partitionId()
        for i, part in enumerate(count.reshape(-1, 1 << LOG2_PART)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*[one.cast(pa.int64())] * 4, pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([_packed(part)], pa.binary())], names=names)

    return describe


def _packed(counts: np.ndarray) -> bytes:
    """A part's counts: all of them, or places and counts if that is shorter.  The first byte says which, and of how many bytes a count is."""
    held = np.flatnonzero(counts).astype(np.uint16)
    width = counts.dtype.itemsize
    if len(held) * (2 + width) < counts.nbytes:
        return bytes([width]) + held.tobytes() + counts[held].tobytes()
    return bytes([16 + width]) + counts.tobytes()


def _merged(packed) -> np.ndarray:
    total = np.zeros(1 << LOG2_PART, np.uint32)
    for p in packed:
        width = p[0] & 15
        kind = np.uint8 if width == 1 else np.uint32
        if p[0] < 16:
            n = (len(p) - 1) // (2 + width)
            at, counts = np.frombuffer(p, np.uint16, n, 1), np.frombuffer(p[1 + 2 * n :], kind)
        else:
            at, counts = slice(None), np.frombuffer(p[1:], kind)
        total[at] += np.minimum(counts, (1 << 32) - 1 - total[at]).astype(np.uint32)
    return total


def _ranks(fragments: DataFrame, log2: int) -> np.ndarray:
    """For each cell eight times the binary logarithm of its count, 255 at most: the partitions' sketches, merged in three steps."""

    def some(key, pdf):
        import pandas as pd

        return pd.DataFrame({"part": [key[0]], "bucket": [key[1]], "cells": [_packed(_merged(pdf["cells"]))]})

    def last(key, pdf):
        import pandas as pd

        total = _merged(pdf["cells"])
        return pd.DataFrame({"part": [key[0]], "cells": [np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8).tobytes()]})

    shape = "part int, cells binary"
    merged = fragments
    for _ in range(2):
        merged = merged.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int")).groupBy("part", "bucket").applyInPandas(some, "part int, bucket int, cells binary")
    merged = merged.groupBy("part").applyInPandas(last, shape)
    out = np.zeros((1 << (log2 - LOG2_PART), 1 << LOG2_PART), np.uint8)
    for r in merged.collect():  # 2**log2 bytes at most
        out[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def token_slice(tokens: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of the sets' tokens in a slice of the hashes, from low to below high."""
    h = mix(tokens ^ np.uint64(0x3243F6A8885A308D)) >> np.uint64(64 - SLICE_BITS)
    keep = (h >= low) & (h < high)
    return tokens[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def peeled(docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id of the sets that may link with another one; no link is lost.

    sets: doc_id, n_shingles and whether the id stands for several sets; such ids stay.  The other set of a link lacks
    at most ``(1 - t) * n_shingles`` tokens, so a set with more tokens of its own than that goes.  Slices counted
    while sets were there that have gone since have no fewer such tokens now.  Each round reads the texts
    of the sets that are left and shuffles one token in ROUND_SHARE of the corpus at most, so slices widen as sets go.
    """
    spark, seen = docs.sparkSession, Observation()
    spare = F.when(~F.col("several"), F.expr(f"{den - num} * n_shingles div {den}"))
    left = sets.select("doc_id", "n_shingles", spare.alias("spare"), F.lit(0).cast("long").alias("own"))
    left = scratch(left.observe(seen, F.sum("n_shingles").alias("tokens")), "left")
    total = held = seen.get["tokens"] or 0
    low, end = 0, 1 << SLICE_BITS
    while held and low < end:
        high = min(end, low + max(1, end * total // (ROUND_SHARE * held)))

        def sliced(batches, low=low, high=high):
            import pyarrow as pa

            for batch, texts in chunks(batches, "text"):
                tokens, at = token_slice(*shingle_sets(texts, n), low, high)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))], names=["doc_id", "tokens"])

        posted = maybe_in(docs, "doc_id", left.select("doc_id")).where("maybe").select("doc_id", "text").mapInArrow(sliced, "doc_id long, tokens array<long>")
        alone = posted.select("doc_id", F.explode("tokens").alias("t")).groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
        alone = alone.groupBy("doc_id").agg(F.count("*").alias("more"))
        seen, before = Observation(), left
        left = left.join(alone, "doc_id", "left").withColumn("own", F.col("own") + F.coalesce("more", F.lit(0))).drop("more").where("spare is null or own <= spare")
        left = scratch(left.observe(seen, F.sum("n_shingles").alias("tokens")), "left")
        held = seen.get["tokens"] or 0
        discard(before)
        release(spark)
        low = high
    return left.select("doc_id")


def _verified(dealt: DataFrame, keys: tuple[str, ...], num: int, den: int) -> DataFrame:
    """(keys, node, label) for each group of dealt (keys, part, doc_id, tokens): label is the least part that links reach from part node; groups are bounded by how they are dealt.

    Sets of one part count as linked.
    """

    def verify(batches):
        import pyarrow as pa

        for key, group in grouped_runs(batches, keys):
            parts = group.column("part").to_numpy()
            sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
            known, first, inverse = np.unique(parts, return_index=True, return_inverse=True)
            labels = _Sets(len(known))
            for i, j in tree_links(sets, num, den, parts=inverse):
                labels.join(int(inverse[i]), int(inverse[j]))
            label = known[[labels.find(i) for i in range(len(known))]]
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(known), group.schema.field(c).type) for k, c in zip(key, keys)], pa.array(known), pa.array(label)], names=[*keys, "node", "label"])

    sorted_ = dealt.select(*keys, "part", "doc_id", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    shape = ", ".join(f"{k} {dict(dealt.dtypes)[k]}" for k in keys)
    return sorted_.mapInArrow(verify, f"{shape}, node long, label long")


def dealt_in_blocks(rows: DataFrame, key: str, name: str, block: int) -> DataFrame:
    """rows (key, doc_id, n tokens) with name (the block of the row) and name_n (how many blocks its group has)."""
    sized = rows.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias(f"{name}_n"))
    return rows.join(sized, key).withColumn(name, F.pmod(F.xxhash64("doc_id"), F.col(f"{name}_n")).cast("int"))


def family_parts(rows: DataFrame, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, label: for each id the least one that links within its block reach) and links (u, v) between such labels.

    rows: family, doc_id, n, mine, mine_n (as dealt) and tokens.  Token sets are shuffled once, those of families
    of several blocks again where they meet others; all else works on ids.
    """
    dealt = scratch(rows.withColumn("part", F.col("doc_id")), "dealt")
    release(rows.sparkSession)
    first = scratch(_verified(dealt, ("family", "mine"), num, den), "parts")
    release(rows.sparkSession)
    nodes = first.select("node", "label")
    large = dealt.where("mine_n > 1")
    if large.isEmpty():
        return nodes, nodes.where("false").select(F.col("node").alias("u"), F.col("label").alias("v"))
    sets = large.select("doc_id", "tokens")
    ids = large.select("family", "doc_id", "n", "mine", "mine_n").distinct().join(nodes.withColumnRenamed("node", "doc_id"), "doc_id")
    # one set of the main part of each block of a family; with more than 8 * block blocks by groups of these
    main = first.groupBy("family", "mine", "label").agg(F.count("*").alias("n")).groupBy("family", "mine").agg(F.max_by("label", F.struct("n", "label")).alias("doc_id"))
    some = ids.join(main, ["family", "mine", "doc_id"]).select("family", F.floor(F.col("mine") / (8 * block)).cast("int").alias("mine"), "doc_id", F.col("label").alias("part"))
    some = maybe_in(sets, "doc_id", some.select("doc_id")).where("maybe").drop("maybe").join(some, "doc_id")
    joined = scratch(_verified(some, ("family", "mine"), num, den), "parts").select(F.col("node").alias("label"), F.col("label").alias("part"))
    links = joined.select(F.col("label").alias("u"), F.col("part").alias("v")).where("u <> v")
    named = scratch(ids.join(joined, "label", "left").withColumn("part", F.coalesce("part", "label")).drop("label"), "large")
    release(rows.sparkSession)
    # what is still outside of the family's main part meets every block
    most = named.groupBy("family", "part").agg(F.count("*").alias("size")).groupBy("family").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    named = named.join(most, "family")
    out = scratch(dealt_in_blocks(named.where("part <> main").select("family", "doc_id", "n", "part", "mine_n"), "family", "i", block), "outside")
    if out.isEmpty():
        return nodes, links
    n_out = out.select("family", "i_n").distinct()
    shape = ("family", "i", "j", "part", "doc_id")
    inside = named.where("part = main").join(n_out, "family").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1))).withColumn("j", F.col("mine"))
    sent = out.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mine_n") - 1)))
    both = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1))).withColumn("j", -1 - F.greatest("i", "k")).withColumn("i", F.least("i", "k"))
    met = inside.select(*shape).unionByName(sent.select(*shape)).unionByName(both.select(*shape)).join(sets, "doc_id")
    found = _verified(met, ("family", "i", "j"), num, den).select(F.col("node").alias("u"), F.col("label").alias("v")).where("u <> v")
    return nodes, links.unionByName(found)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; sets link when den * overlap >= num * union."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by_segments = suits(num, den)
    described = scratch(docs.mapInArrow(_describe(n, 0), DESCRIBED).select("doc_id", "n_shingles", "d1", "d2"), "described", keep=True)
    with passing(spark):
        found = scratch(_class_components(docs, described, by_segments, n, num, den, block), "found", keep=True)
    total = described.count()
    alone = described.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return spread_join(described.where("doc_id is not null and n_shingles > 0"), found, ["d1", "d2"], total).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _class_components(docs: DataFrame, described: DataFrame, by_segments: bool, n: int, num: int, den: int, block: int) -> DataFrame:
    """d1, d2 (a class of equal sets), n (its rows), component_id."""
    spark = docs.sparkSession
    named = described.where("doc_id is not null and n_shingles > 0")
    docs = docs.where("doc_id is not null")
    classes = scratch(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    reps = classes.select(F.col("least").alias("doc_id")).distinct()
    able, rank = docs, None
    if not by_segments:
        sets = named.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), (F.min(F.struct("d1", "d2")) != F.max(F.struct("d1", "d2"))).alias("several"))
        reps = peeled(docs, sets.join(reps, "doc_id"), n, num, den)
        able = maybe_in(docs, "doc_id", reps).where("maybe").select("doc_id", "text")
        log2 = log2_cells(able.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        fragments = able.mapInArrow(_describe(n, log2), DESCRIBED).where("part is not null")
        rank = spark.sparkContext.broadcast(_ranks(fragments.select("part", "bucket", "cells"), log2))

    def candidate_keys(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            sets = shingle_sets(texts, n)
            keys, small, at = segment_keys(*sets, num, den) if by_segments else prefixes(*sets, num, den, rank.value)
            # the lowest bit says whether the key counts for the smaller set; what remains of the hash is enough for candidates
            held = (keys & ~np.uint64(1) | small).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(held))], names=["doc_id", "keys"])

    first = able.mapInArrow(candidate_keys, "doc_id long, keys array<long>").join(reps, "doc_id", "left_semi")
    first = scratch(first, "first")
    if rank is not None:
        rank.destroy()
    release(spark)
    posted = first.select("doc_id", F.explode("keys").alias("t")).select("doc_id", F.shiftright("t", 1).alias("key"), F.col("t").bitwiseAND(1).alias("small"))
    hubs = posted.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("small").alias("small"), F.count("*").alias("n")).where("n > 1 and small = 1").select("key", "v", "n")
    hubs = scratch(hubs, "hubs")
    release(spark)
    total = hubs.agg(F.sum("n")).first()[0] or 0
    posted = maybe_in(posted.select("key", "doc_id"), "key", hubs.select("key")).where("maybe").drop("maybe")
    stars = spread_join(posted, hubs, ["key"], total).where("doc_id > v").select(F.col("doc_id").alias("u"), "v")
    family = scratch(components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")
    for done in (first, hubs):
        discard(done)
    release(spark)

    def tokens_of(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            tokens, at = shingle_sets(texts, n)
            sets = pa.array([tokens[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], names=[*kept, "tokens"])

    kept = ("family", "doc_id", "n", "mine", "mine_n")
    sizes = named.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    placed = scratch(dealt_in_blocks(family.join(sizes, "doc_id"), "family", "mine", block), "placed")
    members = maybe_in(docs, "doc_id", placed.select("doc_id")).where("maybe").join(placed, "doc_id")
    tokens = members.select(*kept, "text").mapInArrow(tokens_of, "family long, doc_id long, n long, mine int, mine_n int, tokens binary").where("length(tokens) > 0")
    nodes, links = family_parts(tokens, num, den, block)

    # a row whose id stands for several sets ties their classes together
    several = named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).where("a <> b").select("doc_id")
    tied = named.join(several, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    for end in ("u", "v"):
        tied = tied.join(nodes.select(F.col("node").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    linked = components(links.unionByName(tied.select("u", "v"))).select(F.col("node").alias("label"), "component")
    # an id with no links of its own may still be tied to others
    labels = classes.select("least").distinct().join(nodes.withColumnRenamed("node", "least"), "least", "left").withColumn("label", F.coalesce("label", "least"))
    linked = labels.join(linked, "label", "left").select("least", F.coalesce("component", "label").alias("component"))
    return classes.join(linked, "least").select("d1", "d2", "n", F.col("component").alias("component_id"))
