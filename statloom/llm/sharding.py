"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups.

Rows of a group (equal texts, unless another key is asked for) stay in one shard.  A group of more
than 1/(shards * grain) of all bytes is an item of its own, so there are fewer than shards * grain
of these; all lighter groups go by their hash into as many bundles.  So there are fewer than
2 * shards * grain items however large the corpus is, one task takes them all, and their table is
small enough to broadcast.

Each item starts as a partial partition with one filled part.  The two partial partitions of
largest spread (greatest minus least part) are combined, the greatest part of one with the least
of the other, until one is left.

Slots are counted within buckets of a shard (about the square root of all rows; a window each)
and start where the sums of the buckets before end, so a shard that holds a third of all rows is
many tasks.

Defined results: a null text counts as empty (size 1, CRC 0) and is one group with empty texts; a
null or repeated doc_id is a row like any other; ties of bytes go by hash; shards may stay empty if
groups are few; one group larger than the others together makes its shard as large as it is; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

SHARDS = 16
#: Items of an even share of bytes for each shard, above which a group is its own item.
GRAIN = 256


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item.  Ties go by the order of the items."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    sums = [np.zeros(parts, np.int64) for _ in range(n)]  # greatest first
    for s, v in zip(sums, sizes):
        s[0] = v
    heap = [(-int(v), i) for i, v in enumerate(sizes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both[order])
        made.append((a, b, order))
        heapq.heappush(heap, (int(both[order[-1]] - both[order[0]]), n + len(made) - 1))
    # downwards: the part that each place of a partial partition has become
    place = {n + len(made) - 1: np.arange(parts)}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        became = np.empty(parts, np.int64)
        became[order] = place.pop(n + i)
        place[a], place[b] = became, became[::-1]
    return np.array([place[i][0] for i in range(n)])


def assign_items(items: DataFrame, shards: int) -> DataFrame:
    """items (single, id, bytes), of which there are few, with the shard of each."""
    import pyarrow as pa

    def one_task(held: pa.Table) -> pa.Table:
        held = held.sort_by([("bytes", "descending"), ("single", "ascending"), ("id", "ascending")])
        shard = differencing(held["bytes"].to_numpy(), shards)
        return held.select(["single", "id"]).append_column("shard", pa.array(shard, pa.int32()))

    return items.groupBy(F.lit(0).alias("_all")).applyInArrow(one_task, "single boolean, id long, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; rows with equal values of ``group`` (the text) share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(text if group is None else group)  # groups that collide stay together, which breaks nothing
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = scratch(rows, "sizes")
    groups = scratch(rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    many = shards * grain
    single = F.col("bytes") > F.lit((total["bytes"] or 0) // many)
    items = groups.select(single.alias("single"), F.when(single, F.col("_key")).otherwise(F.pmod("_key", F.lit(many))).alias("id"), "bytes")
    placed = scratch(assign_items(items.groupBy("single", "id").agg(F.sum("bytes").alias("bytes")), shards), "shards")
    # fewer than `many` rows each
    alone = F.broadcast(placed.where("single").select(F.col("id").alias("_key"), F.col("shard").alias("_alone")))
    bundled = F.broadcast(placed.where("not single").select(F.col("id").alias("_bundle"), F.col("shard").alias("_bundled")))
    rows = rows.join(alone, "_key", "left").withColumn("_bundle", F.pmod("_key", F.lit(many))).join(bundled, "_bundle", "left")
    rows = rows.withColumn("shard", F.coalesce("_alone", "_bundled"))
    buckets = math.isqrt(total["rows"] or 0) + 1
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # a row for each bucket
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_key")
    rows = rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["shard", "_bucket"])
    slot = (F.col("_start") + F.col("_at")).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
