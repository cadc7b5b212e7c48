"""Order over a whole table without one task that holds it: buckets by value, blocks by position.

A table whose number of rows is known is cut into buckets of about ROWS rows at values of a sample
of bounded size (MOST buckets at most; from then on they grow).  Counts within a bucket are a
window; a bucket starts where the sum of the buckets before it ends, which is found from one row
for each bucket.  Once rows have positions, blocks of BLOCK positions with the rows next to them
(their halo) are enough for moving frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about, and buckets at most.
ROWS, MOST = 1 << 20, 1 << 12
#: Sampled values for each bucket, about.
SAMPLED = 32
#: Edges that are searched at once.
SPAN = 64
#: Positions of a block.
BLOCK = 1 << 16


def in_buckets(df: DataFrame, n: int, column: str, by: list[str] = (), rows: int | None = None, apart: bool = False) -> DataFrame:
    """df of n rows with ``_bucket``, which doesn't fall as the column rises; (by, column) should tell rows apart.

    With ``apart`` a value that is an edge has a bucket of its own, with an odd number; so has each
    value of many more rows than a bucket.  df has to give the same rows whenever it is read.  Any type with an order will do.
    """
    buckets = min(MOST, -(-n // (rows or ROWS)))
    if buckets <= 1:
        return df.withColumn("_bucket", F.lit(0))
    step = max(1, n // (buckets * SAMPLED))
    sample = df.where(F.pmod(F.xxhash64(*by, column), F.lit(step)) == 0)
    every = max(1, n // step // buckets)
    edges = sample.agg(F.array_sort(F.collect_list(column)).alias("_all"))
    edges = edges.select(F.array_distinct(F.filter("_all", lambda _, i: i % every == every - 1)).alias("_edges"))
    edges = edges.select("_edges", F.filter("_edges", lambda _, i: i % SPAN == SPAN - 1).alias("_coarse"))
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(column)))
    cut = df.crossJoin(F.broadcast(edges)).withColumn("_span", below(F.col("_coarse")) * SPAN)  # one row of some MOST values
    near = F.slice("_edges", F.col("_span") + 1, SPAN)
    bucket = F.col("_span") + below(near)
    if apart:
        bucket = 2 * bucket + F.array_contains(near, F.col(column)).cast("int")
    return cut.withColumn("_bucket", bucket).drop("_edges", "_coarse", "_span")


def bucket_starts(cut: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, _bucket, _start: rows (or their weights) of lesser buckets of the same by."""
    sums = cut.groupBy(*by, "_bucket").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_n"))
    rows = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))).alias("_all"))  # MOST of them at most
    earlier = lambda i: F.aggregate(F.slice("_all", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    return rows.select(*by, F.explode(F.transform("_all", lambda b, i: F.struct(b["_bucket"].alias("_bucket"), earlier(i).alias("_start")))).alias("_s")).select(*by, "_s.*")


def add_starts(cut: DataFrame, n: int, by: list[str] = (), weight: str | None = None, rows: int | None = None) -> DataFrame:
    """cut with ``_start``; a table of one bucket needs none."""
    if n <= (rows or ROWS):
        return cut.withColumn("_start", F.lit(0).cast("long"))
    starts = bucket_starts(cut, by, weight)
    if not by:
        starts = F.broadcast(starts)  # MOST rows at most
    return cut.join(starts, [*by, "_bucket"])


def in_blocks(points: DataFrame, before: int = 0, after: int = 0, block: int | None = None) -> DataFrame:
    """points with a position i, in blocks of positions: ``_block``, and ``_own``, which is false for copies of up to ``before`` rows before and ``after`` rows after the block."""
    block = block or BLOCK
    if max(before, after) > block:
        raise ValueError("the halo is wider than a block")
    own = F.expr(f"i div {block}")
    blocks = [own]
    if before:
        blocks.append(F.when(F.col("i") % block >= block - before, own + 1))
    if after:
        blocks.append(F.when((F.col("i") % block < after) & (own > 0), own - 1))
    to = F.explode(F.filter(F.array(*blocks), lambda b: b.isNotNull()))
    return points.withColumn("_block", to).withColumn("_own", F.col("_block") == own)
