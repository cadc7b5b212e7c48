"""Kendall's counts of pairs without a task that holds all of them.

Rows are cells (x, y, count).  Both columns are cut into buckets, where a value that is an edge is a
bucket of its own, so that a value of many rows leaves none beside it.  A pair that falls (x less,
y greater) lies in one bucket of x; or in two of x and one of y; or in two of both.  The first two
kinds are counted within the buckets, by a radix pass over the ranks of y; the last from
the table of counts by both buckets, by sums over its rows and then its columns.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import in_buckets

#: Cells of a bucket, about, and buckets of a column at most (about; edges count twice).
CELLS, MOST_BUCKETS = 1 << 18, 1 << 11


def weighted_inversions(k: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight products over pairs with lesser k and greater y."""
    order = np.lexsort((y, k))
    rank, w = np.unique(y[order], return_inverse=True)[1], weight[order]
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        # rows of one run agree in all higher bits and are in the order of k
        run = rank >> (bit + 1)
        high = (rank >> bit & 1).astype(bool)
        first = np.flatnonzero(np.diff(run, prepend=-1))
        passed = np.cumsum(np.where(high, w, 0))
        base = passed[first] - np.where(high[first], w[first], 0)
        before = (passed - np.repeat(base, np.diff(np.append(first, len(run)))))[~high]
        low = w[~high]
        if len(low) and float(before.max()) * float(low.sum()) > 2.0**62:
            before, low = before.astype(object), low.astype(object)
        total += int(np.dot(before, low))
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return total


def falling_pairs(cells: DataFrame, n: int, rows: int | None = None) -> DataFrame:
    """One row, ``falling``: pairs of cells (x, y, c) with x less and y greater, by counts.  cells has n rows, each (x, y) once, and gives the same whenever it is read."""
    import pyarrow as pa

    rows = max(rows or CELLS, -(-n // MOST_BUCKETS))
    cut = in_buckets(cells, n, "x", ["y"], rows, apart=True).withColumnRenamed("_bucket", "bx")
    cut = in_buckets(cut, n, "y", ["x"], rows, apart=True).withColumnRenamed("_bucket", "by")

    def count(group: pa.Table) -> pa.Table:
        found = weighted_inversions(*(group[c].to_numpy() for c in ("k", "y", "c")))
        return pa.table({"falling": pa.array([Decimal(found)], pa.decimal128(38, 0))})

    split = n > rows
    inner = cut.select(F.lit(0).alias("kind"), F.col("bx").alias("bucket"), F.col("x").alias("k"), "y", "c")
    if split:
        # a bucket with an odd number is one value, which has no pair that falls
        same_y = cut.where("by % 2 = 0").select(F.lit(1).alias("kind"), F.col("by").alias("bucket"), F.col("bx").cast("double").alias("k"), "y", "c")
        inner = inner.where("bucket % 2 = 0").unionByName(same_y)
    found = inner.groupBy("kind", "bucket").applyInArrow(count, "falling decimal(38, 0)")
    if split:
        counts = cut.groupBy("bx", "by").agg(F.sum("c").alias("c"))
        size = counts.agg((F.max("bx") + 1).alias("nx"), (F.max("by") + 1).alias("ny"))
        # a full table of a few thousand rows and columns at most: sums down the columns, then along the rows
        grid = size.select(F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), "ny").select("bx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
        grid = grid.join(counts, ["bx", "by"], "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("decimal(18, 0)"))
        down = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("less", F.coalesce(F.sum("c").over(down), F.lit(0)).cast("decimal(18, 0)"))
        along = Window.partitionBy("bx").orderBy(F.col("by").desc()).rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("falls", F.coalesce(F.sum("less").over(along), F.lit(0)).cast("decimal(18, 0)"))
        found = found.unionByName(grid.agg(F.sum(F.col("c") * F.col("falls")).cast("decimal(38, 0)").alias("falling")))
    return found.agg(F.coalesce(F.sum("falling"), F.lit(0)).cast("decimal(38, 0)").alias("falling"))


def tie_sums(counts: DataFrame, name: str) -> DataFrame:
    """One row of sums over counts t of equal values: pairs t(t-1)/2, and those that the variance of tau needs."""
    t = F.col("t").cast("double")
    return counts.agg(
        F.sum(F.expr("cast(t as decimal(18, 0)) * cast(t - 1 as decimal(18, 0))")).cast("decimal(38, 0)").alias(f"{name}_pairs2"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}_cubes"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"{name}_triples"),
    )
