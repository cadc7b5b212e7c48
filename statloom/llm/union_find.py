"""Connected components of an edge table by alternating large and small stars.

Only DataFrame operations; each round's edges are written to the shared folder, and no
label or link is collected.  A node with very many neighbours costs one pre-aggregated
minimum and a join in which such nodes' rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the least node that links reach; only nodes with an edge to another node appear."""
    edges, before = _written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, ["u"], 2 * before["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node now points at few smaller ones: the hubs are on the other side
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, (edges, after) = edges, _written(small)
        discard(last)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Distinct edges in the shared folder, with their count and a sum of their hashes."""
    seen = Observation()
    edges = edges.where("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return scratch(edges, "edges"), seen.get
