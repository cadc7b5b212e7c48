"""Mixing sources to target weights by Sainte-Lague apportionment.  DataFrame operations only.

Sources get weights by rank of their name; targets share the corpus by weight and stop at
``most`` times the source's own size, the excess being shared again (closed form over the
sources, ordered by how soon they fill).  The corpus is cut into equal blocks of ``block``
words.  Blocks go to sources by highest quotient target/(2j-1), and a source's blocks go to
its shards by highest quotient of the shard's size.  A shard takes whole passes over its
documents and then documents in seeded order until its quota is filled; the last may be
taken in part.

Shards hold about SHARD_ROWS documents, so a source with a third of all rows is many
tasks.  Tables of sources and shards are aggregates; nothing is collected.

Defined results: null text has size 0 and takes 0; a null source is a source, ordered last;
rows that share an id are taken one by one; an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, scratch

SHARD_ROWS = 2048
GROUP_SHARDS = 1024


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, n_docs, source_size, target; sized: source, size."""
    own = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # one row for each source from here on
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("at", F.row_number().over(by_name) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("at", F.lit(len(weights))).cast("int") + 1))
    own = own.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    own = own.withColumn("capped", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    # where this source and all later ones are open; the first source that this level doesn't fill sets it
    own = own.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")).withColumn("turn", F.row_number().over(filling))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12), F.struct("turn", "level"))).over(Window.partitionBy())
    own = own.withColumn("level", first["level"])
    return own.select("source", "at", "n_docs", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], key: str, seats: str) -> DataFrame:
    """votes with a column ``quota``: whole seats of each key in its group, by highest quotients votes/(2j-1); ties go to the lesser key.

    Quotas differ from rounded shares by no more than a key's share of the group's rounding
    error, so only quotients near the rounded share are compared.
    """
    of = Window.partitionBy(*group)
    votes = votes.withColumn("_all", F.sum("votes").over(of)).withColumn("_keys", F.count("*").over(of))
    share = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(0.0)
    votes = votes.withColumn("_near", F.floor(share * F.col(seats) + 0.5)).withColumn("_reach", F.ceil(share * F.col("_keys") / 2).cast("long") + 2)
    votes = votes.withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")))
    votes = votes.withColumn("_left", F.col(seats) - F.sum("_sure").over(of))
    tried = votes.where("votes > 0").select(*group, key, "votes", "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_near") + F.col("_reach"))).alias("_j"))
    best = Window.partitionBy(*group).orderBy((F.col("votes") / (2 * F.col("_j") - 1)).desc(), key, "_j")
    won = tried.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*group, key).agg(F.count("*").alias("_won"))
    return votes.join(won, [*group, key], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_keys", "_near", "_reach", "_sure", "_left", "_won")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """shards (at, shard, votes, seats of the source) with quota: first to groups of GROUP_SHARDS shards, then within these, so no window holds all shards of a source."""
    shards = shards.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = shards.groupBy("at", "group").agg(F.first("seats").alias("seats"), F.sum("votes").alias("votes"))
    groups = sainte_lague(groups, ["at"], "group", "seats").select("at", "group", F.col("quota").alias("seats"))
    return sainte_lague(shards.drop("seats").join(groups, ["at", "group"]), ["at", "group"], "shard", "seats")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, block: int = 32, seed: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns asked for."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    sized = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("_text")), "sizes")
    goal = targets(sized, weights, float(most))
    goal = goal.withColumn("votes", F.col("target")).withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block)).withColumn("g", F.lit(0))
    goal = scratch(sainte_lague(goal, ["g"], "at", "seats").select("source", "at", "n_docs", "source_size", "target", "quota"), "targets")
    n_shards = F.ceil(F.col("n_docs") / SHARD_ROWS)
    # sources are joined as a table: it has a row for each source and is broadcast only if small
    placed = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text"), n_shards))
    shards = placed.groupBy("at", "shard").agg(F.first("quota").alias("seats"), F.sum("size").alias("votes"))
    shards = shard_quotas(shards).select("at", "shard", F.col("votes").alias("shard_size"), F.least(F.col("quota") * block, F.col("votes") * most).alias("words"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "at", "shard", "_text").join(shards, ["at", "shard"])
    order = Window.partitionBy("at", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_text"), "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    passes = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0)
    rest = F.when(F.col("shard_size") > 0, F.expr("words % shard_size")).otherwise(0)
    taken = F.col("size") * passes + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")
