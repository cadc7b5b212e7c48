"""How five text filters interact: what each removes in each of the 120 orders they may run in.

Each document fails some of the filters; documents are counted by part and mask of failures, at
most 32 cells for a part.  The orders of a part are then visited by swaps of neighbours
(Steinhaus-Johnson-Trotter), and a swap updates two steps only, from the cells.  Each filter's
removed documents are summed along the walk, which is its Shapley value times the number of orders.

Filter E (a copy of a document with a lesser id) needs no join of documents: texts are known by
their SHA-256, rows are summed by (text, part), where the row of the least id is told apart, and
a window over a text holds a row for each part that has it.

Defined results: a null text is empty; a null part is ''; rows that share an id are counted one by
one, and equal texts under one id are no copies of each other; a null id is less than none and
greater than none, so such a row fails E never and makes no other fail it, and has no labels; of
several labels of an id the greatest count; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failures that the text alone decides; none is null."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    some = F.octet_length(F.btrim(text, F.lit(" \t\n\x0b\f\r"))) > 0
    n = F.when(some, F.size(words)).otherwise(0)
    distinct = F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, mask (bit i: fails FILTERS[i]), n, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit(0)
    for i, failed in enumerate(text_filters(text).values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    # rows without an id are dealt by their text
    rows = rows.withColumn("_none", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("key")))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marked = marked.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("_none", F.lit(False))
    rows = rows.join(marked, ["_none", "_id"], "left").fillna(0, ["good", "toxic"])
    once = rows.groupBy("_none", "_id", "part", "mask", "key", "good", "toxic").agg(F.count("*").alias("n"))
    least = F.min(F.when(~F.col("_none"), F.struct("_id", "n", "good", "toxic")))
    none = F.sum(F.when(F.col("_none"), F.col("n")).otherwise(0))
    texts = once.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"), least.alias("m"), none.alias("none"))
    texts = texts.withColumn("_first", F.col("m._id") == F.min("m._id").over(Window.partitionBy("key")))
    # what doesn't fail E: the first document and rows without an id, which have no labels
    first = F.when(F.col("_first"), F.col("m.n")).otherwise(0)
    stays = {"n": first + F.col("none"), "good": first * F.coalesce("m.good", F.lit(0)), "toxic": first * F.coalesce("m.toxic", F.lit(0))}
    last = 1 << (len(FILTERS) - 1)
    own = F.struct(F.col("mask"), *[stays[c].cast("long").alias(c) for c in COUNTS])
    copies = F.struct((F.col("mask") + last).alias("mask"), *[(F.col(c) - stays[c]).cast("long").alias(c) for c in COUNTS])
    cells = texts.select("part", F.explode(F.array(own, copies)).alias("c")).select("part", "c.*")
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def swaps(n: int) -> Iterator[int]:
    """Left places of the neighbours to swap, so that all orders of n are met, from the first, once each."""
    order, step = list(range(n)), [-1] * n
    while True:
        movable = [x for x in order if 0 <= (to := order.index(x) + step[x]) < n and order[to] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + step[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield min(at, to)


def walk(masks: np.ndarray, counts: np.ndarray) -> dict[str, list]:
    """Columns filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of one part.

    counts: n, good, toxic of each mask, one row each.
    """
    k = len(FILTERS)
    fails = [counts[masks >> f & 1 == 1].sum(0)[0] for f in range(k)]
    alone = [counts[masks == 1 << f].sum(0)[0] for f in range(k)]
    order = list(range(k))
    removed = np.zeros((k, counts.shape[1]), np.int64)  # by step

    def update(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        removed[step] = counts[(masks & before == 0) & (masks >> order[step] & 1 == 1)].sum(0)

    for step in range(k):
        update(step)
    whole, shapley, seen = counts.sum(0)[0], np.zeros(k, np.int64), []
    for swap in (None, *swaps(k)):
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            update(swap)
            update(swap + 1)
        shapley[order] += removed[:, 0]
        seen.append((tuple(order), removed.copy()))
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order, removed in seen:
        name = "".join(FILTERS[f] for f in order)
        kept = whole - removed[:, 0].cumsum()
        for step, f in enumerate(order):
            n, good, toxic = removed[step]
            for c, v in zip(out, (name, step + 1, kept[step], n, fails[f] - n, alone[f], good, toxic, shapley[f])):
                out[c].append(v)
    return out


_WALK = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """A row for each part (a value of lang, unless another column is asked for), order of the filters and step."""
    import pandas as pd

    def one_part(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": key[0], **walk(cells["mask"].to_numpy(), cells[list(COUNTS)].to_numpy())})

    cells = failure_cells(docs, labels, F.col("lang") if part is None else part)
    return cells.groupBy("part").applyInPandas(one_part, _WALK)
