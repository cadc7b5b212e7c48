"""How each source of a language differs from the language and from its other sources, term by term.

A language keeps the terms of at least ``least_docs`` of its documents.  A group (language, source)
gives a kept term p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), where V kept terms have N
occurrences there; so does the language as a whole.  All arithmetic is on integers.

Term search.  The terms of a group with one count there are a bucket and share p; with the least
and the greatest probability that the language gives any of them, each f = p - q of a bucket lies
between two bounds, and its greatest is the upper one.  Walking over the buckets, best bound first,
gives the value that the k-th term has at least; only buckets whose bound isn't strictly below
that are opened, and the best k of their terms are kept.

Pairs.  Sum |p - q| over all kept terms is V |p0 - q0| for the probabilities of absent terms, plus a
correction for the terms of each of the two groups (from its count buckets alone), plus one for
the terms that both have, from postings: for each term, segments of the groups of one block of
about BLOCK sources.  Segments of two blocks are added up in matrices in the task at hand before
they are shuffled, so no row is made for a pair of postings.

Defined results: null text, lang and source are ''; a group without terms has rows for all pairs;
a language without kept terms has value 0 in all of them; rows that share an id, or have none, are
counted one by one; ties are ranked by the bytes of the item; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bounded_batches, chunks, scratch

SCALE = 1_000_000_000
SMOOTH = 5
#: Sources of a block, about; a segment of postings and a side of a matrix hold as many.
BLOCK = 128
#: Cells of matrices that a task holds before it gives them out.
HELD_CELLS = 4_000_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[0x00:0x41] = _SEPARATOR[0x5B:0x61] = _SEPARATOR[0x7B:0x80] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _codes(column) -> tuple:
    import pyarrow as pa
    import pyarrow.compute as pc

    c = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return c.indices.to_numpy(), c.dictionary


def _term_rows(batches):
    """lang, source, term, n, docs of each chunk of documents; a term '' marks a group as met."""
    import pyarrow as pa

    for batch, texts in chunks(batches, "text"):
        lang, langs = _codes(batch.column("lang"))
        source, sources = _codes(batch.column("source"))
        groups, group = np.unique(lang.astype(np.int64) * len(sources) + source, return_inverse=True)
        words = Words(texts, _SEPARATOR, _LOWER)
        g, t, n, docs, terms = groups[:0], groups[:0], groups[:0], groups[:0], pa.array([], pa.binary())
        if len(words.start):
            # words and what lies between them, as slices of one buffer
            edges = np.stack([words.start, words.end], axis=1).ravel().astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(words.data))])
            coded = pieces.dictionary_encode()
            terms, width = coded.dictionary, len(coded.dictionary)
            in_doc, times = np.unique(words.doc * width + coded.indices.to_numpy()[::2], return_counts=True)
            in_group, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            g, t = in_group // width, in_group % width
            n, docs = np.bincount(at, times, len(in_group)).astype(np.int64), np.bincount(at, minlength=len(in_group))
        met = np.concatenate([groups, groups[g]])
        term = pa.concat_arrays([pa.array([b""] * len(groups), pa.binary()), terms.take(pa.array(t))]).cast(pa.string())
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(met // len(sources))), sources.take(pa.array(met % len(sources))), term, pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, docs]))],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; a row with term '' for each group."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = rows.mapInArrow(_term_rows, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) in decimals, which hold any count of words."""
    wide = lambda e: f"cast({e} as decimal(20, 0))"
    return F.expr(f"1 + cast(cast({SCALE} as decimal(10, 0)) * {wide(f'{count} + {SMOOTH}')} div {wide(f'{total} + {SMOOTH} * {terms}')} as bigint)")


def best_terms(scored: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank of the k terms with greatest p - q > 0 of each group."""
    group = ["lang", "source"]
    buckets = scored.groupBy(*group, "n").agg(F.first("p").alias("p"), F.count("*").alias("terms"), F.min("q").alias("least"), F.max("q").alias("most"))
    bounds = buckets.select(*group, "n", (F.col("p") - F.col("least")).alias("bound"), (F.col("p") - F.col("most")).alias("sure"), "terms").where("bound > 0")
    # one term of a bucket has the bound, all others at least the sure value
    steps = bounds.select(*group, F.explode(F.array(F.struct(F.col("bound").alias("v"), F.lit(1).cast("long").alias("c")), F.struct(F.col("sure").alias("v"), (F.col("terms") - 1).alias("c")))).alias("s")).select(*group, "s.*")
    best_first = Window.partitionBy(*group).orderBy(F.col("v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = steps.where("v > 0 and c > 0").withColumn("c", F.sum("c").over(best_first))
    kth = reached.groupBy(*group).agg(F.max(F.when(F.col("c") >= k, F.col("v"))).alias("kth"))
    opened = bounds.join(kth, group).withColumn("kth", F.coalesce("kth", F.lit(1))).where("bound >= kth")
    found = scored.join(opened.select(*group, "n", "kth"), [*group, "n"]).withColumn("value", F.col("p") - F.col("q")).where("value >= kth")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "term"))).where(F.col("rank") <= k)
    return ranked.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


_CELLS = "lang string, block1 long, at1 long, block2 long, at2 long, value long"


def _shared_terms(batches):
    """Corrections for the terms of two groups, added up by pair of groups in matrices."""
    import pyarrow as pa

    sums: dict[tuple, np.ndarray] = {}
    held = 0

    def give():
        for (lang, block1, block2), m in sums.items():
            i, j = np.nonzero(m)
            if len(i):
                full = lambda v: pa.array(np.full(len(i), v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), full(block1), pa.array(i), full(block2), pa.array(j), pa.array(m[i, j])], ["lang", "block1", "at1", "block2", "at2", "value"])

    for batch in batches:
        column = {name: batch.column(name).to_pylist() for name in ("lang", "block1", "block2")}
        sides = []
        for side in "12":
            lists = [batch.column(f"{c}{side}") for c in ("at", "p", "zero")]
            sides.append((lists[0].offsets.to_numpy(), *[x.values.to_numpy() for x in lists]))
        for r in range(batch.num_rows):
            key = column["lang"][r], column["block1"][r], column["block2"][r]
            (a, p, p0), (b, q, q0) = (tuple(v[o[r] : o[r + 1]] for v in values) for o, *values in sides)
            p, p0 = p[:, None], p0[:, None]
            add = np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)
            if key[1] == key[2]:
                add[a[:, None] >= b] = 0
            m = sums.get(key)
            if m is None or m.shape[0] <= a.max() or m.shape[1] <= b.max():
                old = m
                m = sums[key] = np.zeros((max(BLOCK, int(a.max()) + 1, old.shape[0] if old is not None else 0), max(BLOCK, int(b.max()) + 1, old.shape[1] if old is not None else 0)), np.int64)
                held += m.size
                if old is not None:
                    m[: old.shape[0], : old.shape[1]] = old
                    held -= old.size
            m[np.ix_(a, b)] += add
        if held > HELD_CELLS:
            yield from give()
            sums, held = {}, 0
    yield from give()


def source_pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, rank."""
    spots = ["lang", "block", "at"]
    # corrections for terms that one group has, from its count buckets, against the absent terms of each other group
    counts = scored.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("buckets"))
    own = groups.join(counts, ["lang", "source"], "left").select(*spots, "zero", "n_terms", F.coalesce("buckets", F.expr("array()")).alias("buckets"))
    # every group goes to each block of its language
    other = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("block").alias("block2"), F.col("at").alias("at2"), F.col("zero").alias("zero2"))
    apart = F.abs(F.col("zero") - F.col("zero2"))
    met = own.join(other, ["lang", "block"]).where("block <> block2 or at <> at2")
    first = F.struct("block", "at") < F.struct("block2", "at2")
    one = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, x: s + x["terms"] * (F.abs(x["p"] - F.col("zero2")) - apart))
    one = one + F.when(first, F.col("n_terms") * apart).otherwise(0)
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    ones = met.select("lang", pick("block", "block2").alias("block1"), pick("at", "at2").alias("at1"), pick("block2", "block").alias("block2"), pick("at2", "at").alias("at2"), one.alias("value"))
    # and for terms that both have
    placed = scored.select("lang", "source", "term", "p").join(groups.select("lang", "source", "block", "at", "zero"), ["lang", "source"])
    segments = placed.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("at", "p", "zero")).alias("s"))
    segments = scratch(segments.select("lang", "term", "block", *[F.col(f"s.{c}").alias(c) for c in ("at", "p", "zero")]), "postings")
    side = lambda i: segments.select("lang", "term", *[F.col(c).alias(f"{c}{i}") for c in ("block", "at", "p", "zero")])
    both = side(1).join(side(2), ["lang", "term"]).where("block1 <= block2").drop("term").mapInArrow(_shared_terms, _CELLS)
    sums = ones.unionByName(both).groupBy("lang", "block1", "at1", "block2", "at2").agg(F.sum("value").alias("value"))
    for i in (1, 2):
        sums = sums.join(groups.select("lang", F.col("block").alias(f"block{i}"), F.col("at").alias(f"at{i}"), F.col("source").alias(f"source{i}")), ["lang", f"block{i}", f"at{i}"])
    ways = F.array(F.struct(F.col("source1").alias("source"), F.col("source2").alias("item")), F.struct(F.col("source2").alias("source"), F.col("source1").alias("item")))
    pairs = sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def divergence_audit(docs: DataFrame, least_docs: int = 30, k: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = scratch(term_counts(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    held = scratch(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]), "kept")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a row for each term of a language, from that of its least source
    langs = held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "n_terms", "lang_total"])
    groups = groups.withColumn("zero", F.when(F.col("n_terms") > 0, probability("0", "total", "n_terms")).otherwise(0))
    groups = groups.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / BLOCK))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    groups = scratch(groups.withColumn("at", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).cast("long")), "groups")
    scored = held.join(groups.select("lang", "source", "total", "n_terms", "lang_total"), ["lang", "source"])
    scored = scored.select("lang", "source", "term", "n", probability("n", "total", "n_terms").alias("p"), probability("lang_n", "lang_total", "n_terms").alias("q"))
    scored = scratch(scored, "scored")
    return source_pairs(scored, groups).unionByName(best_terms(scored, k))
