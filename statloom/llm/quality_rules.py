"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded labelled sample, with monotonic constraints on
chosen statistics (a split against the direction is refused, and leaf values are held
between the bounds that splits above them set).  The forest is flattened into numpy node
arrays, and a batch of documents is scored by walking all trees level by level.

Defined results: null and empty text have no words and fail the base rules; without both
classes among the labels the trees keep every document that passes the base rules; extra
columns are ignored; each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks
from .text_stats import BASE, FALLING, FEATURES, describe, labelled_sample

#: Labelled documents used for fitting, at most.
SAMPLE_ROWS = 6000


@dataclass
class Forest:
    """Node arrays of all trees; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0, least: int = 10) -> Forest:
    """Logistic gradient boosting; monotone: -1, 0 or 1 for each column."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    prior = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, n_bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        raw = np.full(len(y), prior)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            step = np.zeros(len(y))

            def leaf(rows, lo, hi):
                return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))

            def grow(rows, level, lo, hi):
                me = add(rate * leaf(rows, lo, hi))
                step[rows] = nodes["value"][me]
                if level == depth:
                    return me
                G, H, best = g[rows].sum(), h[rows].sum(), (1e-6,)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(G - gl) / (H - hl + ridge), lo, hi)
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
                if len(best) == 1:
                    return me
                _, f, k, vl, vr = best
                middle = (vl + vr) / 2
                bounds = ((lo, hi), (lo, hi)) if not monotone[f] else (((lo, middle), (middle, hi)) if monotone[f] > 0 else ((middle, hi), (lo, middle)))
                go = binned[rows, f] <= k
                nodes["feature"][me], nodes["threshold"][me] = f, float(cuts[f][k])
                nodes["left"][me] = grow(rows[go], level + 1, *bounds[0])
                nodes["right"][me] = grow(rows[~go], level + 1, *bounds[1])
                return me

            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
            raw += step
    return Forest(*(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots, np.int64), depth, prior)


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Forest:
    bounded_batches(docs.sparkSession)

    def features(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            _, x = describe(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c) for c in x.T)], names=["doc_id", "quality", *FEATURES])

    sample = labelled_sample(docs, labels, ["quality"], most).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
    found = sample.mapInArrow(features, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()  # at most `most` rows
    found = found.sort_values(["doc_id", *FEATURES])
    monotone = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    return fit_forest(found[list(FEATURES)].to_numpy(float), (found["quality"] > 0).to_numpy(float), monotone)


def quality_rules(docs: DataFrame, forest: Forest, least_words: int = 50, most_repeat: int = 50, cut: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes

    def judge(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            base, x = describe(texts)
            score = held.value.score(x)
            failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeat * base[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(~failed & (score >= cut)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, score double")
