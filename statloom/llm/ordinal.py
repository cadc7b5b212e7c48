"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds and ordered
thresholds t_0 < t_1 < ...  Features are hashed: presence of each lower-cased letter run
and of its first PREFIX bytes, presence of each word shape, and the share of words of each shape in steps.

Grades are fitted on a bounded, documented sample; every document is scored on its whole
text.  Defined results: null and empty text have no features and get the thresholds' own
probabilities; without labels, or with one grade only, every document gets that grade with
certainty; extra columns are ignored; each row is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, chunks, mix, trim
from .text_stats import labelled_sample

#: Labelled documents used for fitting, at most.
SAMPLE_ROWS = 8000
LOG2_WEIGHTS = 22
#: Bytes of a letter run that count as its stem.
PREFIX = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
#: Byte classes of word shapes: lower a, upper A, digit 9, continuation and other non-ASCII a, the rest themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")


def _shape_hash(words: Words) -> np.ndarray:
    """Hash of what a word starts and ends with and of its least and largest class: equal for most words of a kind."""
    d = _SHAPE[words.data].astype(np.uint64)
    if not len(words.start):
        return np.zeros(0, np.uint64)
    inside = np.stack([words.start, words.end], axis=1).ravel()
    inside = inside[:-1] if inside[-1] >= len(d) else inside
    low, high = np.minimum.reduceat(d, inside)[::2], np.maximum.reduceat(d, inside)[::2]
    at = lambda i: d[i]
    size = words.end - words.start
    second = np.where(size > 1, at(np.minimum(words.start + 1, words.end - 1)), 0)
    beforelast = np.where(size > 1, at(np.maximum(words.end - 2, words.start)), 0)
    parts = np.stack([at(words.start), second, beforelast, at(words.end - 1), low, high])
    return mix(sum(mix(p + np.uint64(1000 * (i + 1))) for i, p in enumerate(parts)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature): sorted, each pair once."""
    n_slots = np.uint64(LOG2_WEIGHTS)
    letters = Words(texts, blank=_NOT_LETTER, fold=_LOWER)
    words = Words(texts)
    plain = words.hashes()
    shape = _shape_hash(words)
    echo = np.zeros(len(plain), bool)
    if len(plain) > 1:
        echo[1:] = (plain[1:] == plain[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = np.where(echo, mix(np.full(1, 77, np.uint64))[0], shape)
    # the share of each shape, in steps of an eighth
    key, count = np.unique((words.doc.astype(np.uint64) << np.uint64(40)) | (shape >> np.uint64(24)), return_counts=True)
    doc, kind = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
    step = (8 * count / np.maximum(words.count[doc], 1)).astype(np.uint64)
    stem = letters.hashes(PREFIX)
    every_doc = np.concatenate([letters.doc, letters.doc, doc, doc])
    every = np.concatenate([letters.hashes(), mix(stem ^ np.uint64(0x57E3)), mix(kind ^ np.uint64(0x5EED)), mix(kind + mix(step + np.uint64(1)))]) >> np.uint64(64) - n_slots
    kind_of = np.uint32 if len(texts) <= 1 << (32 - LOG2_WEIGHTS) else np.uint64
    packed = np.sort((every_doc.astype(kind_of) << kind_of(n_slots)) | every.astype(kind_of))
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    return (packed >> kind_of(n_slots)).astype(np.int64), (packed & kind_of((1 << LOG2_WEIGHTS) - 1)).astype(np.int64)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        doc, slot = features(texts)
        score = np.bincount(doc, self.weights[slot], len(texts))
        return _sigmoid(score[:, None] - self.thresholds)

    def __getstate__(self):
        """Only weights other than 0 are sent: a few thousand of 2**LOG2_WEIGHTS."""
        at = np.flatnonzero(self.weights).astype(np.int32)
        return at, self.weights[at], len(self.weights), self.thresholds

    def __setstate__(self, state):
        at, weights, size, self.thresholds = state
        self.weights = np.zeros(size, weights.dtype)
        self.weights[at] = weights


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def informative(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, n_grades: int, least_g: float = 24.0) -> np.ndarray:
    """Slots whose presence depends on the grade, by a G-test: invented and rare words are mostly noise."""
    size = int(slot.max(initial=-1)) + 1
    total = np.bincount(slot, minlength=size).astype(float)
    g = np.zeros(size)
    for k in range(n_grades):
        share = max((grade == k).mean(), 1e-9) if len(grade) else 1.0
        own = np.bincount(slot[(grade == k)[doc]], minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(own > 0, 2 * own * np.log(own / (total * share)), 0)
    return g >= least_g


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with return_inverse, for small whole numbers: 32 bits each and no sort of all."""
    there = np.zeros(int(x.max(initial=-1)) + 1, bool)
    there[x] = True
    rank = np.cumsum(there, dtype=np.int32)
    rank -= 1
    return np.flatnonzero(there), rank[x]


def fit_ordinal(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, n_grades: int, least: int = 4, ridge: float = 5e-4, rounds: int = 250, rate: float = 0.05, screen: np.ndarray | None = None, lowering: bool = True) -> Ordinal:
    """Maximum likelihood by full-batch Adam; slots in fewer than ``least`` sampled documents, or that tell nothing of the grade, keep weight 0.

    With ``lowering`` weights are held at or below 0: text can only speak against a
    document, so a short one is not rejected for want of evidence.
    """
    n = max(len(grade), 1)
    known, slot = _ranks(slot)  # far fewer than there are weights
    telling = informative(doc, slot, grade, n_grades) if screen is None else screen[known]
    common = (np.bincount(slot, minlength=len(known)) >= least) & telling
    doc, slot = doc[common[slot]], slot[common[slot]]
    share = np.array([((grade > k).sum() + 0.5) / (n + 1) for k in range(n_grades - 1)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(n_grades - 1) * 1e-3)
    if len(np.unique(grade)) < 2:
        only = int(grade[0]) if len(grade) else n_grades - 1
        return Ordinal(np.zeros(1 << LOG2_WEIGHTS, np.float32), np.where(np.arange(n_grades - 1) < only, -40.0, 40.0))
    used, slot = _ranks(slot)
    size, weights = len(used), np.zeros(len(used))
    # rarer grades weigh more, by the square root of how much rarer they are
    counts = np.bincount(grade, minlength=n_grades)
    weight = np.sqrt(len(grade) / (n_grades * np.maximum(counts, 1)))
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    state = [np.zeros(size), np.zeros(size), np.zeros(len(free)), np.zeros(len(free))]
    for t in range(1, rounds + 1):
        cuts = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(doc, weights[slot], len(grade))
        s = _sigmoid(score[:, None] - cuts)
        full = np.concatenate([np.ones((len(grade), 1)), s, np.zeros((len(grade), 1))], axis=1)
        slope = full * (1 - full)
        rows = np.arange(len(grade))
        p = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
        up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p  # d log p / d score is up - down
        g_score = -(up - down) * weight[grade] / n
        g_cut = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            g_cut[k] = (weight[k + 1] * up[grade == k + 1].sum() - weight[k] * down[grade == k].sum()) / n
        g_w = np.bincount(slot, g_score[doc], size) + ridge * weights
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_free = np.concatenate([[tail[0]], tail[1:] * np.exp(free[1:])])
        for x, g, m, v in ((weights, g_w, state[0], state[1]), (free, g_free, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if lowering:
            np.minimum(weights, 0, out=weights)
    cuts = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
    every = np.zeros(1 << LOG2_WEIGHTS, np.float32)
    every[known[used]] = weights
    return Ordinal(every, cuts)


def fit_grades(docs: DataFrame, graded: DataFrame, n_grades: int, most: int = SAMPLE_ROWS) -> Ordinal:
    """graded: doc_id and grade, 0 to n_grades - 1."""
    bounded_batches(docs.sparkSession)

    def hashed(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            doc, slot = features(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "grade", "slots"])

    sample = labelled_sample(docs, graded, ["grade"], most).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"), "text")
    rows = sample.mapInArrow(hashed, "doc_id long, grade int, slots binary").toPandas().sort_values(["doc_id", "slots"])  # at most `most` rows
    grade = rows["grade"].to_numpy(np.int64)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), rows["slots"].map(len).to_numpy(np.int64) // 4)
    slot = np.frombuffer(b"".join(rows["slots"]), np.int32)
    del rows
    model = fit_ordinal(doc, slot, grade, n_grades)
    del doc, slot
    trim()
    return model


def grade_documents(docs: DataFrame, model: Ordinal, least_grade: int, cut: float = 0.5, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns asked for, with expected_grade, tail_probability (P(grade >= least_grade)) and kept."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**LOG2_WEIGHTS weights
    used = list(dict.fromkeys([*columns, "text"]))
    types = dict(docs.dtypes)

    def judge(batches):
        import pyarrow as pa

        for batch, texts in chunks(batches, "text"):
            above = held.value.above(texts)
            tail = above[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= cut)], names=[*columns, "expected_grade", "tail_probability", "kept"])

    shape = "".join(f"`{c}` {types[c]}, " for c in columns)
    return docs.select(*used).mapInArrow(judge, shape + "expected_grade double, tail_probability double, kept boolean")
