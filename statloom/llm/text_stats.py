"""Vectorised statistics of documents, and a bounded labelled sample to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, window_hash

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shout_share", "stop_share", "echo_share", "line_words", "distinct_share")
#: The kept verdict may not rise with these.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "echo_share")


def repeated_word_counts(words: Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text, the words in windows that stand in it twice or more."""
    at = words.windows(size)
    out = np.zeros(len(words.count), np.int64)
    if not len(at):
        return out
    key = mix(window_hash(hashes, at, size, 1) ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + size, bool)
    for i in range(size):
        covered[at[twice] + i] = True
    return np.bincount(words.doc[covered[: len(hashes)]], minlength=len(out))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, one column for each of BASE; features, one column for each of FEATURES)."""
    words = Words(texts)
    hashes = words.hashes()
    n = len(texts)
    data = words.data

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[words.doc_end] - total[words.doc_start]

    count = words.count
    blank_bytes = np.zeros(len(data), bool)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    blank_bytes = np.cumsum(inside[:-1]) == 0
    chars = per_text(~blank_bytes & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[data])
    dup = np.fromiter((duplicate_lines(t) for t in texts), np.int64, n)
    repeat = repeated_word_counts(words, hashes)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, n)
    echo = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        echo[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    distinct_key = np.unique(mix(hashes ^ mix(words.doc.astype(np.uint64) + np.uint64(9))), return_index=True)[1]
    distinct = np.bincount(words.doc[distinct_key], minlength=n)
    w, c = np.maximum(count, 1), np.maximum(chars, 1)
    features = np.stack(
        [np.log1p(count), chars / w, symbols / w, dup / np.maximum(lines, 1), repeat / w, per_text(_UPPER[data]) / c, per_text(_DIGIT[data]) / c, per_text(data == ord("!")) / w, per_text(_STOP[data]) / w, np.bincount(words.doc[echo], minlength=n) / w, np.log1p(count / lines), distinct / w],
        axis=1,
    )
    return np.stack([count, chars, symbols, dup, repeat], axis=1).astype(np.int64), features


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Up to ``most`` labelled documents, chosen by a hash of their id: a documented bound for fitting, not for scoring.

    One row for each id; labels with a null id or value are left out.
    """
    chosen = labels.where(F.col("doc_id").isNotNull()).where(" and ".join(f"{c} is not null" for c in columns)).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` small rows
