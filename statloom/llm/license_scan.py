"""License scans by ordered signature rules.  DataFrame and SQL functions only.

A rule is a regular expression over the normalised text (lower-case words parted by one
space), with a keyword that must be there before the expression is tried.  Texts without any of a
few stems are not even normalised.  Detections are word intervals.  A detection is suppressed if its
interval lies in that of a rule of higher priority (a lesser number), or in a longer one of
equal priority, or repeats one.

All of it happens inside the row: no join, no shuffle.  Expressions are constants, compiled
once.  An expression's places are marked in one pass over the text, which is then split into words once;
detections are sorted, and each is compared only with those that start shortly before it, so time grows
with the text and its detections, not with their square.

Defined results: null text is empty, has no words, no labels and score 0; rows are judged
one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LONGEST, SHORT_WORDS, STEMS, rules

#: Phrases of the base contract and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Detections before one that are looked at first; where more start within LONGEST words, all are.
NEAR = 128
_OPEN, _CLOSE = "\x01", "\x02"
_DETECTIONS = "array<struct<a:int,back:int,p:int,label:string,s:double>>"


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once where f uses it within a lambda."""
    return F.transform(F.array(x), f)[0]


def _spans(marked: Column) -> Column:
    """Array of (a, z), first and last word from 0, of the marked places of `` w0 w1 ... ``."""

    def at(words: Column, mark: str) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())

    def both(words: Column) -> Column:
        return F.zip_with(at(words, _OPEN), at(words, _CLOSE), lambda a, z: F.struct(a.alias("a"), z.alias("z")))

    return _bound(F.split(F.trim(marked), " "), both)


def _marked(column: str, named: list[tuple[str, str, str]]) -> Column:
    """Array of (what, m): for each (SQL of a struct, keyword, expression) whose expression has places, the text with these marked."""
    one = "struct({} AS what, CASE WHEN contains({}, '{}') THEN regexp_replace({}, r'(?<= )(?:{})(?= )', '{}$0{}') END AS m)"
    every = F.expr("array(" + ", ".join(one.format(what, column, k, column, e, _OPEN, _CLOSE) for what, k, e in named) + ")")
    return F.filter(every, lambda x: F.contains(x["m"], F.lit(_OPEN)))


def _found(column: str) -> Column:
    """All detections of all rules, by start, longest first, then by priority."""
    marked = _marked(column, [(f"named_struct('p', {p}, 'label', '{label}', 's', {score}D)", k, e) for p, label, k, e, score in rules()])

    def detected(x: Column) -> Column:
        # back: minus the last word, so that of equal starts the longest sorts first
        return F.transform(_spans(x["m"]), lambda w: F.struct(w["a"].alias("a"), (-w["z"]).alias("back"), x["what"]["p"].alias("p"), x["what"]["label"].alias("label"), x["what"]["s"].alias("s")))

    return F.sort_array(F.flatten(F.transform(marked, detected)))


def _kept(found: Column) -> Column:
    """Sorted detections without those that another covers.  What covers a detection sorts before it and starts less than LONGEST words before it."""

    def covered(y: Column, before: Column) -> Column:
        covers = lambda x: (x["back"] <= y["back"]) & ((x["p"] < y["p"]) | ((x["p"] == y["p"]) & ((x["a"] < y["a"]) | (x["back"] < y["back"]))))
        return F.exists(before, covers)

    def kept(d: Column) -> Column:
        crowded = F.exists(F.zip_with(d, F.slice(d, NEAR + 1, F.greatest(F.size(d) - NEAR, F.lit(0))), lambda x, y: y["a"] - x["a"] < LONGEST), lambda c: c)
        near = F.filter(d, lambda y, i: ~covered(y, F.slice(d, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)))))
        every = F.filter(d, lambda y, i: ~covered(y, F.slice(d, 1, i)))
        return F.when(crowded, every).otherwise(near)

    return _bound(found, kept)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (a, z, p, label, s)."""
    # letters and digits of ASCII and all beyond it, as Java compiles them best
    word, not_word = r"[\p{Alnum}\x{80}-\x{10FFFF}]++", r"[^\p{Alnum}\x{80}-\x{10FFFF}]++"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("raw"))

    # lower() folds more than A-Z, so it may only open the gate; what is matched is folded exactly
    def gate(t: Column) -> Column:
        opened = t.rlike(SHORT_WORDS)
        for stem in STEMS:
            opened = F.contains(t, F.lit(stem)) | opened
        return opened

    df = df.withColumn("open", _bound(F.lower("raw"), gate))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("raw", upper, lower), not_word, " ")), F.lit(" "))
    df = df.withColumn("norm", F.when(F.col("open"), norm))
    df = df.withColumn("n_words", F.regexp_count("raw", F.lit(word)).cast("long"))

    stated = _marked("norm", [(f"'{label}'", phrase, phrase) for phrase, label in BASE_PHRASES])
    base = F.flatten(F.transform(stated, lambda x: F.transform(_spans(x["m"]), lambda w: F.struct(w["a"].alias("a"), x["what"].alias("label")))))
    df = df.withColumn("base", F.when(F.contains("norm", F.lit(" license ")), base))
    df = df.withColumn("kept", F.when(F.col("open"), _kept(_found("norm"))))
    strings = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.transform("base", lambda x: x["label"]), strings)))
    more = F.coalesce(F.transform("kept", lambda x: x["label"]), strings)
    shown = F.transform(F.coalesce("kept", F.array().cast(_DETECTIONS)), lambda x: F.struct(x["a"].cast("long").alias("a"), (-x["back"]).cast("long").alias("z"), x["p"].alias("p"), x["label"].alias("label"), x["s"].alias("s")))
    return df.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["a"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.round(F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda x: x["s"])), F.lit(0.0)), F.when(F.size(base_labels) > 0, 0.9).otherwise(0.0)), 4).alias("score"),
        shown.alias("detections"),
    )
