"""The corpus pipeline: quality classifier, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  A stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import line_dedup, mixing, ngram_join, ordinal, packing
from statloom.llm.common import maybe_in, scratch, table
from statloom.llm.queries import grades

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is a half or more.  Grades are learnt from the labelled documents of the whole table."""
    model = ordinal.fit_grades(docs, grades(table(spark, sf_dir, "labels")), 3)
    return ordinal.grade_documents(docs, model, 2, columns=COLUMNS).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line nearly equals; a document that loses all its lines goes."""
    found = line_dedup.line_dedup(docs, columns=("doc_id", "lang", "source", "n_chars"))
    found = found.where("n_removed = 0 or kept_text rlike '[^ \\\\t\\\\r\\\\n\\\\x0B\\\\f]'")
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): the one with the least id.  Documents with a null id stay; rows that share an id stay or go together."""
    found = ngram_join.ngram_components(docs, n=5, num=8, den=10)
    gone = scratch(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    # only texts whose id may be among the copies are shuffled
    flagged = maybe_in(docs.select(*COLUMNS), "doc_id", gone)
    return flagged.where("not maybe").drop("maybe").unionByName(flagged.where("maybe").drop("maybe").join(gone, "doc_id", "left_anti").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number.  Rows that share an id, or have none, are taken as often as the most taken of them."""
    mixed = mixing.mix_sources(docs)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    chosen = mixed.select("doc_id", times.alias("times")).where("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"])).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("mixing", mix), ("packing", pack)]

#: The stages fit a model, draw hash-seeded selections and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each on what the one before wrote; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
