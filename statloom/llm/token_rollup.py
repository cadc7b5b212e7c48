"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are sums of signed
deltas: an insert adds a document's counts, a delete takes them away, a revision does both.
A batch of deltas is aggregated and written to a folder of its own attempt; then a marker named after the
batch is made, which only one writer can do, and the batch counts.  Committing an id again changes
nothing, and an attempt that broke off or lost the race never counts, so a job that lost its
executors can simply run again.  ``compact`` adds committed batches to a snapshot of the totals; later totals read
that snapshot and the batches since.

Defined results: null source or language is a group of its own; null text has no tokens and
counts as a document; a revision from or to null text is one from or to no tokens; rows
that share an id are counted one by one; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokenize import default_path, gathered, token_counts

KEYS = ("source", "lang", "tokenizer_version")


def counted(docs: DataFrame, tokenizer: str | None = None, version: str = "word_bpe_49k", text_col: str = "text") -> DataFrame:
    """source, lang, tokenizer_version, n_tokens for each document."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_path()

    def count(batches):
        import pyarrow as pa

        for part, texts in gathered(batches, "text", ["source", "lang"]):
            n = token_counts(path, texts)
            yield from part.append_column("tokenizer_version", pa.array([version] * len(texts))).append_column("n_tokens", pa.array(n, pa.int64())).to_batches()

    docs = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return docs.mapInArrow(count, "source string, lang string, tokenizer_version string, n_tokens long")


def deltas(counts: DataFrame, sign: int) -> DataFrame:
    """Signed additive deltas, pre-aggregated: hot groups cost one row for each task."""
    return counts.groupBy(*KEYS).agg((F.lit(sign) * F.count("*")).cast("long").alias("n_docs"), (F.lit(sign) * F.sum("n_tokens")).cast("long").alias("n_tokens"))


def inserts(docs: DataFrame, **kw) -> DataFrame:
    return deltas(counted(docs, **kw), 1)


def deletes(docs: DataFrame, **kw) -> DataFrame:
    return deltas(counted(docs, **kw), -1)


def revisions(before: DataFrame, after: DataFrame, **kw) -> DataFrame:
    return deletes(before, **kw).unionByName(inserts(after, **kw))


class Rollup:
    """Committed batches and snapshots of their totals in a folder that all executors share.

    commits/<batch>: marker, holds the attempt's name; data/<attempt>: its deltas;
    snapshots/<n>: marker, holds the attempt's name; totals/<attempt>, included/<attempt>: its totals and the batches in them.
    """

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _mark(self, name: str, content: str) -> bool:
        """Whether this writer made the marker; a file system makes a file that is not there for one writer only."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._at(name)):
                return False
            raise e
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _marked(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._at(f"commits/{batch_id}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was new."""
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self.committed(batch_id):
            return False
        attempt = f"{batch_id}.{uuid.uuid4().hex}"
        _summed(changes).write.parquet(f"{self.path}/data/{attempt}")
        if self._mark(f"commits/{batch_id}", attempt):
            return True
        self._fs.delete(self._at(f"data/{attempt}"), True)
        return False

    def _open(self) -> tuple[DataFrame, list[str], list[str]]:
        """(deltas since the last snapshot with its totals, batches in the snapshot, batches since)."""
        n = max(map(int, self._names("snapshots")), default=0)
        last = self._marked(f"snapshots/{n}") if n else None
        inside = [r["batch"] for r in self.spark.read.parquet(f"{self.path}/included/{last}").collect()] if last else []  # ids only
        since = sorted(set(self._names("commits")) - set(inside))
        paths = [f"{self.path}/data/{self._marked(f'commits/{b}')}" for b in since] + ([f"{self.path}/totals/{last}"] if last else [])
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows, inside, since

    def totals(self) -> DataFrame:
        """Groups that still hold documents or tokens."""
        return _summed(self._open()[0]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Adds the batches since the last snapshot to a new one; whether there were any and no other writer was first."""
        rows, inside, since = self._open()
        if not since:
            return False
        n, attempt = max(map(int, self._names("snapshots")), default=0) + 1, uuid.uuid4().hex
        _summed(rows).write.parquet(f"{self.path}/totals/{attempt}")
        self.spark.createDataFrame([(b,) for b in [*inside, *since]], "batch string").write.parquet(f"{self.path}/included/{attempt}")
        return self._mark(f"snapshots/{n}", attempt)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
