"""JSON lines: the union of keys in the order of their first appearance; nested values as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import normalise
from .base import Connector, ImportOptions


class JsonlConnector(Connector):
    name = "jsonl"
    extensions = ("jsonl", "ndjson")

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        df = normalise(spark.read.json(path))
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.json_object_keys("value")).alias("at", "key"))
        seen = lines.groupBy("key").agg(F.min(F.struct("line", "at")).alias("first")).orderBy("first").collect()  # a row for each column
        keys = [r["key"] for r in seen if r["key"] in df.columns]
        df = df.select(*[F.col(f"`{c}`") for c in [*keys, *[c for c in df.columns if c not in keys]]])
        return df if options.max_rows is None else df.limit(options.max_rows)
