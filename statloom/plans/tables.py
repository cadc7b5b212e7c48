"""Given tables as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import run_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the tables that it names."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t, df in frames.items():
        df.createOrReplaceTempView(t)
    return run_sql(spark, text)
