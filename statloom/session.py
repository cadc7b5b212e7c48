"""Spark sessions with the settings that the library relies on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "statloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # "x" is an identifier, as in standard SQL
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.ui.showConsoleProgress": "false",
    } | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """A query without a bound on the rows of a recursion; Spark's bound on its steps (100) stays.

    Spark has the bound on rows (a million by default) for a session only, and reads it when the query runs.
    """
    if re.search(r"\brecursive\b", text, re.IGNORECASE):
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(text)
