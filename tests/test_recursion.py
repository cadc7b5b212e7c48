"""Recursive queries have no bound on rows."""

import pytest
from pyspark.sql import functions as F

from statloom.plans import registry
from statloom.studio import Studio

LIMIT = "spark.sql.cteRecursionRowLimit"


@pytest.fixture
def low_limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "200")
    yield
    spark.conf.set(LIMIT, before)


def test_recursion_over_a_table(spark, tmp_path, low_limit):
    orders = spark.range(1, 1001).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit(300000.0).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["cte_recursive"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, 1, k.bit_length() - 1) for k in range(1, 1001)]


def test_recursion_in_the_query_box(spark, low_limit):
    text = "WITH RECURSIVE t(i, k) AS (SELECT id, 0 FROM range(500) UNION ALL SELECT i, k + 1 FROM t WHERE k < 2) SELECT k, count(*) AS n FROM t GROUP BY k ORDER BY k"
    assert Studio(spark).query(text).rows == [(0, 500), (1, 500), (2, 500)]
