"""Helpers around the session."""

from pyspark.sql import functions as F

from quern.session import cut_lineage


def test_estimates_do_not_grow_with_rounds(spark):
    rows = spark.range(4).select(F.col("id").alias("a"))
    for _ in range(6):
        rows = cut_lineage(rows.join(rows.select(F.col("a").alias("b")), F.col("a") == F.col("b")).join(rows.select(F.col("a").alias("c")), F.col("a") == F.col("c")).select("a"))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert sorted(r["a"] for r in rows.collect()) == [0, 1, 2, 3]
