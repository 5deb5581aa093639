"""The stop test of the components on more rows than a sum of longs holds."""

from pyspark.sql import functions as F

from routelens.llm.components import _mark


def test_mark_of_many_edges(spark):
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    mark = _mark(edges)
    assert mark[0] == 20_000_000 and mark == _mark(edges)
    assert mark != _mark(edges.withColumn("v", F.when(F.col("u") == 7, F.col("v") + 1).otherwise(F.col("v"))))
