"""Blocked order helpers equal plain windows for null keys, null orders and null values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from routelens.operators import ordered as O
from routelens.operators import telemetry as L


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    rows = []
    for k in (None, 1, 2):
        seqs = [*rnd.sample(range(60), 30), *([] if k == 2 else [None])]
        rows += [(k, s, rnd.choice(["a", "a", None]), rnd.choice([1, 5, None])) for s in seqs]
    return spark.createDataFrame(rows, "k int, s int, h string, v int")


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_blocked_matches_windows_with_nulls(data, width):
    w = Window.partitionBy("k").orderBy("s")
    before = F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = data.select("k", "s", F.row_number().over(w).alias("rk"), F.coalesce(before, F.lit(0)).alias("xs"), F.lag("h").over(w).alias("lg"))
    got = O.blocked_rank(data, ["k"], "s", "rk", width=width)
    got = O.blocked_running_sum(got, ["k"], "s", "v", "xs", exclusive=True, width=width)
    got = O.blocked_lag(got, ["k"], "s", "h", "lg", width=width).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _stall(events, repeat, grace):
    w = Window.partitionBy("run").orderBy("s")
    e = events.withColumn("turn", F.row_number().over(w))
    e = e.withColumn("chg", F.when(F.lag("h").over(w) == F.col("h"), 0).otherwise(1))
    e = e.withColumn("island", F.sum("chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("run", "island").orderBy("s")))
    warn = e.where(F.col("pos") == repeat).groupBy("run").agg(F.min("turn").alias("warn_turn"))
    return warn.withColumn("stop_turn", F.col("warn_turn") + grace)


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_stall_detect_matches_windows_with_nulls(spark, width):
    # run 1: the first block ends in x, a null inside the next must not take that x as the hash before
    runs = {1: "xyxx-xx-xyyy", 2: "a-aab--aaa", None: "-bb-bbb"}
    rows = [(k, (i or None) if k is None else i, None if h == "-" else h) for k, s in runs.items() for i, h in enumerate(s)]
    events = spark.createDataFrame(rows, "run int, s int, h string")
    for repeat in (2, 3):
        got = L.stall_detect(events, "run", "s", "h", repeat=repeat, width=width).collect()
        assert sorted(map(str, got)) == sorted(map(str, _stall(events, repeat, 3).collect()))
        assert len(got) == 3
