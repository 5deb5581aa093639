"""Blocked order helpers equal plain windows, including across block boundaries."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from routelens.operators import ordered as O
from routelens.operators import telemetry as L


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(4):
        seqs = rnd.sample(range(0, 60), 25 if k else 40)  # one "hot" key, gaps in the sequence
        for s in seqs:
            rows.append((k, s, rnd.choice("aab"), rnd.randint(0, 9)))
    return spark.createDataFrame(rows, "k int, s int, h string, v int")


@pytest.mark.parametrize("width", [1, 3, 7, 4096])
def test_blocked_matches_windows(data, width):
    w = Window.partitionBy("k").orderBy("s")
    want = data.select("k", "s", F.row_number().over(w).alias("rk"),
                       F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
                       F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("xs"),
                       F.lag("h").over(w).alias("lg"))
    got = O.blocked_rank(data, ["k"], "s", "rk", width=width)
    got = O.blocked_running_sum(got, ["k"], "s", "v", "cs", width=width)
    got = O.blocked_running_sum(got, ["k"], "s", "v", "xs", exclusive=True, width=width)
    got = O.blocked_lag(got, ["k"], "s", "h", "lg", width=width)
    cols = ["k", "s", "rk", "cs", "xs", "lg"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stall_detect_across_blocks(spark):
    seq = "xxyyyzxxxxw"
    ev = spark.createDataFrame([(1, i * 5, h) for i, h in enumerate(seq)], "run int, seq int, h string")
    r = L.stall_detect(ev, "run", "seq", "h", width=7).collect()[0]
    assert (r.warn_turn, r.stop_turn) == (5, 8)  # 'yyy' completes at the fifth turn
