"""Nothing is cut at a fixed number of rounds, levels or hits; a sink never takes an error for a first run."""

import os

import pytest
from pyspark.sql import functions as F

from routelens.functions.hints import hint_decompose
from routelens.functions.names import camel_words
from routelens.operators import resolve as R
from routelens.sources import sinks


def test_long_ring_is_one_component(spark):
    n = 24
    ring = spark.createDataFrame([("r", f"n{i:03d}", f"n{(i + 1) % n:03d}") for i in range(n)], "repo_id string, src string, dst string")
    got = R.strongly_connected(ring).select("scc").distinct().collect()
    assert len(got) == 1


def test_deep_hint_reaches_its_leaf(spark):
    hint = "List[" * 20 + "Zed" + "]" * 20
    got = hint_decompose(spark.createDataFrame([(1, hint)], "hint_id int, hint string")).collect()
    assert [r.name for r in got] == ["Zed"]


def test_closure_follows_a_long_chain(spark):
    edges = spark.createDataFrame([("r", f"c{i}", f"c{i + 1}") for i in range(30)], "repo_id string, src string, dst string")
    got = R.closure(spark.createDataFrame([("r", "c0")], "repo_id string, node string"), edges)
    assert got.agg(F.max("depth")).first()[0] == 30


@pytest.mark.parametrize("name,words", [("fooBar", ["foo", "bar"]), ("HTTPServer2x", ["http", "server", "2", "x"]),
                                        ("a_b-a", ["a", "b"]), ("", [])])
def test_camel_words(spark, name, words):
    assert spark.createDataFrame([(name,)], "n string").select(camel_words(F.col("n"))).first()[0] == words


def test_artifact_sink_stops_on_unreadable_runs(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x int")
    out = str(tmp_path / "runs")
    assert sinks.artifact_sink({"a": one}, out) == 1
    assert sinks.artifact_sink({"a": one}, out) == 2
    with open(os.path.join(out, "_runs", "broken.parquet"), "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception):
        sinks.artifact_sink({"a": one}, out)
    assert spark.read.parquet(os.path.join(out, "a")).count() == 2
