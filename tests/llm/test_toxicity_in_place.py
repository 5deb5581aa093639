"""Texts stay where they are read: neither labels nor the model may shuffle them."""

import zlib
from collections import Counter

import pytest

from routelens.llm import toxicity
from routelens.llm.common import shared_path, stage


@pytest.fixture
def no_broadcast(spark):
    """Labels too many to be broadcast, staged in several files."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _cells(text):
    sym = [0] * 5 + [int(toxicity._SYMBOL[b]) for b in text.encode()]
    return [sum(s << 6 * (5 - j) for j, s in enumerate(sym[i - 5:i + 1])) for i in range(5, len(sym))]


def test_counts_follow_labels_of_null_repeated_and_unknown_ids(spark, no_broadcast):
    rows = [(i * 7 - 50, f"text number {i} of {i % 5}") for i in range(40)]
    rows += [(None, "no id"), (None, None), rows[3], rows[4], (rows[5][0], "another text"), (1 << 60, "far off"), (-(1 << 60), "")]
    toxic = {d: d % 2 == 0 for d, _ in rows[:40:3]} | {1 << 60: True, rows[5][0]: False, 999_999: True}
    want = Counter()
    for d, t in rows:
        for c in _cells(t or ""):
            want[2, c & toxicity.FIVE] += 1
            if d in toxic:
                want[int(toxic[d]), c] += 1
    docs = toxicity.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    labelled = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic boolean")
    got = toxicity._gather(docs, labelled, shared_path(spark, "counts")).collect()
    assert {(r.kind, r.key): r.n for r in got} == dict(want) and len(got) == len(want)


def test_texts_are_not_shuffled(spark, no_broadcast, monkeypatch):
    rows = [(i, f"you {'vile' if i % 2 else 'kind'} person {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    plans = {}

    def staged(df, name, path=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name, path)

    monkeypatch.setattr(toxicity, "stage", staged)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert "Join" not in plans["toxicity-counts"]
    assert not any("text#" in plan for name, plan in plans.items() if name != "toxicity-counts")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in toxicity.keep_ordinary(docs, model)._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.predicted for r in scored.collect()}
    assert got == {i: i % 2 for i in range(200)}
    assert {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0} == {r.doc_id for r in scored.where("held_out").collect()}
