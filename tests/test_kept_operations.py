"""The kept operations: events are put together in one pass over plain columns, before anything is parsed or joined."""

import re

from routelens.operators.assemble import op_keep_first
from routelens.plans.schema import kept_ops

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_rows_that_stand_for_several_are_counted_as_such(spark):
    rows = spark.createDataFrame([("r", "/a", "GET", 2, 1, 3, "x"), ("r", "/a", "GET", 1, 9, 2, "y"), ("r", "/b", "GET", 1, 1, 1, "z"),
                                  ("r", None, "GET", 1, 1, 4, "n")], "repo_id string, path string, method string, file_ord int, ep_ord int, seen long, v string")
    kept, _ = op_keep_first(rows, path_col="path", seen="seen")
    assert sorted((r.path or "", r.v, r.n_seen) for r in kept.collect()) == [("", "n", 4), ("/a", "y", 5), ("/b", "z", 1)]


def test_kept_operations_are_the_first_of_their_spellings(spark, tmp_path):
    # users 0 and 3 are of different repositories; users 0 and 5 spell the same path differently
    rows = [(e, None, u, t, v, p) for e, u, t, v, p in (
        (4, 0, "view", 30.0, '{"k": 60}'), (8, 0, "view", 1.0, '{"k": 3}'), (0, 5, "view", None, None), (12, 3, "view", 5.0, '{"k": 20}'),
        (1, 5, "view", 20.0, '{"k": 7}'), (4, 0, "view", 30.0, '{"k": 60}'), (16, 0, None, 1.0, '{"k": 1}'))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    got = kept_ops(spark, str(tmp_path))
    assert sorted((r.repo_id, r.path, r.method, r.event_id, r.k, r.n_seen, len(r.responses)) for r in got.collect()) == [
        ("svc0", "/views/{id}", "GET", 4, 60, 4, 3), ("svc0", "/views/{id}", "POST", 1, 7, 1, 1), ("svc3", "/views/{viewId}", "GET", 12, 20, 1, 2)]
    # nothing is parsed below the first grouping, and no event is joined
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = max(i for i, line in enumerate(lines) if re.search(r"\bAggregate ", line))
    assert not any("get_json_object" in line or "Join" in line for line in lines[last:])
    assert not any("get_json_object" in line for line in lines if re.search(r"\bAggregate ", line))
    assert all(any("Aggregate " in upper for upper in lines[i - 3:i]) for i, line in enumerate(lines) if "Relation" in line)
