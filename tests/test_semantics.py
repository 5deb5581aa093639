"""Rules that the worked bindings do not reach: dotted names, term building, id collisions, late events."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from routelens.operators import detect as D
from routelens.operators import resolve as G
from routelens.operators import spec as A
from routelens.streaming import progress as P


def _resolve(spark, name, defs, fragment=None):
    refs = spark.createDataFrame([("r", 1, name, fragment)], "repo_id string, ref_id int, name string, fragment string")
    d = spark.createDataFrame([("r", *x) for x in defs], "repo_id string, name string, path string, line int, scope string")
    rows = G.resolve_indexed(refs, d).collect()
    return (rows[0].path, rows[0].how, rows[0].n_candidates) if rows else None


def test_dotted_names_by_scope_then_file_name(spark):
    scoped = [("Leaf", "a/z.cs", 1, "App.Tree"), ("Leaf", "a/b.cs", 1, "App.Bush"), ("Leaf", "a/y.cs", 1, "Tree")]
    assert _resolve(spark, "Tree.Leaf", scoped) == ("a/y.cs", "scope", 2)
    assert _resolve(spark, "Tree.Leaf", scoped, "z.cs") == ("a/z.cs", "import", 2)
    assert _resolve(spark, "Bush.Leaf", scoped) == ("a/b.cs", "single", 1)
    assert _resolve(spark, "Tree.t", [("t", "x/other.ml", 1, None), ("t", "x/tree.ml", 4, None)]) == ("x/tree.ml", "single", 1)
    assert _resolve(spark, "Rock.Leaf", scoped) is None


def test_stem_score_needs_the_name_inside_the_stem(spark):
    defs = [("BlueLamp", "a/zoo.ts", 1, None), ("BlueLamp", "b/lamp.ts", 1, None)]
    assert _resolve(spark, "BlueLamp", defs)[0] == "a/zoo.ts"
    assert _resolve(spark, "BlueLamp", defs + [("BlueLamp", "c/blueLampView.ts", 1, None)])[0] == "c/blueLampView.ts"


def test_scan_keeps_files_without_the_outer_type_if_none_has_it(spark):
    lines = spark.createDataFrame([("r", "m.py", 3, "class Inner:"), ("r", "n.py", 1, "class Inner:"), ("r", "n.py", 2, "class B:")],
                                  "repo_id string, path string, line_no int, line string")
    refs = spark.createDataFrame([("r", 1, "Gone.Inner", None), ("r", 2, "B.Inner", None)], "repo_id string, ref_id int, name string, fragment string")
    got = {r.ref_id: r.path for r in G.resolve_by_scan(refs, lines, [(0, r"class\s+(\w+)")]).collect()}
    assert got == {1: "m.py", 2: "n.py"}


def test_route_terms_and_prefix_mentions(spark):
    routes = spark.createDataFrame([("r", "src/orders.api.ts"), ("r", "web/handlers/pay.go"), ("r", "top.py")], "repo_id string, path string")
    terms = D.route_terms(routes)
    assert {t.term for t in terms.collect()} == {"orders.api.ts", "orders.api", "src/orders.api", "pay.go", "handlers/pay", "handlers", "top.py"}
    texts = ['import "../../src/orders.apis"', "from './orders.api'", 'x = "web/handlersX"', "orders.api.ts", 'y = "order.api"', '"a/top.pyc"', None, ""]
    files = spark.createDataFrame([("r", f"f{i}", i, t) for i, t in enumerate(texts)], "repo_id string, path string, file_ord int, content string")
    known = files.where("file_ord = 99").select("repo_id", "path")
    assert {r.path for r in D.importer_detect(files, terms, known).collect()} == {"f0", "f1", "f2", "f5"}
    assert D.importer_detect(files, terms.limit(0), known).count() == 0


def test_path_prefix_of_untagged_ids_and_collisions_by_group(spark):
    rows = [("/u/{id}/", "get", "Get", None), ("/v", "get", "Get", ""), ("/w", "get", "T_Get", None)]
    ops = spark.createDataFrame([("r", *x, 0, i) for i, x in enumerate(rows)],
                                "repo_id string, path string, method string, operation_id string, tag string, file_ord int, ep_ord int")
    assert {r.operation_id for r in A.operation_id_dedup(ops).collect()} == {"u_{id}_Get", "v_Get", "T_Get"}
    tagged = ops.withColumn("tag", F.lit("T"))  # both "Get" become "T_Get"; the id that was T_Get before is another group
    assert sorted(r.operation_id[:5] for r in A.operation_id_dedup(tagged).collect()) == ["T_Get", "T_Get", "T_Get"]
    assert len({r.operation_id for r in A.operation_id_dedup(tagged).where("path != '/w'").collect()}) == 2


def test_streams_count_late_events_over_many_files(spark, tmp_path):
    rng = random.Random(5)
    kinds = list(P.KIND_STATUS)
    rows = [(i, f"2024-0{1 + i % 9}-01 00:00:00", i % 2, rng.choice(kinds), float(rng.randrange(50))) for i in range(400)]
    rng.shuffle(rows)
    for k in range(4):  # jobs and months are spread over all files, long silences included
        part = spark.createDataFrame(rows[k::4], "event_id long, ts string, user_id long, event_type string, value double")
        part.withColumn("ts", F.col("ts").cast("timestamp")).toPandas().to_parquet(
            tmp_path / ("events.parquet" if k == 0 else f"events{k}.parquet"), coerce_timestamps="us")
    d = str(tmp_path)
    batch = P.as_progress(spark.read.parquet(*[str(p) for p in tmp_path.glob("events*.parquet")]))
    want = {r.job_id: r.asDict() for r in P.job_state(batch).collect()}
    assert {r.job_id: r.asDict() for r in P.run_job_state_stream_evicting(spark, d).collect()} == want
    assert {r.job_id: r.asDict() for r in P.run_job_state_stream(spark, d).collect()} == want
    cols = ["job_id", "n_log", "tail_len", "first_kept_seq"]
    assert sorted(P.run_log_tail_stream(spark, d).select(cols).collect()) == sorted(P.log_tail(batch).select(cols).collect())


def test_auth_accuracy_last_row_of_a_key_counts(spark):
    from routelens.operators.score import auth_accuracy
    rows = [("r", "a", 1, True), ("r", "a", 2, False), ("r", "b", 1, False), ("r", "b", 2, True)]
    cols = "repo_id string, path string, n int, has_auth boolean"
    golden = spark.createDataFrame([("r", "a", 1, False), ("r", "b", 1, False)], cols)
    got = auth_accuracy(spark.createDataFrame(rows, cols), golden, ["path"], order="n").first()
    assert (got.total, got.correct, got.spurious_auth, got.missing_auth) == (2, 1, 1, 0)
