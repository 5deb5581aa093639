"""Operator tests on literal fixtures: properties the oracle cannot express."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from routelens.operators import detect as D
from routelens.operators import resolve as G
from routelens.operators import score as M
from routelens.operators import spec as A
from routelens.operators import telemetry as L
from routelens.streaming import progress as P
from tests.conftest import SF_SMALL


def brute_force(w):
    n, m = w.shape
    best = 0.0
    if n <= m:
        for perm in itertools.permutations(range(m), n):
            best = max(best, sum(w[i, perm[i]] for i in range(n)))
    else:
        return brute_force(w.T)
    return best


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(7)
    for shape in [(3, 3), (3, 5), (5, 3), (4, 4), (1, 6), (6, 2)]:
        w = np.round(rng.random(shape), 3)
        pairs = M.max_weight_assignment(w)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) == min(shape)
        assert abs(sum(w[i, j] for i, j in pairs) - brute_force(w)) < 1e-9


def test_optimal_match_one_to_one(spark):
    rows = [("r", "a", "x", 0.9), ("r", "a", "y", 0.8), ("r", "b", "x", 0.85), ("r", "b", "y", 0.1)]
    s = spark.createDataFrame(rows, "repo_id string, a_name string, e_name string, score double")
    out = {(r.a_name, r.e_name) for r in M.optimal_match(s).collect()}
    assert out == {("a", "y"), ("b", "x")}  # 1.65 beats the greedy 0.9 + 0.1


def test_cycle_cut_makes_graph_acyclic(spark):
    edges = [("r", "A", "B", True), ("r", "B", "A", False), ("r", "B", "C", False), ("r", "C", "D", False),
             ("r", "D", "B", False), ("r", "X", "Y", False)]
    e = spark.createDataFrame(edges, "repo_id string, src string, dst string, via_array boolean")
    cut = {(r.src, r.dst) for r in G.break_ref_cycles(e).collect()}
    assert ("X", "Y") not in cut
    rest = {(s, d) for _, s, d, _ in edges} - cut
    # acyclic: repeatedly remove sinks
    nodes = {x for p in rest for x in p}
    while True:
        sinks = {n for n in nodes if not any(s == n for s, _ in rest)}
        if not sinks:
            break
        nodes -= sinks
        rest = {(s, d) for s, d in rest if d not in sinks}
    assert not nodes
    assert ("A", "B") in cut  # the array edge of the A<->B pair is preferred


def test_importer_detect_fixture(spark):
    files = spark.createDataFrame([
        ("r", "src/app.js", 0, "js", "import users from './routes/users.route'"),
        ("r", "src/routes/users.route.js", 1, "js", "router.get('/users')"),
        ("r", "src/other.js", 2, "js", "nothing here"),
        ("r", "src/app.test.js", 3, "js", "require('./routes/users.route')"),
    ], "repo_id string, path string, file_ord int, lang string, content string")
    known = files.where(F.col("file_ord") == 1).select("repo_id", "path")
    terms = spark.createDataFrame([("r", "users.route")], "repo_id string, term string")
    got = {r.path for r in D.importer_detect(files, terms, known).collect()}
    assert got == {"src/app.js"}


def test_stall_detect_worked_case(spark):
    ev = spark.createDataFrame([(1, i, h) for i, h in enumerate("xxxy")], "run int, seq int, h string")
    r = L.stall_detect(ev, "run", "seq", "h").collect()[0]
    assert (r.warn_turn, r.stop_turn) == (3, 6)


def test_operation_id_dedup_worked_case(spark):
    ops = spark.createDataFrame([("r", "/a", "get", "Get", "T", 0, 0), ("r", "/b", "get", "Get", "T", 0, 1)],
                                "repo_id string, path string, method string, operation_id string, tag string, file_ord int, ep_ord int")
    ids = sorted(r.operation_id for r in A.operation_id_dedup(ops).collect())
    assert ids[0] == "T_Get" and ids[1].startswith("T_Get_") and len(ids[1]) == len("T_Get_") + 6


def test_log_tail_closed_form(spark):
    df = spark.createDataFrame([(n,) for n in (1, 100, 101, 121, 122, 250)], "n long")
    got = [r.t for r in df.select(P.log_tail_len(F.col("n")).alias("t")).collect()]
    sim = []
    for n in (1, 100, 101, 121, 122, 250):
        tail = 0
        for _ in range(n):
            tail += 1
            if tail > 100:
                tail = 80
        sim.append(tail)
    assert got == sim


def test_stream_equals_batch_twin(spark):
    stream = P.run_job_state_stream(spark, SF_SMALL)
    batch = P.job_state(P.as_progress(spark.read.parquet(f"{SF_SMALL}/events.parquet")))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    evict = P.run_job_state_stream_evicting(spark, SF_SMALL)
    assert sorted(map(tuple, evict.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    tail_s = P.run_log_tail_stream(spark, SF_SMALL)
    tail_b = P.log_tail(P.as_progress(spark.read.parquet(f"{SF_SMALL}/events.parquet")))
    c2 = ["job_id", "n_log", "tail_len", "first_kept_seq"]
    assert sorted(map(tuple, tail_s.select(*c2).collect())) == sorted(map(tuple, tail_b.select(*c2).collect()))
