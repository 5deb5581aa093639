"""Unit cases for small helpers the oracle sweep only covers indirectly."""

from pyspark.sql import functions as F

from routelens.operators import score as M
from routelens.operators import telemetry as L
from routelens.sources import corpus as S


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).collect()[0]["r"]


def test_secret_mask_replaces_every_occurrence(spark):
    got = _one(spark, S.secret_mask(F.col("t"), F.col("s")), "t string, s string", ("a KEY b KEY", "KEY"))
    assert got == "a *** b ***"
    assert _one(spark, S.secret_mask(F.col("t"), F.col("s")), "t string, s string", ("a KEY", "")) == "a KEY"


def test_path_relativize(spark):
    rel = lambda raw, root: _one(spark, S.path_relativize(F.col("r"), F.col("o")), "r string, o string", (raw, root))
    assert rel("  ./src/app.py ", "/repo") == "src/app.py"
    assert rel("/repo/src/app.py", "/repo/") == "src/app.py"
    assert rel("../etc/passwd", "/repo") is None
    assert rel("src/../../x", "/repo") is None


def test_capped_read(spark):
    assert _one(spark, S.capped_read(F.col("t"), 3), "t string", ("abcdef",)) == "abc"
    assert _one(spark, S.capped_read(F.col("t")), "t string", (None,)) == ""


def test_cache_probe_modes(spark):
    req = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    cache = spark.createDataFrame([("k1", '{"a":1}', 1), ("k2", "{broken", 1), ("k1", '{"a":2}', 2)], "key string, payload string, version int")
    on = {r.key: (r.status, r.payload) for r in L.cache_probe(req, cache).collect()}
    assert on == {"k1": ("hit", '{"a":2}'), "k2": ("miss", None), "k3": ("miss", None)}  # corrupt entry = miss
    assert {r.status for r in L.cache_probe(req, cache, mode="overwrite").collect()} == {"compute"}
    assert {r.status for r in L.cache_probe(req, cache, mode="off").collect()} == {"bypass"}
    stored = {r.key: (r.payload, r.version) for r in L.cache_store(cache, spark.createDataFrame(
        [("k3", '{"a":3}', 2)], "key string, payload string, version int")).collect()}
    assert stored["k1"] == ('{"a":2}', 2) and stored["k3"] == ('{"a":3}', 2)


def test_stale_snapshot(spark):
    pinned = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("c", "c3")], "repo_id string, commit string")
    ingested = spark.createDataFrame([("a", "c1"), ("b", "old")], "repo_id string, commit string")
    got = {r.repo_id: r.reason for r in S.stale_snapshot(pinned, ingested).collect()}
    assert got == {"b": "stale", "c": "missing"}


def test_round3_ratio_is_half_up_on_the_exact_value(spark):
    df = spark.createDataFrame([(1, 8), (2, 3), (0, 0), (1, 2000)], "n long, d long")
    got = [r.x for r in df.select(M.round3_ratio(F.col("n"), F.col("d")).alias("x")).collect()]
    assert got == [0.125, 0.667, 0.0, 0.001]  # 1/8 = 0.125 exactly; 1/2000 = 0.0005 rounds up


def test_schema_prf_weighted_worked_case(spark):
    matches = spark.createDataFrame([("r", "a", "x", 0.65)], "repo_id string, a_name string, e_name string, score double")
    actual = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, name string")
    golden = spark.createDataFrame([("r", "x")], "repo_id string, name string")
    r = M.schema_prf_weighted(matches, actual, golden).collect()[0]
    assert (r.fp, r.fn) == (1, 0)
    assert abs(r.precision - 0.65 / 1.65) < 1e-12 and r.recall == 1.0


def test_missing_extra_rows(spark):
    a = spark.createDataFrame([("r", "1"), ("r", "2")], "repo_id string, k string")
    e = spark.createDataFrame([("r", "2"), ("r", "3")], "repo_id string, k string")
    got = sorted((x.kind, x.item) for x in M.missing_extra(a, e, F.col("k")).collect())
    assert got == [("extra", "1"), ("missing", "3")]
