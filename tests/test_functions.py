"""Worked cases for the column operators (paths, hints, scoring helpers)."""

from pyspark.sql import functions as F

from routelens.functions import hints as T
from routelens.functions import paths as P
from routelens.operators import score as M
from routelens.operators import telemetry as L


def _eval(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("r")).collect()[0]["r"]


def test_path_normalize_cases(spark):
    assert _eval(spark, P.path_normalize(F.col("b"), F.col("p")), b="/api/", p="/users") == "/api/users"
    assert _eval(spark, P.path_normalize(F.col("b"), F.col("p")), b="/api/v1", p="/api/v1/users") == "/api/v1/users"
    assert _eval(spark, P.path_normalize(F.col("b"), F.col("p")), b="", p="/a/{id:int}/{p?}/{*rest}/{v=1}/") == "/a/{id}/{p}/{rest}/{v}"
    # segment-aware by default, string prefix in compat mode (Q1)
    assert _eval(spark, P.path_normalize(F.col("b"), F.col("p")), b="/api", p="/apifoo") == "/api/apifoo"
    assert _eval(spark, P.path_normalize(F.col("b"), F.col("p"), compat=True), b="/api", p="/apifoo") == "/apifoo"


def test_path_normalize_idempotent(spark):
    once = _eval(spark, P.path_normalize(F.lit(""), F.col("p")), p="//x//{a:b}/")
    assert _eval(spark, P.path_normalize(F.lit(""), F.col("p")), p=once) == once


def test_path_keys(spark):
    assert _eval(spark, P.path_params(F.col("p")), p="/v{version:x}/{res:int}") == ["version", "res"]
    assert _eval(spark, P.path_dedup_key(F.col("p")), p="/request/magic") == "request_magic"
    assert _eval(spark, P.path_dedup_key(F.col("p")), p="/request-magic") == "request_magic"
    assert _eval(spark, P.path_score_key(F.col("p")), p="/Users/{Id}/") == "/users/{_}"
    assert _eval(spark, P.path_syntax_convert(F.col("p")), p="users/:id/<name>") == "/users/{id}/{name}"


def test_hint_parse_cases(spark):
    def parse(h):
        r = _eval(spark, T.hint_parse(F.col("h")), h=h)
        return (r["is_array"], r["inner"])
    for h in ("List<X>", "X[]", "[]X", "X list"):
        assert parse(h) == (True, "X")
    assert parse("Task<X>") == (False, "X")
    assert parse("Map<K,V>") == (False, "")
    assert parse("A.B") == (False, "A.B")
    assert parse("ActionResult<List<User>>") == (False, "List<User>")  # one level only (Q5)
    assert parse("#/components/schemas/#/components/schemas/X") == (False, "X")


def test_union_and_depth_split(spark):
    assert _eval(spark, T.union_split(F.col("h")), h="Union[A, B<C,D>]") == ["A", "B<C,D>"]
    assert _eval(spark, T.union_split(F.col("h")), h="List[A]") is None
    assert _eval(spark, T.depth_split(F.col("h")), h="Dict[str, Any], User") == ["Dict[str, Any]", "User"]


def test_hint_decompose_cases(spark):
    df = spark.createDataFrame([(1, "Task<List<X>>"), (2, "dict[str, X]"), (3, "Dict[str, Any]"),
                                (4, "Union[CreditCard, BankTransfer]"), (5, "Foo<int>")], "hint_id int, hint string")
    out = T.hint_decompose(df).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["path"])):
        got.setdefault(r["id"], []).append(r["name"])
    assert got.get(1) == ["X"] and got.get(2) == ["X"] and 3 not in got
    assert got.get(4) == ["CreditCard", "BankTransfer"]
    assert got.get(5) == ["Foo<int>"]  # unknown wrapper of builtins stands for itself


def test_build_ref(spark):
    assert _eval(spark, T.build_ref(F.col("h")), h="Union[A, B]") == \
        '{"oneOf":[{"$ref":"#/components/schemas/A"},{"$ref":"#/components/schemas/B"}]}'
    assert _eval(spark, T.build_schema_for_ref(F.col("h"), F.lit(False), F.lit(True)), h="P") == \
        '{"allOf":[{"$ref":"#/components/schemas/P"}],"nullable":true}'


def test_scores(spark):
    df = spark.createDataFrame([("r", "a")], "repo_id string, k string")
    act = spark.createDataFrame([("r", x) for x in "abc"], "repo_id string, k string")
    exp = spark.createDataFrame([("r", x) for x in "bcd"], "repo_id string, k string")
    r = M.set_prf(act, exp, ["k"]).collect()[0]
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and abs(r.f1 - 2 / 3) < 1e-12
    del df
    v = _eval(spark, M.composite(M.jaccard(M.name_tokens(F.col("a")), M.name_tokens(F.col("a"))),
                                 M.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))),
                                 F.array(F.lit("b"), F.lit("c"))), a="User")
    assert abs(v - 0.65) < 1e-12


def test_human_size(spark):
    assert _eval(spark, L.human_size(F.col("n").cast("long")), n="1234567") == "1.2M"
    assert _eval(spark, L.human_size(F.col("n").cast("long")), n="3450") == "3.5K"
    assert _eval(spark, L.human_size(F.col("n").cast("long")), n="12") == "12"
