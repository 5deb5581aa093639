"""Work grows with the rows, not with the rows of a key, and is dealt over all tasks whatever file it came from."""

from pyspark.sql import functions as F

from routelens import session
from routelens.operators import document as D
from routelens.operators import extract as E
from routelens.operators import loop as L
from routelens.operators import resolve as R


def rows_between(df):
    """The largest number of rows any step of the executed plan gave."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        m = plan.metrics().get("numOutputRows")
        kids = plan.children()
        return max([m.get().value() if m.isDefined() else 0] + [walk(kids.apply(i)) for i in range(kids.size())])

    return walk(df._jdf.queryExecution().executedPlan())


def test_mounts_meet_two_files_a_token(spark):
    n = 400
    mounts = spark.range(n).select(F.lit("r").alias("repo_id"), F.lit("reg.js").alias("source_file"), F.lit(0).alias("src_ord"),
                                   F.col("id").alias("key_ord"), F.concat(F.lit("userThing"), "id").alias("key"), F.lit("/api/user").alias("prefix"))
    files = spark.range(n).select(F.lit("r").alias("repo_id"), F.concat(F.lit("src/user_item_"), F.col("id") + n, F.lit(".js")).alias("path"), F.col("id").alias("file_ord"))
    got = E.mount_resolve(mounts, files)
    assert rows_between(got) < n * n / 4
    row = got.collect()
    assert [(r.path, r.key, r.score) for r in row] == [("src/user_item_400.js", "userThing0", 10)]


def test_mount_of_many_tokens_and_own_file(spark):
    words = [f"w{chr(97 + i)}" for i in range(9)]
    mounts = spark.createDataFrame([("r", "a/" + "_".join(words) + ".js", 0, 0, "_".join(words), "/x"), ("r", "b.js", 1, 1, "wa_wb", None),
                                    ("r", "c.js", 2, 2, None, "/v1/pets")],
                                   "repo_id string, source_file string, src_ord int, key_ord long, key string, prefix string")
    files = spark.createDataFrame([("r", "a/" + "_".join(words) + ".js", 0), ("r", "s/wi_wh_wg.js", 1), ("r", "s/my_pets.js", 2), ("r", "s/wa_wb.js", 3)],
                                  "repo_id string, path string, file_ord int")
    got = {(r.path, r.mounted_by, r.score) for r in E.mount_resolve(mounts, files).collect()}
    # the first excludes its own file; the second takes its exact stem; the third has a segment only
    assert got == {("s/wi_wh_wg.js", "a/" + "_".join(words) + ".js", 30), ("s/wa_wb.js", "b.js", 100), ("s/my_pets.js", "c.js", 9)}


def test_definitions_of_a_name_in_one_file_meet_once(spark):
    n = 500
    defs = spark.range(n).select(F.lit("r").alias("repo_id"), F.lit("Foo").alias("name"), F.lit("a/foo.ts").alias("path"), F.col("id").alias("line"))
    refs = spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").alias("ref_id"), F.lit("Foo").alias("name"), F.col("id").cast("string").alias("fragment"))
    got = R.resolve_indexed(refs, defs)
    assert rows_between(got) <= 4 * n
    assert {(r.path, r.line, r.n_candidates, r.how) for r in got.collect()} == {("a/foo.ts", 0, n, "stem")}


def test_null_line_of_a_definition_is_the_first(spark):
    defs = spark.createDataFrame([("r", "Foo", "foo.ts", 3), ("r", "Foo", "foo.ts", None)], "repo_id string, name string, path string, line long")
    refs = spark.createDataFrame([("r", 1, "Foo", None)], "repo_id string, ref_id long, name string, fragment string")
    assert [(r.line, r.n_candidates) for r in R.resolve_indexed(refs, defs).collect()] == [(None, 2)]


def test_pieces_of_one_file_are_dealt_out(spark):
    pieces = spark.range(400).coalesce(1).select(F.lit("r").alias("repo_id"), F.lit("schemas").alias("section"), F.concat(F.lit("S"), "id").alias("name"),
                                                 F.lit('{"type":"object","properties":{"a":{"type":"array"}}}').alias("body"))
    tree = D.clean(pieces)
    assert all(len(level.inputFiles()) >= 8 for level in tree.levels)
    assert D.schema_table(pieces).rdd.getNumPartitions() >= 8


def test_links_of_a_graph_are_dealt_out(spark, monkeypatch):
    edges = spark.range(100).coalesce(1).select(F.when(F.col("id") >= 0, "r").alias("repo_id"), F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst"))
    seeds = spark.createDataFrame([("r", "a1")], "repo_id string, node string")
    cut, write, parts = R.cut_lineage, L.write_stage, []
    monkeypatch.setattr(R, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    assert {r.node for r in R.closure(seeds, edges).collect()} == {"a1", "b1"}
    assert parts[0] >= 8
    monkeypatch.setattr(L, "write_stage", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or write(df, name))
    index = edges.select("repo_id", F.col("src").alias("name"), F.col("src").alias("path"))
    made = index.select("repo_id", "path", "name", F.lit(True).alias("ok"))
    refs = edges.select("repo_id", F.col("src").alias("name"), F.col("dst").alias("target"))
    found = L.resolution_loop(seeds.withColumnRenamed("node", "name"), index, made, refs, refs.limit(0).withColumnRenamed("target", "child"))
    assert {r.name for r in found.names.collect()} == {"a1", "b1"}
    assert min(n for name, n in (p for p in parts if isinstance(p, tuple)) if name == "loop-links") >= 8


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share does not grow with the edges, also where the repository is a literal."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 10, raising=False)
    edges = spark.range(400).select(F.lit("r").alias("repo_id"), F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst"))
    seeds = spark.createDataFrame([("r", "a1")], "repo_id string, node string")
    cut, write, parts = R.cut_lineage, L.write_stage, []
    monkeypatch.setattr(R, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    assert {(r.node, r.depth) for r in R.closure(seeds, edges.unionByName(edges)).collect()} == {("a1", 0), ("b1", 1)}
    assert parts[0] == 80
    monkeypatch.setattr(L, "write_stage", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or write(df, name))
    index = edges.select("repo_id", F.col("src").alias("name"), F.col("src").alias("path"))
    made = index.select("repo_id", "path", "name", F.lit(True).alias("ok"))
    refs = edges.select("repo_id", F.col("src").alias("name"), F.col("dst").alias("target"))
    found = L.resolution_loop(seeds.withColumnRenamed("node", "name"), index, made, refs, refs.limit(0).withColumnRenamed("target", "child"))
    assert {r.name for r in found.names.collect()} == {"a1", "b1"}
    assert dict(p for p in parts if isinstance(p, tuple))["loop-links"] == 40
