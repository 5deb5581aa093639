"""Worked cases for extraction, graph and clean-up operators on literal fixtures."""

from pyspark.sql import functions as F

from routelens.functions import hints as T
from routelens.operators import detect as D
from routelens.operators import extract as E
from routelens.operators import resolve as G
from routelens.operators import spec as A
from routelens.sources import corpus as S


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("r")).collect()[0]["r"]


def test_mount_exact_stem_scores_100(spark):
    mounts = spark.createDataFrame([("r", "src/app.js", 0, 0, "user.route", "/users")],
                                   "repo_id string, source_file string, src_ord int, key_ord int, key string, prefix string")
    files = spark.createDataFrame([("r", "src/user.route.js", 1), ("r", "src/user.js", 2), ("r", "src/app.js", 0)],
                                  "repo_id string, path string, file_ord int")
    r = E.mount_resolve(mounts, files).collect()
    assert [(x.path, x.prefix, x.score) for x in r] == [("src/user.route.js", "/users", 100)]


def test_effective_prefix(spark):
    assert _one(spark, E.effective_prefix(F.col("b"), F.col("m"), F.col("f")), b="/api/", m="/v1", f="v1") == "/api/v1"
    assert _one(spark, E.effective_prefix(F.col("b"), F.col("m"), F.col("f")), b="/api/", m="", f="users") == "/api/users"


def test_qualified_names_worked_case(spark):
    defs = spark.createDataFrame([("r", "User", "a/x/User.ts"), ("r", "User", "b/x/User.ts")], "repo_id string, name string, path string")
    got = {(r.path, r.qualified, r.depth) for r in G.qualified_names(defs).collect()}
    assert got == {("a/x/User.ts", "a_User", 2), ("b/x/User.ts", "b_User", 2)}


def test_import_fragments(spark):
    cases = {
        "from shop.cart.models import Basket": "shop/cart/models",
        "import Basket, { total } from \"../../cart/basket\";": "cart/basket",
        "const fees = require('./fees/table')": "fees/table",
        "require_relative '../billing/invoice'": "billing/invoice",
        "import 'side-effect'": "side-effect",
        "using Shop.Billing.Invoices;": "Shop/Billing/Invoices",
        "namespace Shop.Billing;": "Shop/Billing",
        "package org.shop.billing": "org/shop/billing",
        "use Shop\\Billing\\Invoice;": "Shop/Billing/Invoice",
        "use crate::billing::invoice;": "billing/invoice",
        "use serde::Serialize;": "serde/Serialize",
        "import \"example.org/shop/billing\"": "example.org/shop/billing",
        "import org.shop.billing.Invoice;": "org/shop/billing/Invoice",
        "import static org.shop.Fees.rate;": "org/shop/Fees/rate",
        "Shop.Billing.Invoice": "Shop/Billing/Invoice",
        "  from a import b": "a",
        "some words": None, "": None, "from": None,
    }
    for stmt, want in cases.items():
        assert _one(spark, T.import_fragment(F.col("s")), s=stmt) == want, stmt


def test_constraint_rename_keeps_existing(spark):
    df = spark.createDataFrame([({"ge": "1", "minimum": "0", "min_length": "2", "minlength": "3"},)], "m map<string,string>")
    got = df.select(A.constraint_rename(F.col("m")).alias("r")).collect()[0]["r"]
    assert got == {"ge": "1", "minimum": "0", "minLength": "2", "minlength": "3"}


def test_coerce_property_cases(spark):
    def coerce(js):
        df = spark.createDataFrame([(js,)], "j string")
        return df.select(A.coerce_property(F.parse_json("j")).alias("r")).collect()[0]["r"]
    assert coerce('"integer"') == '{"type":"integer"}'
    assert coerce('"User"') == '{"$ref":"#/components/schemas/User"}'
    assert coerce("null") == '{"type":"string","nullable":true}'
    assert coerce("true") == '{"type":"boolean"}'
    assert coerce("3") == '{"type":"number"}'
    assert coerce('["a"]') == '{"type":"array","items":{"type":"string"}}'
    assert coerce('"free text"') == '{"type":"string"}'


def test_condense_merges_islands_and_falls_back(spark):
    lines = spark.createDataFrame([("r", "f", i, f"line {i}") for i in range(1, 41)], "repo_id string, path string, line_no int, line string")
    keep = spark.createDataFrame([("r", "f", 1, 1), ("r", "f", 3, 4), ("r", "f", 20, 21)], "repo_id string, path string, start int, end int")
    total = spark.createDataFrame([("r", "f", 2000)], "repo_id string, path string, original_chars int")
    r = E.condense_source(lines, keep, total).collect()[0]
    assert r.was_filtered and r.n_chunks == 2  # 1..4 merge (gap 1), 20..21 stays apart
    assert r.filtered == "line 1\nline 2\nline 3\nline 4\n\nline 20\nline 21"
    small = spark.createDataFrame([("r", "f", 45)], "repo_id string, path string, original_chars int")
    assert not E.condense_source(lines, keep, small).collect()[0].was_filtered  # saving < 10%


def test_manifest_include_one_level(spark):
    files = spark.createDataFrame([("r", "req.txt", "flask\n-r base.txt"), ("r", "base.txt", "gunicorn\n-r deep.txt"),
                                   ("r", "deep.txt", "never")], "repo_id string, path string, content string")
    got = {r.path: r.content for r in D.manifest_includes(files).collect()}
    assert got["req.txt"] == "flask\n-r base.txt\ngunicorn\n-r deep.txt"  # deep.txt is not followed


def test_glob_to_regex():
    import re
    rx = re.compile(S.glob_to_regex("**/*.{js,ts}"))
    assert rx.match("a.js") and rx.match("src/a/b.ts") and not rx.match("a.py")
    assert not re.match(S.glob_to_regex("*.js"), "src/a.js")  # '*' does not cross '/'


def test_repo_ref_parse(spark):
    r = _one(spark, S.repo_ref_parse(F.col("u")), u="owner/repo")
    assert (r["is_url"], r["url"], r["name"]) == (True, "https://github.com/owner/repo.git", "repo")
    r = _one(spark, S.repo_ref_parse(F.col("u")), u="/srv/code/app")
    assert r["is_url"] is False and r["name"] == "app"


def test_resolve_by_scan_dotted_needs_parent(spark):
    lines = spark.createDataFrame([("r", "a.py", 1, "class Inner:"), ("r", "b.py", 1, "class Outer:"), ("r", "b.py", 2, "class Inner:"),
                                   ("r", "c.py", 1, "from b import Inner")], "repo_id string, path string, line_no int, line string")
    rules = spark.createDataFrame([(0, r"class\s+([A-Za-z0-9_]+)")], "rule_ord int, regex string")
    refs = spark.createDataFrame([("r", 1, "Outer.Inner", None)], "repo_id string, ref_id int, name string, fragment string")
    r = G.resolve_by_scan(refs, lines, rules).collect()[0]
    assert (r.path, r.line) == ("b.py", 2)


def test_scan_directory_prunes_and_orders(spark, tmp_path):
    (tmp_path / "repoA" / "src").mkdir(parents=True)
    (tmp_path / "repoA" / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "repoA" / ".git").mkdir(parents=True)
    (tmp_path / "repoA" / "src" / "app.py").write_text("from flask import Flask\n")
    (tmp_path / "repoA" / "node_modules" / "x" / "i.js").write_text("ignored")
    (tmp_path / "repoA" / ".git" / "config").write_text("ignored")
    (tmp_path / "repoB").mkdir()
    (tmp_path / "repoB" / "main.go").write_text("package main\n")
    files = S.scan_directory(spark, str(tmp_path)).collect()
    got = sorted((r.repo_id, r.path, r.lang) for r in files)
    assert got == [("repoA", "src/app.py", "py"), ("repoB", "main.go", "go")]


def test_language_from_build(spark):
    manifest = spark.createDataFrame([("a", "express", "javascript"), ("b", "nestjs", "javascript"), ("c", "express", "javascript"),
                                      ("d", "spring", "java"), ("e", "spring", "java"), ("f", "spring", "java")],
                                     "repo_id string, framework string, language string")
    files = spark.createDataFrame([("a", "tsconfig.json"), ("a", "src/app.ts"), ("c", "src/app.js"), ("d", "src/Main.kt"),
                                   ("e", "build.gradle.kts"), ("f", "src/Main.java")], "repo_id string, path string")
    hits = spark.createDataFrame([("e", "build.gradle.kts"), ("f", "pom.xml")], "repo_id string, path string")
    got = {r.repo_id: r.language for r in D.language_from_build(manifest, files, hits).collect()}
    assert got == {"a": "typescript", "b": "typescript", "c": "javascript", "d": "kotlin", "e": "kotlin", "f": "java"}


def test_dependency_keys_mode(spark):
    files = spark.createDataFrame([("r", "package.json", 0, "json", '{"devDependencies": {"express": "4"}}'),
                                   ("s", "composer.json", 0, "json", '{"require": {"laravel/framework": "9"}}'),
                                   ("t", "package.json", 0, "json", '{"dependencies": {"koa": "2"}}')],
                                  "repo_id string, path string, file_ord int, lang string, content string")
    rules = [(0, 0, r"package\.json$", "key", "express", "express", "javascript"),
             (1, 0, r"composer\.json$", "key", "laravel/framework", "laravel", "php")]
    got = {(r.repo_id, r.framework) for r in D.framework_hits(files, rules).collect()}
    assert got == {("r", "express"), ("s", "laravel")}
