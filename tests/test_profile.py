"""Profiles of small source trees, one an ecosystem, by the rules of real frameworks."""

from routelens.operators import profile as P
from routelens.operators import rulebook as R
from routelens.operators.detect import auth_context

TREES = {
    "npm": {"package.json": '{"dependencies": {"koa": "2"}, "devDependencies": {"express": "4"}}', "tsconfig.json": "{}"},
    "nest": {"package.json": '{"dependencies": {"@nestjs/core": "9"}}'},
    "broken": {"package.json": '{"dependencies": '},
    "pip": {"requirements.txt": "requests==2\n-r base/Web.txt\n", "base/web.txt": "Flask-RESTX\n", "setup.cfg": "tornado"},
    "poetry": {"pyproject.toml": "[tool]\nfastapi = '1'", "requirements.txt": "flask"},
    "gradle": {"build.gradle.kts": "implementation(\"org.springframework.boot:spring-boot-starter-web\")"},
    "maven": {"pom.xml": "<a>jersey-server</a>", "src/A.kt": "class A"},
    "module": {"go.mod": "module x"},
    "gin": {"go.mod": "require github.com/gin-gonic/gin v1", "Gemfile": "gem 'rails'\n"},
    "cargo": {"Cargo.toml": "axum = 1"},
    "composer": {"composer.json": '{"require": {"slim/slim": "4"}}'},
    "dotnet": {"bin/A.csproj": "Microsoft.AspNetCore", "src/B.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web">'},
    "skipped": {"obj/A.csproj": "Microsoft.AspNetCore"},
    "empty": {"package.json": None, "go.mod": None},
}


def _files(spark, trees):
    return spark.createDataFrame([(r, p, c) for r, t in trees.items() for p, c in t.items()] * 2,
                                 "repo_id string, path string, content string")


def test_framework_profile(spark):
    got = {r.repo_id: (r.framework, r.language, r.needle, r.others) for r in P.framework_profile(_files(spark, TREES)).collect()}
    assert got == {
        "npm": ("express", "typescript", "express", ""), "nest": ("nestjs", "typescript", "@nestjs/core", ""),
        "pip": ("flask", "python", "flask-restx", ""), "poetry": ("fastapi", "python", "fastapi", ""),
        "gradle": ("spring", "kotlin", "spring-boot-starter-web", ""), "maven": ("jersey", "kotlin", "jersey-server", ""),
        "module": (None, "go", None, ""), "gin": ("gin", "go", "github.com/gin-gonic/gin", "rails/ruby"),
        "cargo": ("axum", "rust", "axum", ""), "composer": ("slim", "php", "slim/slim", ""),
        "dotnet": ("aspnetcore", "csharp", "Microsoft.NET.Sdk.Web", ""),
    }


def test_route_files_stay_within_a_line_and_a_framework(spark):
    files = _files(spark, {
        "npm": {"src/a.js": "router.get('/x', f)", "src/b.js": "router.get(\n'/x')", "test/c.js": "app.get('/y')", "a.py": "app.get('/x')"},
        "gin": {"main.go": "r.GET(\"/p\", f)", "x.js": "app.get('/x')", "e.go": None},
    })
    profile = spark.createDataFrame([("npm", "express", "javascript"), ("gin", "gin", "go"), ("none", None, "go")],
                                    "repo_id string, framework string, language string")
    got = sorted((r.repo_id, r.path) for r in P.route_files(files, profile).collect())
    assert got == [("gin", "main.go"), ("npm", "src/a.js")]
    assert {fw for fw, _, _ in R.ROUTE_RULES} >= {fw for _, _, rules in R.ECOSYSTEMS for _, fw, _ in rules
                                                  if fw not in (None, "litestar", "roda", "lumen")}
    plan = P.route_hits(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # one scan for all rules


def test_ports_and_sources(spark):
    files = _files(spark, {
        "js": {".env.local": "PORT=5", ".env": "X=1\nPORT = 3001", "server.js": "app.listen(4000)", "x.kt": "x"},
        "java": {".env": "PORT=9", "application.yml": "server.port=8181", "A.java": "x", "b.kt": "x"},
        "py": {"lib/main.py": "run(port=8123)", "lib/app.txt": "port=1111"},
        "hs": {"a.hs": "x"}, "none": {"a.rb": "x", "a.hs": "x"},
    })
    profile = spark.createDataFrame([("js", "javascript"), ("java", "java"), ("py", "python"), ("hs", "haskell"), ("none", None)],
                                    "repo_id string, language string")
    got = {r.repo_id: (r.port, r.found_in) for r in P.server_profile(files, profile).collect()}
    assert got == {"js": (3001, ".env"), "java": (8181, "application.yml"), "py": (8123, "lib/main.py"),
                   "hs": (3000, None), "none": (None, None)}
    assert sorted({(r.repo_id, r.path) for r in P.source_files(files, profile).collect()}) == [
        ("hs", "a.hs"), ("java", "A.java"), ("java", "b.kt"), ("js", "server.js"), ("none", "a.rb"), ("py", "lib/main.py")]


def test_auth_rules(spark):
    lines = spark.createDataFrame([
        ("rails", "app/a.rb", 1, "  before_action :authenticate"), ("rails", "app/a.rb", 2, "skip_before_action :auth"),
        ("net", "Api/A.cs", 1, "[Authorize]"), ("skip", "B.java", 3, ".permitAll()"), ("none", "c.py", 1, None),
        ("jwt", "m.js", 1, "use(middleware for JWT)"), ("tests", "test/a.cs", 1, "[Authorize]")],
        "repo_id string, path string, line_no int, line string")
    got = {r.repo_id: (r.auth_mode, r.n_hits) for r in auth_context(lines, R.AUTH_RULES).collect()}
    assert got == {"rails": ("all", 2), "net": ("per-endpoint", 1), "skip": ("", 1), "jwt": ("all", 1)}
