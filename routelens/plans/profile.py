"""Bindings of the repository profiles (D1a-D1h, D3, D4, D6, D11, S3) to ``part``.

Eight parts make a repository, each part a file: its kind, the names it depends on and its source lines follow from the
key and the size.  The twins apply the rules as tables to the joint text of a manifest, and line by line to sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators import profile as P
from routelens.operators import rulebook as R
from routelens.plans.catalog import query
from routelens.plans.discovery import _sq, _vals
from routelens.sources.corpus import glob_to_regex
from routelens.operators.detect import exclude_regex
from routelens.sources.tables import table

NEEDLES = [r[0] for _, _, rules in R.ECOSYSTEMS for r in rules if r[0]]
LINES = [
    'app.get("/users", list)', 'server.route({ path: "/x" })', '@Get(":id")', '@Controller("cats")', 'Route.get("/a", b)',
    '@router.post("/items")', 'app.include_router(items)', '@bp.route("/login")', 'path("users/", views.users),',
    'router.register("u", V)', '@RestController', '@PostMapping("/pets")', '@Path("/pets")', 'r.GET("/ping", ping)',
    'r.HandleFunc("/p", h).Methods("GET")', 'http.ListenAndServe(":80", nil)', 'resources :users', 'get', '  def index',
    'get "/about"', '#[get("/hello")]', '.route("/", get(root))', 'warp::path("hi")', 'Route::get("/u", U::class);',
    '$app->post("/u", f)', '#[Route("/u")]', '[HttpGet("{id}")]', 'app.MapGet("/u", f);', 'Response onRequest(c) {}',
    'final r = Router();', 'func boot(routes: RoutesBuilder)', 'router.get (', 'PORT=3100', 'server.port = 8181',
    'uvicorn.run(app, port=8123)', 'app.listen(4000)', 'nothing to see', 'application.get(', '"/split over lines")',
]
SOURCES = ["src/app.js", "src/cats.ts", "api/urls.py", "api/views.py", "src/Pets.java", "src/Main.kt", "cmd/main.go",
           "config/routes.rb", "app/controllers/users_controller.rb", "src/main.rs", "routes/api.php", "src/Web.php",
           "config/routes.yaml", "Api/Values.cs", "routes/users/index.dart", "Sources/App.swift", "tests/test_app.py",
           ".env", "application.properties"]


_LISTS: dict[str, str] = {}


def _pick(index: str, values) -> str:
    """A CASE over literals for the twin; Spark reads the same values from one folded array."""
    case = f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN {_sq(v)}" for i, v in enumerate(values)) + " END"
    _LISTS[case] = f"element_at(array({', '.join(map(_sq, values))}), CAST(({index}) % {len(values)} AS INT) + 1)"
    return case


def _spark(sql: str):
    for case, pick in _LISTS.items():
        sql = sql.replace(case, pick)
    return F.expr(sql)


_A, _B, _C = (_pick(i, NEEDLES) for i in ("p_partkey * 7 + p_size", "p_partkey * 13 + 5", "p_partkey * 5 + p_size * 3"))
_JSON = (f"""'{{"dependencies": {{"' || {_A} || '": "1"}}, "devDependencies": {{"' || {_B} || '": "2"}}, "require": {{"' """
         f"""|| {_C} || '": "3"}}}}'""")
_MANIFESTS = [
    ("package.json", _JSON), ("composer.json", _JSON), ("pyproject.toml", f"'x = ' || {_A} || chr(10) || {_B}"),
    ("requirements.txt", f"{_A} || '==1' || chr(10) || '-r base/extra.txt' || chr(10)"), ("base/extra.txt", f"upper({_B})"),
    ("pom.xml", f"'<artifactId>' || {_A} || '</artifactId>' || {_C}"), ("build.gradle.kts", f"{_A} || chr(10) || {_C}"),
    ("go.mod", f"'module m' || chr(10) || 'require ' || {_A}"),
    ("Gemfile", f"'gem ' || chr(39) || {_A} || chr(39) || chr(10) || 'gem \"' || {_B} || '\"' || chr(10) || {_C}"),
    ("Cargo.toml", f"{_A} || ' = 1' || chr(10) || {_C}"), ("src/App.csproj", f"'<Project Sdk=\"' || {_A} || '\">' || {_C}"),
    ("bin/App.csproj", "'Microsoft.AspNetCore'"), ("tsconfig.json", "'{}'"), ("src/A.kt", "'x'"),
]
_KIND = f"(p_partkey + p_size) % {len(_MANIFESTS)}"
_PATH = _pick("p_partkey + p_size", [m[0] for m in _MANIFESTS])
_TEXT = f"CASE {_KIND} " + " ".join(f"WHEN {i} THEN {t}" for i, (_, t) in enumerate(_MANIFESTS)) + " END"
_SOURCE = _pick("p_partkey * 3 + p_size", SOURCES)
_BODY = " || chr(10) || ".join(_pick(i, LINES) for i in ("p_partkey + p_size", "p_partkey * 11 + p_size * 5")) + " || chr(10)"
_REPO = "'r' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS {t})"


def manifest_files(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.expr(_REPO.format(t="STRING")).alias("repo_id"), _spark(_PATH).alias("path"), _spark(_TEXT).alias("content"))


def source_tree(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.expr(_REPO.format(t="STRING")).alias("repo_id"), _spark(_SOURCE).alias("path"), _spark(_BODY).alias("content"))


_SQL_PROFILE = f"""
WITH f AS (SELECT {_REPO.format(t="VARCHAR")} AS repo_id, {_PATH} AS path, {_TEXT} AS content FROM part),
inc AS (SELECT a.repo_id, a.path, a.content, string_agg(b.content, chr(10)) AS more FROM f a
        LEFT JOIN f b ON a.repo_id = b.repo_id AND a.path = 'requirements.txt'
             AND list_contains(regexp_extract_all(lower(a.content), '(?m)^-[rc]\\s+(.+)$', 1), b.path) GROUP BY ALL),
t AS (SELECT repo_id, path, content || coalesce(chr(10) || more, '') AS content FROM inc),
m AS (SELECT * FROM ({_vals([(e, t, p, rd) for e, (_, ms, _) in enumerate(R.ECOSYSTEMS) for t, (p, rd) in enumerate(ms)])}) v(eco, tier, rx, reader)),
r AS (SELECT * FROM ({_vals([(e, i, *rule) for e, (_, _, rs) in enumerate(R.ECOSYSTEMS) for i, rule in enumerate(rs)])}) v(eco, rule, needle, framework, language)),
hit AS (SELECT t.repo_id, t.path, m.eco, m.tier, r.rule, r.needle, r.framework, r.language
        FROM t JOIN m ON regexp_matches(t.path, m.rx) JOIN r ON r.eco = m.eco
        WHERE NOT (m.reader = 'contains' AND regexp_matches(t.path, '(^|/)(bin|obj)/'))
          AND CASE m.reader WHEN 'npm' THEN list_contains(list_concat(json_keys(t.content, '$.dependencies'), json_keys(t.content, '$.devDependencies')), r.needle)
                            WHEN 'composer' THEN list_contains(json_keys(t.content, '$.require'), r.needle)
                            WHEN 'word' THEN regexp_matches(lower(t.content), '\\b' || regexp_escape(r.needle) || '\\b')
                            WHEN 'gem' THEN regexp_matches(t.content, 'gem\\s+[''"]' || regexp_escape(r.needle) || '[''"]')
                            ELSE contains(t.content, r.needle) END),
eco AS (SELECT repo_id, eco, unnest(arg_min({{'path': path, 'needle': needle, 'framework': framework, 'language': language}}, (tier, path, rule)))
        FROM hit GROUP BY 1, 2),
lang AS (SELECT eco.* EXCLUDE (language),
                CASE WHEN language = 'javascript' AND EXISTS (SELECT 1 FROM f WHERE f.repo_id = eco.repo_id AND f.path = 'tsconfig.json') THEN 'typescript'
                     WHEN language = 'java' AND (eco.path = 'build.gradle.kts' OR EXISTS (SELECT 1 FROM f WHERE f.repo_id = eco.repo_id AND f.path LIKE '%.kt')) THEN 'kotlin'
                     ELSE language END AS language FROM eco),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY framework IS NULL, eco) AS k FROM lang)
"""


@query("framework_profile", sql=_SQL_PROFILE + """
SELECT a.repo_id, a.framework, a.language, CASE WHEN a.framework IS NOT NULL THEN a.needle END AS needle, a.path AS manifest,
       coalesce((SELECT string_agg(b.framework || '/' || b.language, ', ' ORDER BY b.k) FROM n b
                 WHERE b.repo_id = a.repo_id AND b.k > 1 AND b.framework IS NOT NULL), '') AS others
FROM n a WHERE a.k = 1""")
def q_framework_profile(spark, sf_dir):
    """D1a-D1h, D3, D4: real manifests of eight ecosystems, in their order of search."""
    return P.framework_profile(manifest_files(spark, sf_dir))


_SQL_ROUTES = f"""
WITH f AS (SELECT {_REPO.format(t="VARCHAR")} AS repo_id, {_SOURCE} AS path, {_BODY} AS content FROM part),
ln AS (SELECT DISTINCT repo_id, path, unnest(string_split(content, chr(10))) || chr(10) AS line FROM f
       WHERE NOT regexp_matches(path, {_sq(exclude_regex())})),
rr AS (SELECT * FROM ({_vals([(fw, i, glob_to_regex(g), p) for i, (fw, g, p) in enumerate(R.ROUTE_RULES)])}) v(framework, rule_ord, rx, line_rx)),
hits AS (SELECT repo_id, path, framework, min(rule_ord) AS rule_ord FROM ln JOIN rr ON regexp_matches(ln.path, rr.rx) AND regexp_matches(ln.line, rr.line_rx)
         GROUP BY 1, 2, 3)
"""


@query("route_rules", sql=_SQL_ROUTES + "SELECT repo_id, path, framework, rule_ord FROM hits")
def q_route_rules(spark, sf_dir):
    """D6 rule sets: the files that meet any framework's rules, all frameworks in one scan."""
    return P.route_hits(source_tree(spark, sf_dir))


@query("profile_route_files", sql=_SQL_PROFILE.rstrip() + ",\n" + _SQL_ROUTES.strip().removeprefix("WITH f AS").replace("(SELECT", "src AS (SELECT", 1)
       .replace("FROM f\n", "FROM src\n") + """
SELECT h.repo_id, h.path, h.framework, h.rule_ord FROM hits h JOIN n ON n.k = 1 AND n.repo_id = h.repo_id AND n.framework = h.framework""")
def q_profile_route_files(spark, sf_dir):
    """The route files of the framework that a repository's manifests name."""
    return P.route_files(source_tree(spark, sf_dir), P.framework_profile(manifest_files(spark, sf_dir)))


_EXTENSIONS = [(k, e) for k, v in R.SOURCE_EXTENSIONS.items() for e in v] + [("", e) for e in R.ANY_EXTENSIONS]


@query("profile_source_files", sql=_SQL_PROFILE.rstrip() + f""",
src AS (SELECT {_REPO.format(t="VARCHAR")} AS repo_id, {_SOURCE} AS path FROM part),
ext AS (SELECT * FROM ({_vals(_EXTENSIONS)}) v(language, ext))
SELECT s.repo_id, s.path FROM src s LEFT JOIN (SELECT repo_id, language FROM n WHERE k = 1) p ON p.repo_id = s.repo_id
JOIN ext e ON e.language = coalesce(p.language, '') AND lower(s.path) LIKE '%.' || e.ext""")
def q_profile_source_files(spark, sf_dir):
    """S3: the sources of the language that a repository's manifests name, or of any where they name none."""
    return P.source_files(source_tree(spark, sf_dir), P.framework_profile(manifest_files(spark, sf_dir)))
